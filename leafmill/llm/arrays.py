"""Numpy helpers over the code points of many texts at once, used inside tasks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

#: Odd multipliers of the two rolling hashes.
BASE_1, BASE_2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of `texts` in a row, and where each text begins (one entry more than texts)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


def pieces(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose lengths add up to about `most`."""
    lo, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if held or lo < len(lengths):
        yield lo, len(lengths)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A well-mixed 64-bit value of each element."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _values(cps: np.ndarray, seed: int) -> np.ndarray:
    """`mix` of each code point, through a table of those that occur."""
    present = np.flatnonzero(np.bincount(cps, minlength=1))
    table = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.uint64)
    table[present] = mix(present, seed)
    return table[cps]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get((base, 0))
    if have is None or len(have[0]) < n:
        inverse = pow(base, -1, 2**64)
        out = []
        for b in (base, inverse):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[base, 0] = (out[0], out[1])
    return have


class Rolling:
    """Hash of any stretch of a sequence of code points, independent of where it lies."""

    def __init__(self, cps: np.ndarray, base: int) -> None:
        up, self.down = powers(base, max(len(cps), 1 << 20))
        self.sums = np.zeros(len(cps) + 1, np.uint64)
        np.cumsum(_values(cps, base) * up[: len(cps)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def windows(self, width: int) -> np.ndarray:
        """Hash of every window of `width`, by its start."""
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive elements."""
    n = len(x)
    if n < width:
        return x[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (maximal runs of letters and digits, in lower case), and
    where each text's words begin (one entry more than texts)."""
    cps, at = code_points([t.lower() for t in texts])
    if not len(cps):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    present = np.flatnonzero(np.bincount(cps))
    in_word = np.zeros(int(present[-1]) + 1, bool)
    in_word[present] = [unicodedata.category(chr(c))[0] == "L" or unicodedata.category(chr(c)) == "Nd" for c in present.tolist()]
    flag = in_word[cps]
    begins = np.zeros(len(cps), bool)
    begins[at[:-1][at[:-1] < len(cps)]] = True  # a text's first character never continues the text before
    first = flag.copy()
    first[1:] &= ~flag[:-1] | begins[1:]
    chars = np.flatnonzero(flag)
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    slot = np.flatnonzero(first[chars])  # where each word begins among the word characters
    sizes = np.diff(np.append(slot, len(chars)))
    place = np.arange(len(chars)) - np.repeat(slot, sizes)
    up, _ = powers(BASE_1, max(int(sizes.max()), 1 << 10))
    hashes = mix(np.add.reduceat(_values(cps[chars], BASE_2) * up[place], slot) + sizes.astype(np.uint64), 1)
    return hashes, np.searchsorted(starts, at)
