"""Weighted Levenshtein automata intersected with a vocabulary trie, for many words at once.

The automaton of a word accepts everything within a cost: a listed misreading (one or more characters read
as others, so merges and splits too) costs CONFUSED, any other edit of one character costs EDITED. Its
states (characters of the word used, cost so far) are paired with trie nodes and advanced together, all
words in step, as arrays; every vocabulary word within the cost is found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CONFUSED, EDITED = 1, 2

# Fixed values: (as read, as printed), in lower case.
MISREADINGS = [
    ("c", "e"), ("e", "c"), ("@", "a"), ("!", "i"), ("!", "l"), ("l", "i"), ("i", "l"), ("1", "i"), ("1", "l"), ("|", "l"), ("|", "i"),
    ("0", "o"), ("5", "s"), ("$", "s"), ("f", "t"), ("t", "f"), ("9", "g"), ("6", "b"), ("8", "b"), ("3", "e"), ("2", "z"), ("h", "b"), ("b", "h"),
    ("li", "h"), ("1i", "h"), ("l1", "h"), ("rn", "m"), ("m", "rn"), ("m", "in"), ("rn", "in"), ("in", "m"), ("cl", "d"), ("c1", "d"), ("ci", "d"), ("d", "cl"), ("d", "ti"),
    ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"), ("il", "u"), ("li", "u"), ("vv", "w"), ("w", "vv"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"),
]


@dataclass(frozen=True)
class Trie:
    """A vocabulary as a trie: edges sorted by (node, character)."""

    words: list[str]
    keys: np.ndarray  # node << 21 | character
    child: np.ndarray
    first: np.ndarray  # where a node's edges begin, one entry more than nodes
    ends: np.ndarray  # number of the word that ends at a node, or -1

    @staticmethod
    def of(words: list[str]) -> Trie:
        words = sorted(set(words))
        edges: dict[int, int] = {}
        ends = {}
        n, path, before = 1, [0], ""
        for k, w in enumerate(words):
            same = 0
            while same < min(len(w), len(before)) and w[same] == before[same]:
                same += 1
            del path[same + 1 :]
            for c in w[same:]:
                edges[path[-1] << 21 | ord(c)] = n
                path.append(n)
                n += 1
            ends[path[-1]] = k
            before = w
        keys = np.array(sorted(edges), np.int64)
        last = np.full(n, -1, np.int32)
        last[list(ends)] = list(ends.values())
        return Trie(words, keys, np.array([edges[k] for k in keys.tolist()], np.int64), np.searchsorted(keys >> 21, np.arange(n + 1)), last)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The child by each character, or -1."""
        if not len(self.keys):
            return np.full(len(node), -1, np.int64)
        key = node << 21 | char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.child[at], -1)

    def children(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into `node`, child) of all edges."""
        count = self.first[node + 1] - self.first[node]
        which = np.repeat(np.arange(len(node)), count)
        return which, self.child[self.first[node][which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)]


def candidates(words: list[str], trie: Trie, most: np.ndarray, edits: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into `words`, number of a vocabulary word, cost) of all pairs within each word's cost `most`;
    without `edits` by listed misreadings only."""
    none = np.zeros(0, np.int64)
    if not words or not trie.words:
        return none, none, none
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(lengths + 3) - lengths - 3  # three closing zeros after each word
    codes = np.zeros(int((lengths + 3).sum()) + 3, np.int64)
    place = np.repeat(start, lengths) + np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    codes[place] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes) - 3
    marks = []
    for seen, _ in MISREADINGS:
        hit = np.ones(n, bool)
        for k, c in enumerate(seen):
            hit &= codes[k : n + k] == ord(c)
        marks.append(hit)
    out = []
    q = np.arange(len(words))
    i, node, cost = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    while len(q):
        done = (i == lengths[q]) & (trie.ends[node] >= 0)
        out.append((q[done], trie.ends[node[done]].astype(np.int64), cost[done]))
        at = start[q] + i
        new = []

        def go(sel: np.ndarray, used: int, to: np.ndarray, price: int) -> None:
            ok = to >= 0
            new.append((q[sel][ok], i[sel][ok] + used, to[ok], cost[sel][ok] + price))

        live = np.flatnonzero(i < lengths[q])
        go(live, 1, trie.step(node[live], codes[at[live]]), 0)
        able = cost + CONFUSED <= most[q]
        for (seen, true), hit in zip(MISREADINGS, marks):
            sel = np.flatnonzero(able & hit[np.minimum(at, n - 1)] & (i < lengths[q]))
            if len(sel):
                to = node[sel]
                for c in true:
                    to = np.where(to >= 0, trie.step(np.maximum(to, 0), np.full(len(to), ord(c))), -1)
                go(sel, len(seen), to, CONFUSED)
        sel = np.flatnonzero(cost + EDITED <= most[q]) if edits else q[:0]
        if len(sel):
            which, to = trie.children(node[sel])
            go(sel[which], 0, to, EDITED)
            inside = i[sel][which] < lengths[q[sel][which]]
            go(sel[which][inside], 1, to[inside], EDITED)
            left = sel[i[sel] < lengths[q[sel]]]
            go(left, 1, node[left], EDITED)
        q, i, node, cost = (np.concatenate(x) for x in zip(*new))
        # one state per (word, characters used, node), the cheapest
        order = np.lexsort((cost, node, i, q))
        q, i, node, cost = q[order], i[order], node[order], cost[order]
        fresh = np.append(True, (q[1:] != q[:-1]) | (i[1:] != i[:-1]) | (node[1:] != node[:-1]))[: len(q)]
        q, i, node, cost = q[fresh], i[fresh], node[fresh], cost[fresh]
    q, w, cost = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((cost, w, q))
    q, w, cost = q[order], w[order], cost[order]
    fresh = np.append(True, (q[1:] != q[:-1]) | (w[1:] != w[:-1]))[: len(q)]
    return q[fresh], w[fresh], cost[fresh]
