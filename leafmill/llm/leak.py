"""Held-out test passages that stand in training texts.

Each task builds suffix arrays over shards of the training texts: the words of many documents in a row,
suffixes sorted by their first `min_words` words. The suffixes of all test items are looked up by binary
search, all at once; equal neighbours give every location, and hits on one diagonal join to the longest
verbatim match. Suffix arrays are built shard by shard inside a partition, so nothing is shuffled but the
hits. Words are 64-bit hashes while sorting and searching; each hit is then checked on the words.

The test set is a stated query set: it goes to all tasks in blocks of at most MAX_ITEM_CHARS characters.

Cases: null or empty texts and items, and items under `min_words` words, have no match; a null item id or
document id is kept as it is; a document longer than a shard is sorted and searched in several; repeated items or documents yield their rows once; items longer than a
block make a block of their own; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.arrays import pieces, word_hashes

#: Characters of test text broadcast to the tasks at once.
MAX_ITEM_CHARS = 20_000_000
#: Code points per shard, that is per suffix array.
SHARD = 3_000_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """The words of a text as the matching sees them."""
    import unicodedata

    out = []
    for run in _WORD.findall(text.lower()):
        if run.isascii():
            out.append(run)
            continue
        part = ""
        for c in run:
            k = unicodedata.category(c)
            if k[0] == "L" or k == "Nd":
                part += c
            elif part:
                out.append(part)
                part = ""
        if part:
            out.append(part)
    return out


def suffix_array(ranks: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the first `depth` or more elements from each on; `ranks` are at least 1, and 0 stands past the end."""
    have, names = 1, ranks.astype(np.int64)
    order = np.argsort(names, kind="stable")
    while have < depth:
        bits = int(names.max()).bit_length()
        times = max(2, min(62 // bits, -(-depth // have)))
        key = names.copy()
        for k in range(1, times):
            key <<= bits
            if have * k < len(names):
                key[: len(names) - have * k] |= names[have * k :]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.append(1, (ordered[1:] != ordered[:-1]).astype(np.int64))
        names = np.empty(len(key), np.int64)
        names[order] = np.cumsum(fresh)
        have *= times
    return order


def _bound(ranks: np.ndarray, order: np.ndarray, wanted: np.ndarray, upper: bool) -> np.ndarray:
    """For each row of `wanted`, how many suffixes come before it (`upper`: or start with it)."""
    lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
    depth = wanted.shape[1]
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        at = order[mid][:, None] + np.arange(depth)
        seen = np.where(at < len(ranks), ranks[np.minimum(at, len(ranks) - 1)], 0)
        differ = seen != wanted[open_]
        where = differ.argmax(1)
        rows = np.arange(len(open_))
        less = np.where(differ[rows, where], seen[rows, where] < wanted[open_][rows, where], upper)
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)


def shard_hits(hashes: np.ndarray, at: np.ndarray, item_words: np.ndarray, item_at: np.ndarray, min_words: int) -> list[tuple[int, int, int, int, int]]:
    """(document, item, word of the document, word of the item, length): maximal matches of at least `min_words`
    words in one shard, by document and item number."""
    n_docs = len(at) - 1
    if not len(hashes) or len(item_words) < min_words:
        return []
    known, ranks = np.unique(hashes, return_inverse=True)
    place = np.arange(len(hashes)) + np.repeat(np.arange(n_docs), np.diff(at))
    text = np.full(len(hashes) + n_docs, len(known) + 1, np.int64)  # a closing mark after each document
    text[place] = ranks + 1
    spot = np.searchsorted(known, item_words)
    spot[spot == len(known)] = 0
    item_ranks = np.where(known[spot] == item_words, spot + 1, 0)
    start = np.concatenate([np.arange(a, b - min_words + 1) for a, b in zip(item_at[:-1], item_at[1:])] or [np.zeros(0, np.int64)]).astype(np.int64)
    wanted = item_ranks[start[:, None] + np.arange(min_words)] if len(start) else np.zeros((0, min_words), np.int64)
    good = (wanted > 0).all(1)
    start, wanted = start[good], wanted[good]
    if not len(start):
        return []
    order = suffix_array(text, min_words)
    lo, hi = _bound(text, order, wanted, False), _bound(text, order, wanted, True)
    count = hi - lo
    if not count.sum():
        return []
    which = np.repeat(np.arange(len(start)), count)
    pos = order[np.repeat(lo, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)]
    begin = at[:-1] + np.arange(n_docs)
    doc = np.searchsorted(begin, pos, "right") - 1
    item = np.searchsorted(item_at, start[which], "right") - 1
    in_doc, in_item = pos - begin[doc], start[which] - item_at[item]
    by = np.lexsort((in_item, in_doc - in_item, item, doc))
    doc, item, in_doc, in_item = doc[by], item[by], in_doc[by], in_item[by]
    joined = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (in_doc[1:] == in_doc[:-1] + 1) & (in_item[1:] == in_item[:-1] + 1)
    head = np.append(True, ~joined)
    first = np.flatnonzero(head)
    length = np.diff(np.append(first, len(doc))) + min_words - 1
    return list(zip(*(x.tolist() for x in (doc[first], item[first], in_doc[first], in_item[first], length))))


def long_hits(hashes: np.ndarray, item_words: np.ndarray, item_at: np.ndarray, min_words: int, most: int) -> list[tuple[int, int, int, int, int]]:
    """`shard_hits` of one document in shards of `most` words. Each window of `min_words` lies in exactly one of them; matches that go on in the next
    shard are joined."""
    found: list[list[int]] = []
    ends: dict[tuple[int, int, int], int] = {}
    for a in range(0, max(len(hashes) - min_words + 1, 1), most - min_words + 1):
        part, later = hashes[a : a + most], {}
        for _, i, p, q, n in shard_hits(part, np.array([0, len(part)]), item_words, item_at, min_words):
            k = ends.get((i, a + p, q))
            if k is None:
                k = len(found)
                found.append([0, i, a + p, q, n])
            else:
                found[k][4] += n - min_words + 1
            later[i, a + p + n - min_words + 1, q + n - min_words + 1] = k
        ends = later
    return [tuple(x) for x in found]


def _search(items: list[tuple[object, str]], min_words: int, id_type: pa.DataType, item_type: pa.DataType):  # noqa: ANN202
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_words, item_at = word_hashes([t for _, t in items])
        of_item: dict[int, list[str]] = {}
        for b in batches:
            docs, texts = b.column("doc").to_pylist(), b.column("text").to_pylist()
            for lo, hi in pieces(np.array([len(t) for t in texts], np.int64), SHARD):
                hashes, at = word_hashes(texts[lo:hi])
                out, now, said = [], -1, []
                long_text = hi - lo == 1 and len(texts[lo]) > SHARD
                hits = long_hits(hashes, item_words, item_at, min_words, max(SHARD // 4, 2 * min_words)) if long_text else shard_hits(hashes, at, item_words, item_at, min_words)
                for d, i, p, q, n in hits:
                    if d != now:
                        now, said = d, words_of(texts[lo + d])
                    asked = of_item.setdefault(i, words_of(items[i][1]))
                    if said[p : p + n] == asked[q : q + n]:
                        out.append((docs[lo + d], items[i][0], p, q, n))
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], id_type), pa.array(cols[1], item_type), *(pa.array(c, pa.int64()) for c in cols[2:])],
                        ["doc", "item", "doc_word", "item_word", "n_words"],
                    )

    return rows


def leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = 12, block_chars: int = MAX_ITEM_CHARS) -> DataFrame:
    """(doc, item, doc_word, item_word, n_words): every maximal verbatim match of at least `min_words` words."""
    from pyspark.sql.pandas.types import to_arrow_type

    texts = documents.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("text IS NOT NULL AND text <> ''")
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL").distinct()
    kinds = documents.schema[id_col].dataType, items.schema[item_col].dataType
    schema = f"doc {kinds[0].simpleString()}, item {kinds[1].simpleString()}, doc_word long, item_word long, n_words long"
    out, block, held = None, [], 0

    def probe(block: list[tuple[object, str]]) -> DataFrame:
        return texts.mapInArrow(_search(block, min_words, to_arrow_type(kinds[0]), to_arrow_type(kinds[1])), schema)

    for r in asked.toLocalIterator():
        if block and held + len(r.text) > block_chars:
            out = probe(block) if out is None else out.unionByName(probe(block))
            block, held = [], 0
        block.append((r.item, r.text))
        held += len(r.text)
    last = probe(block)
    return last if out is None else out.unionByName(last)


def leaked_pairs(documents: DataFrame, items: DataFrame, **named: object) -> DataFrame:
    """(doc, item, n_words): which documents contain which items, with the longest match."""
    return leaks(documents, items, **named).groupBy("doc", "item").agg(F.max("n_words").alias("n_words"))


def without_leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", **named: object) -> DataFrame:
    """The documents that contain no test passage."""
    bad = leaks(documents, items, id_col=id_col, **named).select(F.col("doc").alias("leaked_doc")).distinct()
    return documents.join(bad, F.col("leaked_doc").eqNullSafe(documents[id_col]), "left_anti")
