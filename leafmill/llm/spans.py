"""Long exact spans that records share, and how much of each record is shared, by fixed-block anchors.

A character counts if it lies in a window of `min_chars` that stands in another record. Blocks are half that long: whatever the offset of
a window, it holds a whole one of the non-overlapping blocks of its record.

1. Index: the hashes of the non-overlapping blocks of every record.
2. Probe: every rolling window of a block's length, in every record, is looked up in the index. A filter of bounded size (`bloom`) keeps
   those that are in no record's index inside their task; hits are anchors if they occur in two records.
3. Extend: the places of anchors are the same in every copy of a window. Of those within a window the one with the least hash stands for
   it, so windows that two records share have the same anchor at the same place. Neighbouring windows with one anchor form a run;
   a run that stands as a whole in two records is shared. The other runs, at the ends of repeats, are extended exactly: each of their
   windows is looked up, among each other and in one example of every shared run with the same anchor.
4. The shared windows of a record are united into maximal spans.

No pairs of records are formed: all lookups are aggregates (least and greatest record per hash) combined before the shuffle, followed by
semi joins that adaptive execution splits where one hash is hot. Stretches are compared by a 64-bit hash among those with the same
64-bit anchor hash, never across anchors.

An index larger than a filter is taken in ranges of hashes, with two passes over the texts for each; a window that is shared has an anchor in
some range. Beyond MOST_RANGES ranges passes would cost more than they save: there every window is its own anchor candidate, which
needs one pass at any size and yields the same spans. The texts with ends to extend are read again, behind a filter of their keys.

Cases: null, empty and shorter texts share nothing; rows with the same id are one record, and so are all rows with a null id, which get no
row in the result; a record that repeats itself does not count; an empty table yields an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm import bloom
from leafmill.llm.arrays import BASE_1, Rolling, code_points, mix, pieces, sliding_min
from leafmill.session import drop, materialise

#: Code points processed at once in a task; positions in a piece take 20 bits.
PIECE = 900_000
#: Ranges of the index that are worth passes of their own.
MOST_RANGES = 16

_RUN_KEYS, _WINDOW_KEYS = ["anchor", "h", "n", "lead"], ["anchor", "h", "lead"]

#: Stand for the records without an id, and for "other records" in the lookup of windows; by type of the id.
_NO_ID, _EXAMPLE = {"bigint": -(2**63), "string": "\x00"}, {"bigint": -(2**63) + 1, "string": "\x01"}


def _cut(text: str, width: int) -> list[tuple[int, str]]:
    """Parts of a text such that each window of `width` lies in exactly one of them."""
    if len(text) <= PIECE:
        return [(0, text)]
    step = PIECE - width + 1
    return [(a, text[a : a + PIECE]) for a in range(0, len(text) - width + 1, step)]


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[tuple], np.ndarray, list[str]]]:
    """(keys, offsets, parts) of about PIECE code points; the keys are the columns but the last, `text`."""
    for b in batches:
        ids, offs, parts = [], [], []
        keys = zip(*(b.column(i).to_pylist() for i in range(b.num_columns - 1))) if b.num_columns > 1 else [()] * b.num_rows
        for i, t in zip(keys, b.column("text").to_pylist()):
            for a, p in _cut(t, width):
                ids.append(i)
                offs.append(a)
                parts.append(p)
        for lo, hi in pieces(np.array([len(p) for p in parts], np.int64), PIECE):
            if hi > lo:
                yield ids[lo:hi], np.array(offs[lo:hi], np.int64), parts[lo:hi]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _block_rows(width: int):  # noqa: ANN202
    block = (width + 1) // 2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, offs, parts in _batches(batches, width):
            cps, at = code_points(parts)
            first = -offs % block
            count = np.maximum((np.diff(at) - first) // block, 0)
            which = np.repeat(np.arange(len(parts)), count)
            start = at[which] + first[which] + block * (np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count))
            yield pa.RecordBatch.from_arrays([_signed(np.unique(mix(Rolling(cps, BASE_1).of(start, start + block), 7)))], ["h"])

    return rows


def _hit_rows(width: int, kind: pa.DataType, index: Broadcast, r: int, ranges: int):  # noqa: ANN202
    block = (width + 1) // 2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, offs, parts in _batches(batches, width):
            cps, at = code_points(parts)
            hashes = mix(Rolling(cps, BASE_1).windows(block), 7)
            hit = bloom.passes(index.value, hashes, r, ranges)
            text = np.searchsorted(at, hit, "right") - 1
            whole = hit + block <= at[text + 1]
            hit, text = hit[whole], text[whole]
            own = (hit - at[text] + offs[text]) % block == 0
            yield pa.RecordBatch.from_arrays([_signed(hashes[hit]), pa.array([i[0] for i in ids], kind).take(pa.array(text)), pa.array(own)], ["h", "rec", "own"])

    return rows


def _run_rows(width: int, kind: pa.DataType, anchors: Broadcast | None, r: int, ranges: int):  # noqa: ANN202
    block = (width + 1) // 2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, none = np.uint64(20), np.uint64(2**64 - 1)
        for ids, offs, parts in _batches(batches, width):
            cps, at = code_points(parts)
            one = Rolling(cps, BASE_1)
            hashes = mix(one.windows(block), 7)
            if anchors is None:
                ranked = (hashes >> low << low) | np.arange(len(hashes), dtype=np.uint64)
            else:
                hit = bloom.passes(anchors.value, hashes, r, ranges)
                if not len(hit):
                    continue
                ranked = np.full(len(hashes), none)
                ranked[hit] = (hashes[hit] >> low << low) | hit.astype(np.uint64)
            least = sliding_min(ranked, width - block + 1)
            lengths = np.diff(at)
            step = np.zeros(len(cps) + 2, np.int32)
            np.add.at(step, at[:-1][lengths >= width], 1)
            np.add.at(step, at[1:][lengths >= width] - width + 1, -1)
            win = np.flatnonzero((np.cumsum(step)[: len(least)] > 0) & (least != none))
            if not len(win):
                continue
            anchor = (least[win] & np.uint64((1 << 20) - 1)).astype(np.int64)
            new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (win[1:] != win[:-1] + 1)) + 1
            first, last = np.append(0, new), np.append(new, len(win)) - 1
            start, stop, anchor = win[first], win[last] + width, anchor[first]
            text = np.searchsorted(at, start, "right") - 1
            of = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(hashes[anchor]),
                    pa.array([i[0] for i in ids], kind).take(of),
                    pa.array([i[1] for i in ids], pa.int64()).take(of),
                    pa.array(start - at[text] + offs[text]),
                    pa.array((last - first + 1).astype(np.int32)),
                    pa.array((anchor - start).astype(np.int32)),
                    _signed(one.of(start, stop)),
                ],
                ["anchor", "rec", "row", "at", "n", "lead", "h"],
            )

    return rows


def _window_rows(width: int, kind: pa.DataType, example: object):  # noqa: ANN202
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, ids, whose, begin, count, anchors, leads = [], [], [], [], [], [], []
            for i, w, t, runs in zip(*(b.column(c).to_pylist() for c in ("rec", "row", "text", "runs"))):
                for r in runs:
                    ids.append(example if r["example"] else i)
                    whose.append(w)
                    anchors.append(r["anchor"])
                    leads.append(r["lead"])
                    begin.append(r["at"])
                    count.append(r["n"])
                    parts.append(t[r["at"] : r["at"] + r["n"] - 1 + width])
            begins, counts, keys, ahead, owner = (np.array(x, np.int64) for x in (begin, count, anchors, leads, whose))
            for lo, hi in pieces(np.array([len(p) for p in parts], np.int64), PIECE):
                if hi <= lo:
                    continue
                cps, at = code_points(parts[lo:hi])
                one = Rolling(cps, BASE_1)
                which = np.repeat(np.arange(hi - lo), counts[lo:hi])
                inside = np.arange(len(which)) - np.repeat(np.cumsum(counts[lo:hi]) - counts[lo:hi], counts[lo:hi])
                s = at[which] + inside
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[lo:hi][which]),
                        _signed(one.of(s, s + width)),
                        pa.array((ahead[lo:hi][which] - inside).astype(np.int32)),
                        pa.array(ids[lo:hi], kind).take(pa.array(which)),
                        pa.array(owner[lo:hi][which]),
                        pa.array(begins[lo:hi][which] + inside),
                    ],
                    ["anchor", "h", "lead", "rec", "row", "at"],
                )

    return rows


def _in_two_records(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur in at least two records."""
    return rows.groupBy(*keys).agg(F.min("rec").alias("lo"), F.max("rec").alias("hi")).where("lo <> hi").select(*keys)


def _runs(texts: DataFrame, name: str, kind: pa.DataType, width: int) -> DataFrame:
    """(anchor, rec, row, at, n, lead, h): the runs of windows around every anchor that occurs in two records."""
    columns = f"anchor long, rec {name}, row long, at long, n int, lead int, h long"
    blocks = materialise(texts.select("text").mapInArrow(_block_rows(width), "h long").distinct())
    n = blocks.count()
    ranges = bloom.ranges_for(n)
    parts = []
    for r in range(ranges if ranges <= MOST_RANGES else 0):
        mine = bloom.in_range(F.col("h"), r, ranges)
        index = bloom.build(blocks.where(mine), -(-n // ranges))
        hits = texts.select("rec", "text").mapInArrow(_hit_rows(width, kind, index, r, ranges), f"h long, rec {name}, own boolean")
        # a value that passes the filter stands in the index if it is some record's own block
        met = hits.groupBy("h").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi"), F.max("own").alias("own"))
        anchors = materialise(met.where("lo <> hi AND own").select("h"))
        marked = bloom.build(anchors, anchors.count())
        parts.append(materialise(texts.mapInArrow(_run_rows(width, kind, marked, r, ranges), columns)))
        drop(anchors)
        for filter_ in (index, marked):
            filter_.unpersist()
    drop(blocks)
    runs = parts[0] if parts else materialise(texts.mapInArrow(_run_rows(width, kind, None, 0, 1), columns))
    for p in parts[1:]:
        runs = runs.unionByName(p)
    kept = materialise(runs.join(_in_two_records(runs.select("anchor", "rec"), ["anchor"]), "anchor", "left_semi"))
    drop(*(parts or [runs]))
    return kept


def _only(asked: Broadcast):  # noqa: ANN202
    """The texts whose key passes the filter."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = mix(b.column("row").to_numpy(zero_copy_only=False).view(np.uint64), 3)
            yield b.take(pa.array(bloom.passes(asked.value, keys)))

    return rows


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([_signed(mix(b.column("row").to_numpy(zero_copy_only=False).view(np.uint64), 3))], ["h"])


def shared_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 400) -> DataFrame:
    """(rec, row, start_char, end_char): the united stretches of each record that stand in other records; `rec` is the id, as a string if it is
    no whole number, `row` tells apart the texts of a record."""
    if min_chars < 2:
        raise ValueError("min_chars must be at least 2")
    name = documents.schema[id_col].dataType.simpleString()
    name = "bigint" if name in ("tinyint", "smallint", "int", "bigint") else "string"
    kind = pa.int64() if name == "bigint" else pa.string()
    texts = documents.select(
        F.coalesce(F.col(id_col).cast(name), F.lit(_NO_ID[name])).alias("rec"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text")
    ).where(F.char_length("text") >= min_chars)
    runs = _runs(texts, name, kind, min_chars)
    by_run = runs.groupBy(*_RUN_KEYS).agg(F.min("rec").alias("lo"), F.max("rec").alias("hi"), F.min(F.struct("rec", "row", "at")).alias("one"))
    whole = by_run.where("lo <> hi")
    marked = runs.join(whole.select(*_RUN_KEYS, F.lit(True).alias("whole")), _RUN_KEYS, "left")
    settled = materialise(marked.select("anchor", "rec", "row", "at", "n", "lead", F.coalesce("whole", F.lit(False)).alias("whole")))
    edges = settled.where("NOT whole")
    examples = whole.select("anchor", "one.*", "n", "lead").join(edges.select("anchor").distinct(), "anchor", "left_semi")
    asked = edges.drop("whole").withColumn("example", F.lit(False)).unionByName(examples.withColumn("example", F.lit(True))).distinct()
    asked = materialise(asked.groupBy("rec", "row").agg(F.collect_list(F.struct("at", "n", "anchor", "lead", "example")).alias("runs")))  # at most as many as the text is long
    drop(runs)
    wanted = asked.select("row").mapInArrow(_keys, "h long")
    again = texts.mapInArrow(_only(bloom.build(wanted, asked.count())), f"rec {name}, row long, text string").join(asked, ["rec", "row"])
    windows = materialise(again.mapInArrow(_window_rows(min_chars, kind, _EXAMPLE[name]), f"anchor long, h long, lead int, rec {name}, row long, at long"))
    drop(asked)
    windows = windows.join(_in_two_records(windows, _WINDOW_KEYS), _WINDOW_KEYS, "left_semi")
    covered = settled.where("whole").select("rec", "row", F.col("at").alias("s"), (F.col("at") + F.col("n") - 1 + min_chars).alias("e")).unionByName(
        windows.select("rec", "row", F.col("at").alias("s"), (F.col("at") + min_chars).alias("e"))
    )
    in_order = W.partitionBy("rec", "row").orderBy("s", "e")
    reach = F.max("e").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    covered = covered.where(~F.col("rec").isin(_NO_ID[name], _EXAMPLE[name])).groupBy("rec", "row", "s").agg(F.max("e").alias("e"))
    opened = covered.withColumn("new", (reach.isNull() | (F.col("s") > reach)).cast("int"))
    numbered = opened.withColumn("span", F.sum("new").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("rec", "row", "span").agg(F.min("s").alias("start_char"), F.max("e").alias("end_char")).drop("span")


def shared_chars(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 400) -> DataFrame:
    """(id, shared_chars): how many characters of each record are shared; only records with any."""
    kind = documents.schema[id_col].dataType
    spans = shared_spans(documents, id_col, text_col, min_chars)
    return spans.groupBy("rec").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("shared_chars")).select(
        F.col("rec").cast(kind).alias(id_col), "shared_chars"
    )
