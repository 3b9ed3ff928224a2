"""Items larger than a limit, cut into overlapping pieces at natural boundaries.

An item is a row's text or a file. It is taken in byte ranges with halos, never as a whole:

1. each range counts its characters; prefix sums of the counts give every range its character offset;
2. cuts are looked for in the intervals of a fixed grid, half a piece long. The range that holds an interval's end has the interval in its left
   halo and takes the best boundary in the interval's second half, or else in the whole of it: end of a paragraph, of a sentence, of a line, of a
   clause, of a word;
3. the table of cuts is stitched by key (item, interval) and its neighbours. An interval without a boundary gets no cut if the piece fits without
   one, else cuts at the boundaries nearest to it; only a stretch without boundaries longer than a piece is cut hard, not before
   a combining mark. Every other cut goes if the pieces beside it fit into one. A piece reaches from `overlap` characters before a cut to the next;
4. each range emits its part of each interval by offset; pieces take their parts from the intervals they reach over.

Grid points lie at overlap + k * step, and two steps are at most max_chars - overlap: pieces fit wherever the cuts fall, and no
cut depends on a chain of earlier ones. Prefix sums go over blocks of ranges first, so one item that holds a third
of all bytes is spread over tasks. The ranges of oversized items are written once and read from there.

Cases: null and empty items and items within the limit have no pieces here (`pieces` gives them as one
piece if asked to); rows with the same id and text count once; rows with the same id and other text are
other items; a null id stays null; bytes that are not UTF-8 are replaced as Spark's make_valid_utf8 does;
a limit that is null, or not larger than the overlap plus one, is an error; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.operators.running import running
from leafmill.session import materialise

#: Bytes of a range; ranges per block of the prefix sums.
RANGE_BYTES, BLOCK = 262_144, 64
#: Bytes after a range that are looked at: enough for two code points.
AHEAD = 12

#: Kinds of boundary, best first; each pattern takes the text up to the last such boundary.
BOUNDARIES = [
    ("paragraph", r"(?s)^.*\n[ \t\r ]*\n\s*"),
    ("sentence", r"(?s)^.*(?:[.!?…][\"'”’»)\]]*\s+|[。！？]\s*)"),
    ("line", r"(?s)^.*\n[ \t]*"),
    ("clause", r"(?s)^.*[;:,–—]\s+"),
    ("word", r"(?Us)^.*\s"),
]
_FIRST, _LAST = r"(?Us)^.*?(?:\s+|[。！？]\s*)", r"(?Us)^.*(?:\s|[。！？])"
_HARD = r"(?s)^.+(?=\P{M})"

#: Intervals per block of the numbering of pieces.
NUMBERED = 4096
#: Most fields that limits are read for.
MAX_FIELDS = 1000


def grid_step(max_chars: Column, overlap: Column) -> Column:
    return F.floor((max_chars - overlap) / 2).cast("long")


def _latin(b: Column) -> Column:
    return F.decode(b, "ISO-8859-1")


def _leads(latin: Column) -> Column:
    """How many characters begin in these bytes."""
    return F.length(F.regexp_replace(latin, "[\u0080-¿]+", "")).cast("long")


def slices(ranges: DataFrame) -> DataFrame:
    """Adds to (key columns, step, r, left, core, right) the counts `n` of characters that begin in the core and `h`
    in the left halo, and `body`: the text from the first whole character of the halo on."""
    whole = F.regexp_replace(F.concat(_latin(F.col("left")), _latin(F.col("core")), _latin(F.col("right"))), "^[\u0080-¿]+", "")
    # the last character may be cut off; it lies in the halo
    body = F.when(F.octet_length("right") == AHEAD, F.regexp_replace(whole, "[À-ÿ][\u0080-¿]*$", "")).otherwise(whole)
    return ranges.select(
        *[c for c in ranges.columns if c not in ("left", "core", "right")],
        _leads(_latin(F.col("core"))).alias("n"),
        _leads(_latin(F.col("left"))).alias("h"),
        F.encode(body, "ISO-8859-1").cast("string").alias("body"),
    )


def text_ranges(items: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Byte ranges of the column `text` of (item, max_chars, overlap, text)."""
    most, overlap = F.col("max_chars").cast("long"), F.col("overlap").cast("long")
    data = F.encode(F.make_valid_utf8("text"), "UTF-8")
    df = items.select("item", most.alias("max_chars"), overlap.alias("overlap"), grid_step(most, overlap).alias("step"), data.alias("data"))
    halo = 4 * F.col("step") + 4
    lo = lambda r: r * range_bytes
    left_at = lambda r: F.greatest(lo(r) - halo, F.lit(0))
    sub = lambda a, n: F.substring(F.col("data"), (a + 1).cast("int"), n.cast("int"))
    parts = F.transform(
        F.sequence(F.lit(0).cast("long"), F.floor((F.octet_length("data") - 1) / range_bytes).cast("long")),
        lambda r: F.struct(
            r.alias("r"), sub(left_at(r), lo(r) - left_at(r)).alias("left"), sub(lo(r), F.lit(range_bytes)).alias("core"), sub(lo(r) + range_bytes, F.lit(AHEAD)).alias("right")
        ),
    )
    cut = df.select("item", "max_chars", "overlap", "step", F.explode_outer(parts).alias("p")).where("p IS NOT NULL")
    return cut.select("item", "max_chars", "overlap", "step", "p.*")


def file_ranges(spark: SparkSession, paths: DataFrame, max_chars: int, overlap: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Byte ranges of the UTF-8 files in column `path`, on a file system that pyarrow knows by the path or its URI; only the bytes of a range and
    its halos are read at a time."""
    step = (max_chars - overlap) // 2
    halo = 4 * step + 4

    def where(path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path)

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item": b["path"], "size": [f.get_file_info(p).size for f, p in map(where, b["path"])]})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for item, r in zip(b["item"], b["r"]):
                lo = r * range_bytes
                begin = max(0, lo - halo)
                system, name = where(item)
                with system.open_input_file(name) as f:
                    f.seek(begin)
                    got = f.read(lo - begin + range_bytes + AHEAD)
                yield pd.DataFrame([(item, r, got[: lo - begin], got[lo - begin : lo - begin + range_bytes], got[lo - begin + range_bytes :])], columns=["item", "r", "left", "core", "right"])

    known = paths.select("path").distinct().mapInPandas(sizes, "item string, size long").where("size > 0")
    each = known.select("item", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / range_bytes).cast("long"))).alias("r"))
    got = each.repartition("item", "r").mapInPandas(read, "item string, r long, left binary, core binary, right binary")
    return got.select("item", F.lit(max_chars).cast("long").alias("max_chars"), F.lit(overlap).cast("long").alias("overlap"), F.lit(step).cast("long").alias("step"), "r", "left", "core", "right")


def offsets(parts: DataFrame) -> DataFrame:
    """(item, r, off, total): the character offset of each range and the length of its item."""
    counts = parts.groupBy("item", F.floor(F.col("r") / BLOCK).cast("long").alias("block"), "r").agg(F.max("n").alias("n"))
    blocks = counts.groupBy("item", "block").agg(F.sum("n").alias("held"))
    by_item = W.partitionBy("item")
    before = F.sum("held").over(by_item.orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select("item", "block", F.coalesce(before, F.lit(0)).alias("base"), F.sum("held").over(by_item).alias("total"))
    inside = F.sum("n").over(W.partitionBy("item", "block").orderBy("r").rowsBetween(W.unboundedPreceding, -1))
    return counts.withColumn("inside", F.coalesce(inside, F.lit(0))).join(blocks, ["item", "block"]).select(
        "item", "r", (F.col("base") + F.col("inside")).alias("off"), "total"
    )


_KEYS = ["item", "max_chars", "overlap", "step", "total"]
_CUT = "struct<at:bigint,kind:string>"


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _boundary(text: Column, kinds: list[tuple[str, str]]) -> Column:
    """struct(len, kind): the length up to the best boundary in `text`, null if there is none."""

    def up_to(kind: str, pattern: str) -> Column:
        return _once(F.length(F.regexp_extract(text, pattern, 0)).cast("long"), lambda n: F.when(n > 0, F.struct(n.alias("len"), F.lit(kind).alias("kind"))))

    return F.coalesce(*[up_to(kind, p) for kind, p in kinds])


def _final() -> Column:
    """The number of the interval in which an item ends."""
    return F.greatest(F.floor((F.col("total") - 1 - F.col("overlap")) / F.col("step")), F.lit(0)).cast("long") + 1


def cut_table(placed: DataFrame) -> DataFrame:
    """(item, max_chars, overlap, step, total, k, at, kind, first, last): of each interval k the cut at its best boundary (kind none: the hard cut
    at its end; end: the end of the item), and its first and last boundary of any kind."""
    grid = lambda c: F.floor((c - F.col("overlap")) / F.col("step")).cast("long")
    stop = F.col("off") + F.col("n")
    first = F.greatest(grid(F.col("off")) + 1, F.lit(1).cast("long"))
    last = F.when(stop == F.col("total"), _final()).otherwise(F.least(grid(stop), _final() - 1))
    begin = lambda k: (k - 1) * F.col("step") + F.col("overlap")
    texts = F.transform(F.sequence(first, last), lambda k: F.struct(
        k.alias("k"), F.substring(F.col("body"), (begin(k) - F.col("off") + F.col("h") + 1).cast("int"), (F.least(F.col("step") + 1, F.col("total") - begin(k))).cast("int")).alias("text")))
    points = placed.where((last >= first) & (F.col("total") > F.col("max_chars"))).select(*_KEYS, F.explode_outer(texts).alias("p")).where("p IS NOT NULL").select(*_KEYS, "p.*").distinct()
    step = F.col("step").cast("int")
    inner, near = F.substring(F.col("text"), F.lit(1), step), F.floor(F.col("step") / 2).cast("int")
    late = _once(F.substring(inner, near + 1, step), lambda t: _boundary(t, BOUNDARIES))
    late = _once(late, lambda x: F.when(x.isNotNull(), F.struct((x["len"] + near).alias("len"), x["kind"].alias("kind"))))
    hard = _once(F.length(F.regexp_extract("text", _HARD, 0)).cast("long"), lambda n: F.when(n > 0, F.least(n, F.col("step"))).otherwise(F.col("step")))
    best = F.coalesce(late, _boundary(inner, BOUNDARIES), F.struct(hard.alias("len"), F.lit("none").alias("kind")))
    any_ = lambda p: _once(F.length(F.regexp_extract(inner, p, 0)).cast("long"), lambda n: F.when(n > 0, begin(F.col("k")) + n))
    found = points.select(*_KEYS, "k", best.alias("c"), any_(_FIRST).alias("first"), any_(_LAST).alias("last"))
    ends = F.col("k") == _final()
    return found.select(
        *_KEYS, "k", F.when(ends, F.col("total")).otherwise(begin(F.col("k")) + F.col("c.len")).alias("at"), F.when(ends, "end").otherwise(F.col("c.kind")).alias("kind"), "first", "last"
    )


def _beside(rows: DataFrame, value: Column, reach: dict[str, int]) -> DataFrame:
    """(keys, k, and each name in `reach`): the values of the rows so many intervals further on; `value` must not be null."""
    lent = rows.select(*_KEYS, F.explode(F.array(*[F.struct((F.col("k") - d).alias("k"), F.lit(d).alias("d")) for d in reach.values()])).alias("x"), value.alias("v"))
    return lent.groupBy(*_KEYS, F.col("x.k").alias("k")).agg(*[F.max(F.when(F.col("x.d") == d, F.col("v"))).alias(name) for name, d in reach.items()])


def stitch(cuts: DataFrame) -> DataFrame:
    """(item, k, j, start, end, kind): the pieces between the cuts that are needed; k and j put them in order."""
    room = F.col("max_chars") - F.col("overlap")
    one = lambda at, kind="word": F.struct(at.alias("at"), F.lit(kind).alias("kind"))
    rows = _beside(cuts, F.struct("at", "kind", "first", "last"), {"p": -1, "me": 0, "n": 1}).where("me IS NOT NULL")
    p_at = F.coalesce("p.at", F.col("overlap"))  # the first piece may be longer by the overlap
    b1, b2 = F.greatest(p_at, F.coalesce("p.last", p_at)), F.coalesce("n.first", "n.at")
    own = F.struct(F.col("me.at").alias("at"), F.col("me.kind").alias("kind"))
    natural = (F.coalesce("p.kind", F.lit("start")) != "none") & (F.col("n.kind") != "none")
    around = (
        F.when(F.col("n.at") - p_at <= room, F.array().cast(f"array<{_CUT}>")).when(b2 - p_at <= room, F.array(one(b2))).when(F.col("n.at") - b1 <= room, F.array(one(b1)))
        .when(b2 - b1 <= room, F.array(one(b1), one(b2))).otherwise(F.array(own))
    )
    rows = rows.select(*_KEYS, "k", F.when((F.col("me.kind") == "none") & natural, around).otherwise(F.array(own)).cast(f"array<{_CUT}>").alias("cuts"))

    rows = _beside(rows, F.col("cuts"), {"p": -1, "me": 0, "n": 1}).where("me IS NOT NULL")
    before = F.when(F.col("k") == 1, F.col("overlap")).otherwise(F.element_at("p", -1)["at"])
    fits = (F.col("k") % 2 == 1) & (F.size("me") == 1) & ((F.col("k") == 1) | (F.size("p") > 0)) & (F.size("n") > 0)
    dropped = F.when(fits, F.get("n", F.lit(0))["at"] - before <= room)
    rows = rows.select(*_KEYS, "k", F.when(F.coalesce(dropped, F.lit(False)), F.array().cast(f"array<{_CUT}>")).otherwise(F.col("me")).alias("cuts"))

    rows = _beside(rows, F.col("cuts"), {"pp": -2, "p": -1, "me": 0}).where("size(me) > 0")
    earlier = F.when(F.size("p") > 0, F.element_at("p", -1)["at"]).when(F.size("pp") > 0, F.element_at("pp", -1)["at"]).otherwise(F.col("overlap"))
    each = rows.select(*_KEYS, "k", earlier.alias("earlier"), "me", F.posexplode("me").alias("j", "c"))
    start = F.when(F.col("j") == 0, F.col("earlier")).otherwise(F.get("me", F.col("j") - 1)["at"]) - F.col("overlap")
    return each.select("item", "overlap", "step", "k", "j", F.greatest(start, F.lit(0)).alias("start"), F.col("c.at").alias("end"), F.col("c.kind").alias("kind"))


def piece_table(ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ranges with their place, and the pieces' bounds (item, overlap, step, k, j, start, end, kind); items within their limit have none."""
    parts = materialise(slices(ranges))
    placed = parts.join(offsets(parts.select("item", "r", "n")), ["item", "r"])
    return placed, stitch(cut_table(placed))


def pieces(ranges: DataFrame, whole: bool = False) -> DataFrame:
    """(item, piece_no, start_char, end_char, cut, text): the pieces of every oversized item, in order from 1; with `whole` also items within their
    limit, as one piece."""
    placed, bounds = piece_table(ranges)
    bounds = running(materialise(bounds), ["item"], [F.col("k"), F.col("j")], F.floor(F.col("k") / NUMBERED), F.lit(1).cast("long"), "sum", "before")
    if whole:
        small = placed.where("total <= max_chars").select("item", "overlap", "step", F.lit(1).cast("long").alias("k"), F.lit(0).alias("j"), F.lit(0).cast("long").alias("start"), F.col("total").alias("end"), F.lit("end").alias("kind"), F.lit(0).cast("long").alias("before"))
        bounds = bounds.unionByName(small.distinct())
    interval = lambda c: F.floor((c - F.col("overlap")) / F.col("step")).cast("long")
    stop = F.col("off") + F.col("n")
    begin = lambda q: F.greatest(q * F.col("step") + F.col("overlap"), F.col("off"))
    until = lambda q: F.least((q + 1) * F.col("step") + F.col("overlap"), stop)
    share = F.transform(F.sequence(interval(F.col("off")), interval(stop - 1)), lambda q: F.struct(
        q.alias("q"), begin(q).alias("from"), F.substring(F.col("body"), (begin(q) - F.col("off") + F.col("h") + 1).cast("int"), (until(q) - begin(q)).cast("int")).alias("part")))
    oversized_only = F.lit(True) if whole else F.col("total") > F.col("max_chars")
    shares = placed.where((F.col("n") > 0) & oversized_only).select("item", F.explode_outer(share).alias("s")).where("s IS NOT NULL").select("item", "s.*").distinct()
    wanted = bounds.select("item", "before", "start", "end", "kind", F.explode(F.sequence(interval(F.col("start")), interval(F.col("end") - 1))).alias("q"))
    begin_at, end_at = F.greatest("start", "from"), F.least(F.col("end"), F.col("from") + F.length("part"))
    got = wanted.join(shares, ["item", "q"]).where(end_at > begin_at).select(
        "item", "before", "start", "end", "kind", F.struct(begin_at.alias("at"), F.substring(F.col("part"), (begin_at - F.col("from") + 1).cast("int"), (end_at - begin_at).cast("int")).alias("t")).alias("rt")
    )
    whole_text = got.groupBy("item", "before", "start", "end", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list("rt")), lambda x: x["t"]), "").alias("text"))  # a piece is bounded
    return whole_text.select(
        "item", (F.coalesce("before", F.lit(0)) + 1).cast("int").alias("piece_no"), F.col("start").alias("start_char"), F.col("end").alias("end_char"), F.col("kind").alias("cut"), "text"
    )


def oversized(df: DataFrame, name: str, id_col: str, text_col: str, max_chars: Column, overlap: Column) -> DataFrame:
    """(item, max_chars, overlap, text) of the rows that can be over their limit: those with more bytes than characters allowed."""
    item = F.struct(F.lit(name).alias("table_name"), F.col(id_col).alias("item_id"), F.xxhash64(text_col).alias("h"))
    rows = df.select(item.alias("item"), max_chars.alias("max_chars"), overlap.alias("overlap"), F.col(text_col).alias("text"))
    return rows.where(F.octet_length("text") > F.col("max_chars"))


def limits(split_limits: DataFrame) -> dict[str, tuple[int, int]]:
    """Limit and overlap by field name; a handful of rows, one per field that is split."""
    out = {}
    rows = split_limits.select("field_name", "max_chars", "overlap_chars").limit(MAX_FIELDS + 1).collect()
    if len(rows) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} fields with limits")
    for r in rows:
        if r.max_chars is None or r.overlap_chars is None or r.overlap_chars < 0 or r.max_chars < r.overlap_chars + 2:
            raise ValueError(f"limit of {r.field_name}: max_chars must be larger than overlap_chars plus one")
        out[r.field_name] = (r.max_chars, r.overlap_chars)
    return out
