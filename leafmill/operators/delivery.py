"""Exactly one copy of every message that was delivered at least once.

Phase 1 shuffles only the identifier, the delivery order and the position (file, row) of each row and selects one winner per identifier; the
positions of the other rows become per-file deletion vectors: sets of CHUNK bits over the row index. Phase 2 reads the wide
rows where they lie and drops the marked ones with a broadcast of bit sets, so payloads are never shuffled.

A broadcast holds MAX_BITSETS bit sets at most. Beyond that, files fall into groups by the hash of their path, and rows of very large
files into parts; each group reads only its own files, which Spark prunes by path. Nothing about single files comes to the driver: only
the number of groups, and of parts in each. `write_one_row_per_message` takes one group after the other, for tables of many groups.

A hot identifier costs nothing extra: both aggregations combine on the map side. Positions need a file-backed Parquet table; a file is known by
two 64-bit hashes of its path.

Cases: a null identifier is no identifier, its rows are all kept; an empty string is an identifier like
any other; a null order comes after all others; rows that tie in order are told apart by position, one
stays; an empty table yields an empty result; further columns, of any name, pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import materialise

#: Rows of a bit set, and bit sets broadcast at once: each is 64 longs and its key, so a broadcast stays below about 45 MB.
CHUNK, MAX_BITSETS = 4096, 65_536


def message_key(identifier: Column) -> Column:
    """Identifiers are equal without regard to case and hyphens."""
    return F.lower(F.replace(identifier, F.lit("-"), F.lit("")))


def _file() -> list[Column]:
    path = F.col("_metadata.file_path")
    return [F.xxhash64(path), F.xxhash64(F.lit(1), path)]


def deletion_vectors(spark: SparkSession, path: str, identifier: str, order: str) -> DataFrame:
    """(dv_file, dv_twin, dv_chunk, dv_bits): bit b of word w of a chunk marks row CHUNK*chunk + 64*w + b of the file as surplus."""
    file, twin = _file()
    narrow = spark.read.parquet(path).select(
        message_key(F.col(identifier)).alias("key"), F.col(order).alias("order"), file.alias("file"), twin.alias("twin"), F.col("_metadata.row_index").alias("row")
    ).where("key IS NOT NULL")
    winners = narrow.groupBy("key").agg(F.min(F.struct(F.col("order").isNull(), "order", "file", "twin", "row")).alias("w"))
    # every identified row once, every winner once more: what is left of the exclusive or is surplus
    both = narrow.select("file", "twin", "row").unionByName(winners.select("w.file", "w.twin", "w.row"))
    words = both.groupBy("file", "twin", F.shiftright("row", 6).alias("word")).agg(F.expr("bit_xor(shiftleft(1L, cast(row & 63 AS int)))").alias("bits")).where("bits <> 0")
    per = CHUNK // 64
    chunks = words.groupBy("file", "twin", F.floor(F.col("word") / per).alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("word") % per, "bits"))).alias("m"))  # as many as a chunk has words
    bits = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(per - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    return chunks.select(F.col("file").alias("dv_file"), F.col("twin").alias("dv_twin"), F.col("chunk").alias("dv_chunk"), bits.alias("dv_bits"))


def _grouping(vectors: DataFrame, most: int) -> tuple[int, int, dict[int, int]]:
    """How many groups files fall into, the chunks of a part, and the number of parts of each group with marks, so that no part of a group has
    more than `most` bit sets."""
    groups, part = 1, max(1, most // 2)
    while True:
        load = vectors.groupBy(F.pmod("dv_file", F.lit(groups)).alias("g"), F.floor(F.col("dv_chunk") / part).alias("p")).agg(F.count("*").alias("n"))
        worst = load.agg(F.max("n")).first()[0] or 0
        if worst <= most:
            return groups, part, {r.g: r.p + 1 for r in load.groupBy("g").agg(F.max("p").alias("p")).collect()}
        groups = max(groups * 2, -(-worst // most))


def _branches(spark: SparkSession, path: str, vectors: DataFrame, surplus: bool, most: int) -> Iterator[DataFrame]:
    """The wide rows without the marked ones (`surplus` False), or only the marked ones, group by group."""
    scan = spark.read.parquet(path)
    columns = scan.columns
    p = "dv"
    while any(c.lower().startswith(p) for c in columns):  # the table may have columns of these names
        p += "_"
    groups, part, parts = _grouping(vectors, most)
    row = F.col("_metadata.row_index")
    file, twin = _file()
    marks = vectors.select(*[F.col(f"dv_{c}").alias(f"{p}_{c}") for c in ("file", "twin", "chunk", "bits")])
    keys = [f"{p}_{c}" for c in ("file", "twin", "chunk")]
    hit = F.get(F.col(f"{p}_bits"), F.col(f"{p}_word")).bitwiseAND(F.col(f"{p}_bit")) != 0
    for g in range(groups):
        if surplus and g not in parts:
            continue
        mine = scan if groups == 1 else scan.where(F.pmod(file, F.lit(groups)) == g)
        theirs = marks if groups == 1 else marks.where(F.pmod(f"{p}_file", F.lit(groups)) == g)
        last = parts.get(g, 1) - 1
        for k in range(last + 1):
            within = F.lit(True) if not last else F.floor(row / (CHUNK * part)) == k if k < last else F.floor(row / (CHUNK * part)) >= k
            at = mine.where(within).select(
                "*", file.alias(keys[0]), twin.alias(keys[1]), F.floor(row / CHUNK).alias(keys[2]), F.expr("cast((_metadata.row_index >> 6) & 63 AS int)").alias(f"{p}_word"),
                F.expr("shiftleft(1L, cast(_metadata.row_index & 63 AS int))").alias(f"{p}_bit"),
            )
            side = F.broadcast(theirs if not last else theirs.where(F.floor(F.col(keys[2]) / part) == k))
            joined = at.join(side, keys, "inner" if surplus else "left")
            yield joined.where(hit if surplus else ~F.coalesce(hit, F.lit(False))).select(*[F.col(f"`{c}`") for c in columns])


def apply_deletion_vectors(spark: SparkSession, path: str, vectors: DataFrame, surplus: bool, most: int = MAX_BITSETS) -> DataFrame:
    """The wide rows of `path` without the marked ones, or only the marked ones (`surplus`); `vectors` is read more than once."""
    out = None
    for rows in _branches(spark, path, vectors, surplus, most):
        out = rows if out is None else out.unionByName(rows)
    return spark.read.parquet(path).limit(0) if out is None else out


def surplus_rows(spark: SparkSession, path: str, identifier: str, order: str, most: int = MAX_BITSETS) -> DataFrame:
    """All rows that repeat a message already kept."""
    return apply_deletion_vectors(spark, path, materialise(deletion_vectors(spark, path, identifier, order)), True, most)


def one_row_per_message(spark: SparkSession, path: str, identifier: str, order: str, most: int = MAX_BITSETS) -> DataFrame:
    """The table with exactly one row per message and all rows without an identifier."""
    return apply_deletion_vectors(spark, path, materialise(deletion_vectors(spark, path, identifier, order)), False, most)


def write_one_row_per_message(spark: SparkSession, path: str, identifier: str, order: str, out: str, most: int = MAX_BITSETS) -> None:
    """Write `one_row_per_message` to the Parquet table `out`, which must not exist, group by group: one broadcast is held at a time."""
    spark.read.parquet(path).limit(0).write.parquet(out)
    for rows in _branches(spark, path, materialise(deletion_vectors(spark, path, identifier, order)), False, most):
        rows.write.mode("append").parquet(out)
