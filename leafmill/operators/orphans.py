"""References to parents that do not exist, kept incrementally.

State, in one folder: the parent index, a log of when a key's parents entered and left the catalogue; and the references: the settled ones,
those that hold, as a log, apart from the pending orphans with their reasons. All are split by the hash of the key into parts. `advance` takes a
batch of parent events and references:

1. new references probe the index;
2. arriving parents and retirements re-judge the pending orphans on their keys: an arrival resolves one, or turns it from missing into late;
3. they reopen settled references on their keys, but only those whose moment is not before the event: earlier ones cannot change.

The logs only grow by the batch. Of pending orphans, which are few, the parts that the batch touches are written anew; other parts are
neither read nor written. So a batch reads and writes in proportion to itself and to the parts its keys fall into. Any order and slicing of the
same input ends in the same state. `snapshot` counts the orphans per field and month after any batch.

A probe is a running count of parents over (kind, key) in time order. Keys of more than HOT_ROWS rows are spread: over buckets of time that
carry the count of the earlier ones, their width by the key's own density, and references within a bucket over salts.

Cases: null and blank keys are no references; a parent without `first_seen_at` never enters the catalogue
but its key is known; `retired_at` before `first_seen_at` is an empty stay; a reference without a moment
is an orphan only if its key is unknown, with a null period; repeated references count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.session import drop, materialise, private_folder

#: Parts of the state, and rows of a key from which on it is spread.
PARTS, HOT_ROWS = 256, 100_000
#: Buckets of a hot key are so many times finer than an even spread of HOT_ROWS rows would need.
FINER = 64

KEYS = ["kind", "ref_key"]
REF = ["note_id", "field_name", "kind", "ref_key", "moment"]
_EVENTS = "kind string, ref_key string, at long, delta long, seen long, part int, batch int"
_REFS = "note_id string, field_name string, kind string, ref_key string, moment long, reason string, part int, batch int, holds boolean"


def trimmed(key: Column) -> Column:
    """`key` without surrounding white space, null if nothing is left."""
    t = F.regexp_replace(key, r"(?U)^\s+|\s+$", "")
    return F.when(t != "", t)


def period(moment: Column) -> Column:
    """The month, YYYY-MM in UTC, of epoch milliseconds, whatever the session's time zone."""
    day = F.date_from_unix_date(F.floor(moment / F.lit(86_400_000)).cast("int"))
    return F.date_format(day, "yyyy-MM")


def parent_events(chunks: DataFrame) -> DataFrame:
    """(kind, ref_key, at, delta, seen): page and document keys entering (+1) and leaving (-1)."""
    keys = chunks.select(
        F.explode(F.array(
            F.struct(F.lit("page").alias("kind"), F.col("id").alias("ref_key")),
            F.struct(F.lit("doc").alias("kind"), F.col("doc").alias("ref_key")),
        )).alias("k"),
        F.col("first_seen_at").cast("long").alias("first"), F.col("retired_at").cast("long").alias("gone"),
    )
    stays = (F.col("gone").isNull() | (F.col("gone") > F.col("first"))) & F.col("first").isNotNull()
    enter = F.struct(F.coalesce("first", F.lit(0)).alias("at"), F.when(stays, 1).otherwise(0).cast("long").alias("delta"), F.col("first").alias("seen"))
    leave = F.struct(F.col("gone").alias("at"), F.lit(-1).cast("long").alias("delta"), F.lit(None).cast("long").alias("seen"))
    events = F.when(stays & F.col("gone").isNotNull(), F.array(enter, leave)).otherwise(F.array(enter))
    rows = keys.where("k.ref_key IS NOT NULL").select("k.*", F.explode(events).alias("e")).select("kind", "ref_key", "e.*")
    # many pages of a document enter together: one row per key and moment
    return rows.groupBy("kind", "ref_key", "at").agg(F.sum("delta").alias("delta"), F.max("seen").alias("seen"))


def references(notes: DataFrame) -> DataFrame:
    """(note_id, field_name, kind, ref_key, moment) of every reference of `notes`, once each."""
    one = lambda field, kind, key: F.struct(F.lit(field).alias("field_name"), F.lit(kind).alias("kind"), trimmed(key).alias("ref_key"))
    sealed = F.from_json(F.concat(F.lit('{"body":'), F.col("related"), F.lit(',"sealed":1}')), "body ARRAY<STRUCT<id: STRING>>, sealed INT", {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})
    items = F.when(sealed["sealed"] == 1, sealed["body"])
    refs = F.concat(
        F.array(one("chunk_id", "page", F.col("chunk_id")), one("doc", "doc", F.col("doc"))),
        F.coalesce(F.transform(items, lambda r: one("related", "page", r["id"])), F.array().cast("array<struct<field_name:string,kind:string,ref_key:string>>")),
    )
    return (
        notes.select(F.col("id").alias("note_id"), F.coalesce("created_at", F.col("ts") * 1000).cast("long").alias("moment"), F.explode_outer(refs).alias("r"))
        .select("note_id", "r.*", "moment")
        .where("ref_key IS NOT NULL")
        .distinct()
    )


def _swept(rows: DataFrame, within: list[str], kept: list[str]) -> DataFrame:
    """References (the columns `kept`) with the number of parents `live` at their moment, the last arrival on their key, and whether the key is
    known. `rows` have step 0 (carried from earlier), 1 (a parent event) or 2 (a reference); those without a moment come first."""
    so_far = W.partitionBy(*within).orderBy("at", "step").rowsBetween(W.unboundedPreceding, 0)
    all_ = W.partitionBy(*within)
    return rows.select(
        *kept, "step", F.sum("delta").over(so_far).alias("live"), F.max("seen").over(all_).alias("last_seen"), F.max(F.col("step") < 2).over(all_).alias("known")
    ).where("step = 2")


def _spread(rows: DataFrame, sizes: DataFrame, hot_rows: int, kept: list[str]) -> DataFrame:
    """`_swept` of hot keys, in buckets of time and salts."""
    fine = F.greatest(F.lit(1), F.floor((F.col("hi") - F.col("lo") + 1) * hot_rows / (FINER * F.col("n")))).cast("long")
    rows = rows.join(sizes.select(*KEYS, "lo", fine.alias("width")), KEYS)
    rows = rows.withColumn("bucket", F.coalesce(F.floor((F.col("at") - F.col("lo")) / F.col("width")), F.lit(-1))).drop("lo", "width")
    asks = F.col("step") == 2
    held = rows.groupBy(*KEYS, "bucket").agg(F.sum("delta").alias("net"), F.max("seen").alias("seen"), F.max(~asks).alias("known"), F.count_if(asks).alias("asked"))
    by_key = W.partitionBy(*KEYS)
    before = by_key.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    salts = F.ceil(F.col("asked") / hot_rows).cast("int")
    carried = held.select(
        *KEYS, "bucket", salts.alias("salts"), F.coalesce(F.sum("net").over(before), F.lit(0)).cast("long").alias("delta"),
        F.max("seen").over(by_key).alias("seen"), F.max("known").over(by_key).alias("known_key"),
    ).where("salts > 0")
    every = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    # a bucket of an unknown key is given no row of step 0
    first = every(carried.where("known_key").select(*KEYS, "bucket", "salts", "delta", "seen", F.lit(-(2**63)).alias("at"), F.lit(0).alias("step")))
    placed = rows.join(carried.select(*KEYS, "bucket", "salts"), [*KEYS, "bucket"])
    events = every(placed.where(~asks))
    asked = placed.where(asks).withColumn("salt", F.pmod(F.xxhash64("note_id", "field_name", "moment"), F.col("salts")).cast("int")).drop("salts")
    return _swept(asked.unionByName(events).unionByName(first, allowMissingColumns=True), [*KEYS, "bucket", "salt"], kept)


def judge(refs: DataFrame, events: DataFrame, hot_rows: int = HOT_ROWS, most: int | None = None) -> DataFrame:
    """`refs` with their `reason` (missing, late, deleted, or null if the reference holds). `most` is how many rows both have together at most, if
    known: without a key of more than `hot_rows` none needs to be looked for."""
    kept = refs.columns
    asked = refs.select("*", F.col("moment").alias("at"), F.lit(0).cast("long").alias("delta"), F.lit(None).cast("long").alias("seen"), F.lit(2).alias("step"))
    rows = asked.unionByName(events.select(*KEYS, "at", "delta", "seen", F.lit(1).alias("step")), allowMissingColumns=True)
    hot = False
    if most is None or most > hot_rows:
        rows = materialise(rows)
        sizes = materialise(rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")).where(F.col("n") > hot_rows))
        hot = sizes.count() > 0
    swept = _swept(rows.join(sizes, KEYS, "left_anti") if hot else rows, KEYS, kept)
    if hot:
        swept = swept.unionByName(_spread(rows, sizes, hot_rows, kept))
    reason = (
        F.when(~F.coalesce("known", F.lit(False)), "missing").when(F.col("moment").isNull() | (F.col("live") > 0), F.lit(None).cast("string"))
        .when(F.col("last_seen") > F.col("moment"), "late").otherwise("deleted")
    )
    return swept.select(*kept, reason.alias("reason"))


@dataclass(frozen=True)
class OrphanState:
    """What is known after the batches so far: a folder, the number of batches and of parent events, and the batch that wrote each part of the
    pending orphans last."""

    spark: SparkSession
    folder: str
    batch: int
    n_events: int
    pending: dict[int, int]

    def events(self, parts: list[int]) -> DataFrame:
        log = self.spark.read.schema(_EVENTS).parquet(f"{self.folder}/events")
        return log.where((F.col("batch") <= self.batch) & F.col("part").isin(parts)).drop("batch")

    def settled(self, parts: list[int]) -> DataFrame:
        return self._refs().where(F.col("holds") & (F.col("batch") <= self.batch) & F.col("part").isin(parts))

    def orphans(self, parts: list[int] | None = None) -> DataFrame:
        """The pending orphans, of all or some parts."""
        newest: dict[int, list[int]] = {}
        for part, batch in self.pending.items():
            if parts is None or part in parts:
                newest.setdefault(batch, []).append(part)
        mine = F.lit(False)
        for batch, held in newest.items():
            mine = mine | ((F.col("batch") == batch) & F.col("part").isin(held))
        return self._refs().where(~F.col("holds") & mine)

    def _refs(self) -> DataFrame:
        return self.spark.read.schema(_REFS).parquet(f"{self.folder}/refs")


def _write(rows: DataFrame, folder: str, name: str, batch: int, *split: str) -> None:
    """A batch of a table, in order of its parts, so that readers of some parts skip the others' row groups; a part of many rows is written by
    several tasks."""
    rows.hint("rebalance", "part").sortWithinPartitions("part").write.mode("overwrite").partitionBy(*split).parquet(f"{folder}/{name}/batch={batch}")


def advance(state: OrphanState | None, events: DataFrame, refs: DataFrame, hot_rows: int = HOT_ROWS) -> OrphanState:
    """The state after one more batch of parent events and references."""
    spark = events.sparkSession
    part = F.pmod(F.xxhash64(*KEYS), F.lit(PARTS)).cast("int").alias("part")
    old = state or OrphanState(spark, private_folder(spark), 0, 0, {})
    number = old.batch + 1
    _write(events.select(*KEYS, "at", "delta", "seen", part), old.folder, "events", number)
    came = spark.read.schema(_EVENTS).parquet(f"{old.folder}/events").where(F.col("batch") == number)
    changed, since, n_events = came.agg(F.collect_set("part"), F.min("at"), F.count("*")).first()
    touched = came.groupBy(*KEYS).agg(F.min("at").alias("since"))
    asked = refs.select(*REF, part, F.lit(False).alias("held"))
    if state and changed:
        waiting = old.orphans(changed).join(touched, KEYS, "left_semi").select(*REF, "part", F.lit(False).alias("held"))
        reopened = old.settled(changed).where(F.col("moment") >= since).join(touched, KEYS).where("moment >= since").select(*REF, "part", F.lit(True).alias("held"))
        asked = asked.unionByName(waiting).unionByName(reopened)
    asked = materialise(asked.groupBy(*REF, "part").agg(F.max("held").alias("held")))
    parts, n_asked = asked.agg(F.collect_set("part"), F.count("*")).first()
    now = OrphanState(spark, old.folder, number, old.n_events + n_events, old.pending | dict.fromkeys([*parts, *changed], number))
    index = now.events(parts).join(asked.select(*KEYS).distinct(), KEYS, "left_semi")
    judged = judge(asked, index, hot_rows, n_asked + now.n_events)
    # what was settled and still holds stands in the log already
    rows = judged.where("reason IS NOT NULL OR NOT held").select(*REF, "reason", F.col("reason").isNull().alias("holds"), "part")
    if state:
        kept = old.orphans([*parts, *changed]).select(rows.columns)
        rows = rows.unionByName(kept.join(touched, KEYS, "left_anti") if changed else kept).distinct()
    _write(rows, old.folder, "refs", number, "holds")
    drop(asked)
    return now


def orphans(state: OrphanState) -> DataFrame:
    """(note_id, field_name, ref_key, reason, period): one row per reference that does not hold."""
    return state.orphans().select("note_id", "field_name", "ref_key", "reason", period(F.col("moment")).alias("period"))


def snapshot(state: OrphanState) -> DataFrame:
    """(field_name, period, reason, n_refs): orphans per field and month."""
    return orphans(state).groupBy("field_name", "period", "reason").agg(F.count("*").alias("n_refs"))


def states(chunks: DataFrame, notes: DataFrame, slices: int = 3, cuts: list[int] | None = None) -> Iterator[OrphanState]:
    """The state after each batch, both tables being fed in slices of time, cut at the moments `cuts` (epoch ms), or into `slices` of equal length
    between the first and the last reference."""
    events, refs = materialise(parent_events(chunks)), materialise(references(notes))
    if cuts is None:
        lo, hi = refs.agg(F.min("moment"), F.max("moment")).first()
        cuts = [] if lo is None else [lo + (hi - lo) * k // slices for k in range(1, slices)]
    state = None
    edges = [None, *sorted(cuts), None]
    for lo, hi in zip(edges, edges[1:]):
        state = advance(state, _between(events, "at", lo, hi), _between(refs, "moment", lo, hi))
        yield state
    drop(events, refs)


def replay(chunks: DataFrame, notes: DataFrame, slices: int = 3, cuts: list[int] | None = None) -> OrphanState:
    """The state after the last of `states`."""
    return list(states(chunks, notes, slices, cuts))[-1]


def snapshots(chunks: DataFrame, notes: DataFrame, slices: int = 3, cuts: list[int] | None = None) -> DataFrame:
    """(batch, field_name, period, reason, n_refs): the snapshot taken after each batch."""
    out = None
    for state in states(chunks, notes, slices, cuts):
        one = snapshot(state).select(F.lit(state.batch).alias("batch"), "field_name", "period", "reason", "n_refs")
        out = one if out is None else out.unionByName(one)
    return out


def _between(df: DataFrame, col: str, lo: int | None, hi: int | None) -> DataFrame:
    """Rows from `lo` up to, not including, `hi`; rows without a moment belong to the first slice."""
    if lo is None and hi is None:
        return df
    first = F.col(col).isNull() if lo is None else F.lit(False)
    inside = F.lit(True) if lo is None else F.col(col) >= lo
    return df.where(first | (inside if hi is None else inside & (F.col(col) < hi)))
