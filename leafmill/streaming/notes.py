"""The change feed as a stream: repeated messages dropped, unreadable ones set aside, the notebook's state and a log of its changes kept as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.changefeed import fold, lowest, one_object, read_messages
from leafmill.operators.delivery import message_key
from leafmill.session import drop, materialise

#: Parts of the tables, by the hash of a message or a note.
PARTS = 256

_STATE = "note_id string, version long, is_delete int, seq long, part int, batch long"
_MESSAGES = "msg string, seq long, note_id string, version long, is_delete int, part int, batch long"
_CHANGES = "msg string, seq long, note_id string, version long, is_delete int, sign int, part int, batch long"


def once(stream: DataFrame, identifier: str, at: str, kept: str | None = None) -> DataFrame:
    """The stream without repeated messages; rows without an identifier are no repeats of each other. All identifiers are remembered, however
    late a row is; with `kept` only for so long in event time, and rows later than that are dropped."""
    marked = stream.withColumn("message_key", message_key(F.col(identifier)))
    if kept:
        marked = marked.withWatermark(at, kept)
    named, unnamed = marked.where("message_key IS NOT NULL"), marked.where("message_key IS NULL")
    first = named.dropDuplicatesWithinWatermark(["message_key"]) if kept else named.dropDuplicates(["message_key"])
    return first.unionByName(unnamed).drop("message_key")


def readable(payload: str = "payload") -> Column:
    """Whether a row's payload is one complete JSON object."""
    return F.coalesce(one_object(F.col(payload), "id: STRING").isNotNull(), F.lit(False))


def _part(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("part")


def _log(spark: SparkSession, folder: str, name: str, schema: str, before: int) -> DataFrame | None:
    """The batches of a table below `before`, null if there is no table."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(schema).parquet(f"{folder}/{name}").where(F.col("batch") < before)


def _write(rows: DataFrame, folder: str, name: str, number: int) -> None:
    """A batch of a table in order of its parts, so that readers of some parts skip the others' row groups."""
    rows.hint("rebalance", "part").sortWithinPartitions("part").write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")


def _newest(states: DataFrame) -> DataFrame:
    top = F.max(F.struct("batch", "version", "is_delete", "seq")).alias("m")
    return states.groupBy("note_id").agg(top).select("note_id", "m.version", "m.is_delete", "m.seq").where("seq IS NOT NULL")


def start(spark: SparkSession, folder: str, state: DataFrame) -> None:
    """Begin from a snapshot (note_id, version, is_delete, seq), to which the feed's batches are then applied."""
    _write(state.select("note_id", "version", "is_delete", "seq", _part("note_id")), folder, "state", 0)


def apply_batch(spark: SparkSession, folder: str, dead: str | None = None, most_attempts: int = 5) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that folds a batch of the feed into the tables in `folder`, and writes rows that cannot be read or were tried
    too often to `dead`. A batch that is run again overwrites what it wrote; nothing of earlier batches is written anew.

    - messages: each message with its lowest seq so far. A copy in a later batch counts only if its seq is lower; it then displaces the former one.
    - changes: what was accepted, and with sign -1 what was displaced.
    - state: the new state of every note that the batch touches: the maximum of the old state and the accepted changes. Only a note from which a change was
      displaced is folded again from its changes and the snapshot.
    - log: one event per note whose state the batch changed.
    """

    def run(batch: DataFrame, number: int) -> None:
        n = number + 1
        new = materialise(read_messages(batch).select("msg", "seq", "note_id", "version", "is_delete", _part("msg")))
        known = _log(spark, folder, "messages", _MESSAGES, n)
        accepted, displaced = new, None
        if known is not None:
            parts = [r.part for r in new.select("part").distinct().collect()]  # PARTS at most
            old = lowest(known.where(F.col("part").isin(parts)).join(new.select("msg"), "msg", "left_semi"))
            met = materialise(new.join(old.select("msg", *[F.col(c).alias(f"old_{c}") for c in ("seq", "note_id", "version", "is_delete")]), "msg", "left").where("old_seq IS NULL OR seq < old_seq"))
            accepted = met.select(new.columns)
            displaced = met.where("old_seq IS NOT NULL").select("msg", *[F.col(f"old_{c}").alias(c) for c in ("seq", "note_id", "version", "is_delete")])
        _write(accepted, folder, "messages", n)
        signed = accepted.drop("part").withColumn("sign", F.lit(1))
        if displaced is not None:
            signed = signed.unionByName(displaced.withColumn("sign", F.lit(-1)))
        _write(signed.where("version IS NOT NULL").select("*", _part("note_id")), folder, "changes", n)

        mine = spark.read.schema(_CHANGES).parquet(f"{folder}/changes").where(F.col("batch") == n)
        touched = mine.groupBy("note_id", "part").agg(F.min("sign").alias("least"))
        parts = [r.part for r in touched.select("part").distinct().collect()]
        states = _log(spark, folder, "state", _STATE, n)
        before = None if states is None else materialise(_newest(states.where(F.col("part").isin(parts)).join(touched.select("note_id"), "note_id", "left_semi")))
        rows = mine.where("sign = 1").select("note_id", "version", "is_delete", "seq")
        if before is not None:
            again = touched.where("least < 0").select("note_id")
            rows = rows.unionByName(before.join(again, "note_id", "left_anti"))
            if not again.isEmpty():
                every = spark.read.schema(_CHANGES).parquet(f"{folder}/changes").where((F.col("batch") <= n) & F.col("part").isin(parts)).join(again, "note_id", "left_semi")
                held = every.groupBy("note_id", "version", "is_delete", "seq", "msg").agg(F.sum("sign").alias("n")).where("n > 0").select("note_id", "version", "is_delete", "seq")
                first = states.where((F.col("batch") == 0) & F.col("part").isin(parts)).join(again, "note_id", "left_semi").select("note_id", "version", "is_delete", "seq")
                rows = rows.join(again, "note_id", "left_anti").unionByName(before.join(again, "note_id", "left_anti")).unionByName(held).unionByName(first)
        now = materialise(fold(rows))
        # a note whose only changes were displaced by copies for other notes has no state any more
        none = touched.join(now, "note_id", "left_anti").select("note_id", *[F.lit(None).cast(t).alias(c) for c, t in (("version", "long"), ("is_delete", "int"), ("seq", "long"))])
        _write(now.unionByName(none).select("*", _part("note_id")), folder, "state", n)
        changed = now if before is None else now.join(before, ["note_id", "version", "is_delete", "seq"], "left_anti")
        kind = F.when(F.col("is_delete") == 1, "note.deleted").otherwise("note.upserted")
        changed.select("note_id", kind.alias("type"), "version", "seq").write.mode("overwrite").parquet(f"{folder}/log/batch={n}")
        drop(new, now, *([before] if before is not None else []))
        if dead:
            bad = batch.where(~readable() | (F.coalesce("attempts", F.lit(0)) >= most_attempts))
            bad.write.mode("overwrite").parquet(f"{dead}/batch={n}")

    return run


def latest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The state of every note after the batches so far."""
    states = _log(spark, folder, "state", _STATE, 2**62)
    return None if states is None else _newest(states)
