"""Rebuilding the current state of a keyed table from a feed of upserts and deletions.

The state of a key is the maximum of struct(version, is_delete, seq[, payload]) over all its rows, base
rows included. The maximum is commutative, associative and idempotent, so order, repetition and batching
of the feed do not matter, and a state table folds with later batches by the same maximum. Deletions stay
in the state, so that a late upsert cannot bring a deleted row back. A hot key is combined on the map
side before the shuffle.

Cases: a change needs a key and a version, others are left out; base rows with a null version lose
against every versioned change; base rows with a null key are left out; ties and repeated rows fold to
one; empty feed or base tables fold to the other side; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.delivery import message_key
from leafmill.session import materialise

BASE_SEQ = -(2**63)  # base rows come before any row of the feed
NO_VERSION = -(2**63)

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def one_object(payload: Column, fields: str) -> Column:
    """`payload` parsed with the DDL `fields` if it is one complete JSON object, else null.

    The text is put into an envelope with a closing sentinel: unfinished text, text after the object and
    a second object all break the envelope, which the plain parser would accept.
    """
    envelope = F.concat(F.lit('{"body":'), payload, F.lit(',"sealed":1}'))
    parsed = F.from_json(envelope, f"body STRUCT<{fields}>, sealed INT", _STRICT)
    return F.when(parsed["sealed"] == 1, parsed["body"])


def _whole(raw: Column, payload: Column, name: str) -> Column:
    """A JSON number, or a string of digits, as a long; null for anything else."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), f"$.{name}", "variant"))
    return F.when(raw.rlike("^[0-9]+$"), raw.try_cast("long")).when(
        raw.isNotNull() & (kind != "STRING"), raw.try_cast("decimal(38,9)").try_cast("long")
    )


def read_messages(feed: DataFrame, wide: bool = False) -> DataFrame:
    """(msg, seq, note_id, version, is_delete[, payload]) of the readable messages in `feed`, with or without a version; a repeated
    message counts once, at its lowest seq."""
    kind = F.lower(F.regexp_replace("type", r"(?U)^\s+|\s+$", ""))
    body = one_object(F.col("payload"), "id: STRING, updated_at: STRING, ts: STRING")
    parsed = (
        feed.select(
            F.coalesce(message_key(F.col("event_id")), F.concat(F.lit("\x00"), F.col("seq").cast("string"))).alias("msg"),
            F.col("seq"),
            (kind == "note.deleted").cast("int").alias("is_delete"),
            body.alias("b"),
            F.col("payload"),
        )
        .where(kind.isin("note.upserted", "note.deleted") & F.col("b.id").isNotNull())
        .select(
            "msg",
            "seq",
            F.col("b.id").alias("note_id"),
            F.coalesce(_whole(F.col("b.updated_at"), F.col("payload"), "updated_at"), _whole(F.col("b.ts"), F.col("payload"), "ts") * 1000).alias("version"),
            "is_delete",
            *(["payload"] if wide else []),
        )
    )
    return lowest(parsed)


def lowest(messages: DataFrame) -> DataFrame:
    """Each message once, at its lowest seq."""
    rest = [c for c in ("note_id", "version", "is_delete", "payload") if c in messages.columns]
    return messages.groupBy("msg").agg(F.min(F.struct("seq", *rest)).alias("m")).select("msg", "m.*")


def read_changes(feed: DataFrame, wide: bool = False) -> DataFrame:
    """(seq, note_id, version, is_delete[, payload]) of the readable changes in `feed`; a repeated message
    counts once, at its lowest seq."""
    return read_messages(feed, wide).drop("msg").where("version IS NOT NULL")


def base_rows(notes: DataFrame, tombstones: DataFrame, payload: Column | None = None) -> DataFrame:
    """The store's notes and deletions in the form of changes that come before the feed."""
    live = notes.select(
        F.col("id").alias("note_id"),
        F.coalesce("updated_at", F.col("ts") * 1000, F.lit(NO_VERSION)).cast("long").alias("version"),
        F.lit(0).alias("is_delete"),
        F.lit(BASE_SEQ).alias("seq"),
        *([payload.alias("payload")] if payload is not None else []),
    )
    gone = tombstones.select(
        F.col("id").alias("note_id"),
        F.coalesce("updated_at", F.lit(NO_VERSION)).cast("long").alias("version"),
        F.lit(1).alias("is_delete"),
        F.lit(BASE_SEQ).alias("seq"),
        *([F.lit(None).cast("string").alias("payload")] if payload is not None else []),
    )
    return live.unionByName(gone).where("note_id IS NOT NULL")


def fold(*parts: DataFrame) -> DataFrame:
    """The state of each key over all `parts`, which are changes, base rows or earlier states."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    carried = [c for c in ("payload",) if c in rows.columns]
    top = F.max(F.struct("version", "is_delete", "seq", *carried)).alias("top")
    return rows.groupBy("note_id").agg(top).select("note_id", "top.*")


def current_state(notes: DataFrame, tombstones: DataFrame, feed: DataFrame) -> DataFrame:
    """(note_id, version, is_delete, seq): the deciding row of every note; seq is BASE_SEQ for base rows."""
    return fold(base_rows(notes, tombstones), read_changes(feed))


NOTE_FIELDS = "id STRING, doc STRING, page INT, mode STRING, selection STRING, session STRING, status STRING"


def current_notebook(notes: DataFrame, tombstones: DataFrame, feed: DataFrame) -> DataFrame:
    """The live notes after the feed, with their contents; `decided_by` is the seq of the deciding row, null
    where the stored note stands. What stands is decided without contents; those of the deciding rows only are read then, by seq or by note."""
    cols = [c.split()[0] for c in NOTE_FIELDS.split(",")]
    live = materialise(current_state(notes, tombstones, feed).where("is_delete = 0"))
    changed = live.where(F.col("seq") != BASE_SEQ).join(feed.select("seq", "payload"), "seq").select("note_id", "version", F.col("seq").alias("decided_by"), F.from_json("payload", NOTE_FIELDS).alias("b"))
    stored = notes.select(F.col("id").alias("note_id"), F.coalesce("updated_at", F.col("ts") * 1000, F.lit(NO_VERSION)).cast("long").alias("version"), F.struct(*cols).alias("b"))
    same = live.where(F.col("seq") == BASE_SEQ).select("note_id", "version").join(stored, ["note_id", "version"]).groupBy("note_id", "version").agg(F.max("b").alias("b"))
    kept = same.select("note_id", F.when(F.col("version") != NO_VERSION, F.col("version")).alias("version"), F.lit(None).cast("long").alias("decided_by"), *[F.col(f"b.{c}").cast(t).alias(c) for c, t in (x.split() for x in NOTE_FIELDS.split(",")) if c != "id"])
    return changed.select("note_id", "version", "decided_by", *[f"b.{c}" for c in cols if c != "id"]).unionByName(kept)
