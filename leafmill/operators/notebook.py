"""The notebook as tables: outcomes of single changes, views, references, merges of two stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions.text import tokens
from leafmill.operators.changefeed import one_object, read_changes
from leafmill.operators.running import running

BUCKET_ROWS = 50_000


def change_outcomes(changes: DataFrame) -> DataFrame:
    """(note_id, seq, version, is_delete, outcome) of changes applied one by one in order of `seq` to an empty store.

    An upsert is `stale_deleted` if the newest earlier change is a deletion of at least its version, `stale` if it is an
    upsert of a higher version; a deletion is `stale` below a newer upsert; all others are `applied`. What decides is the maximum of (version,
    is_delete) over the earlier changes, taken in buckets of `seq`, so a note with a third of all changes is no single task."""
    top = F.struct("version", "is_delete")
    with_top = running(changes.select("note_id", "seq", "version", "is_delete"), ["note_id"], [F.col("seq")], F.floor(F.col("seq") / BUCKET_ROWS), top, "max", "top")
    newer = F.col("top.version") > F.col("version")
    gone = (F.col("top.is_delete") == 1) & (F.col("top.version") >= F.col("version"))
    kept = (F.col("top.is_delete") == 0) & newer
    outcome = F.when((F.col("is_delete") == 0) & gone, "stale_deleted").when(kept, "stale").otherwise("applied")
    return with_top.select("note_id", "seq", "version", "is_delete", outcome.alias("outcome"))


def created_at(changes: DataFrame) -> DataFrame:
    """(note_id, seq, lineage, first_seq): applied upserts, the lineage they belong to (a new one begins after each applied deletion), and
    the change that began it."""
    applied = change_outcomes(changes).where("outcome = 'applied'")
    bucket = F.floor(F.col("seq") / BUCKET_ROWS)
    numbered = running(applied, ["note_id"], [F.col("seq")], bucket, F.col("is_delete").cast("long"), "sum", "lineage").where("is_delete = 0")
    numbered = numbered.select("note_id", "seq", F.coalesce("lineage", F.lit(0)).alias("lineage"))
    first = numbered.groupBy("note_id", "lineage").agg(F.min("seq").alias("first_seq"))
    return numbered.join(first, ["note_id", "lineage"])


def sync_merge(remote_notes: DataFrame, remote_gone: DataFrame, local: DataFrame) -> DataFrame:
    """(note_id, version, origin, deleted) after pulling a remote store into a local one.

    `local` is (note_id, version, is_delete, pending). A note with pending local edits is left alone. Otherwise the remote note
    stands only if strictly newer, a remote deletion if at least as new. Deleted and unknown notes drop out as `deleted`."""
    far = remote_notes.select("note_id", F.col("version").alias("far_version")).groupBy("note_id").agg(F.max("far_version").alias("far_version"))
    gone = remote_gone.select("note_id", F.col("version").alias("gone_version")).groupBy("note_id").agg(F.max("gone_version").alias("gone_version"))
    near = local.select("note_id", F.col("version").alias("near_version"), (F.col("is_delete") == 1).alias("near_gone"), "pending")
    both = near.join(far, "note_id", "full").join(gone, "note_id", "full")
    waits = F.coalesce("pending", F.lit(False))
    base = F.coalesce("near_version", F.lit(-(2**63)))
    takes = ~waits & F.col("far_version").isNotNull() & (F.col("far_version") > base)
    held = F.when(takes, F.col("far_version")).otherwise(F.col("near_version"))
    ends = ~waits & F.col("gone_version").isNotNull() & (F.col("gone_version") >= F.coalesce(held, F.lit(-(2**63))))
    deleted = F.when(ends, True).when(takes, False).otherwise(F.coalesce("near_gone", F.lit(True)))
    version = F.when(ends, F.col("gone_version")).otherwise(held)
    origin = F.when(ends | takes, "remote").otherwise("local")
    return both.select("note_id", version.alias("version"), origin.alias("origin"), deleted.alias("deleted"))


# The group of each mode of note; other modes belong to the last.
GROUPS = {"highlight": "highlights", "note": "mine", "research": "research", "simplify": "research", "ask": "research", "web": "research"}


def note_group(mode: Column) -> Column:
    out = F.lit("research")
    for m, g in GROUPS.items():
        out = F.when(mode == m, g).otherwise(out)
    return out


def view(notes: DataFrame, session: Column | None = None, group: str = "all", words: Column | None = None) -> DataFrame:
    """Notes of a session (none given: of all), of a group, in which all `words` (an array of tokens) occur in selection, answer or comment."""
    if session is not None:
        notes = notes.where(F.coalesce(F.col("session") == session, F.lit(False)))
    if group != "all":
        notes = notes.where(note_group(F.col("mode")) == group)
    if words is not None:
        notes = notes.where(F.size(F.array_except(words, tokens(F.concat_ws(" ", "selection", "answer", "comment")))) == 0)
    return notes


def related_pages(notes: DataFrame) -> DataFrame:
    """(doc_short, page): the distinct pages that notes refer to, their own and those in `related`; notes of mode web are left out."""
    items = F.coalesce(one_array(F.col("related"), "docShort STRING, page INT"), F.array().cast("array<struct<docShort:string,page:int>>"))
    own = F.struct(F.col("doc_short").alias("docShort"), F.col("page"))
    each = notes.where("mode IS NULL OR mode <> 'web'").select(F.explode(F.concat(F.array(own), items)).alias("r"))
    return each.where("r.docShort IS NOT NULL AND r.page IS NOT NULL").select(F.col("r.docShort").alias("doc_short"), "r.page").distinct()


def one_array(text: Column, fields: str) -> Column:
    """`text` parsed as one complete JSON array of objects, else null."""
    sealed = F.from_json(F.concat(F.lit('{"body":'), text, F.lit(',"sealed":1}')), f"body ARRAY<STRUCT<{', '.join(f.strip().replace(' ', ': ', 1) for f in fields.split(','))}>>, sealed INT", {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})
    return F.when(sealed["sealed"] == 1, sealed["body"])


def newest_change(feed: DataFrame) -> DataFrame:
    """One row per note: its newest change in the feed; ties as in the fold."""
    return read_changes(feed).groupBy("note_id").agg(F.max(F.struct("version", "is_delete", "seq")).alias("m")).select("note_id", "m.*")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key; partial limits are taken before the shuffle."""
    return df.withColumn("_first", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_first = 1").drop("_first")


__all__ = ["change_outcomes", "created_at", "first_by", "newest_change", "one_array", "one_object", "related_pages", "sync_merge", "view"]
