"""Queries of the general record operators: orphan references, change feed, repeated messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import changefeed, delivery, orphans
from leafmill.plans.registry import Registry
from leafmill.session import table, table_path

GENERAL = Registry()

_REFS_SQL = r"""
WITH n AS (SELECT id, doc, chunk_id, coalesce(created_at, ts * 1000) AS m,
                  CASE WHEN json_valid(related) AND json_type(related) = 'ARRAY' THEN related ELSE '[]' END AS rel FROM notes),
raw AS (
  SELECT id AS note_id, 'chunk_id' AS field_name, chunk_id AS k, m FROM n
  UNION ALL SELECT id, 'doc', doc, m FROM n
  UNION ALL SELECT id, 'related', unnest(from_json(rel, '["JSON"]'))->>'$.id', m FROM n),
refs AS (SELECT DISTINCT note_id, field_name, regexp_replace(k, '^\s+|\s+$', '', 'g') AS ref_key, m FROM raw
         WHERE regexp_replace(k, '^\s+|\s+$', '', 'g') <> ''),
parents AS (SELECT 'page' AS kind, id AS k, first_seen_at AS f, retired_at AS g FROM chunks
            UNION ALL SELECT 'doc', doc, first_seen_at, retired_at FROM chunks),
found AS (
  SELECT r.note_id, r.field_name, r.ref_key, r.m,
         count(p.k) AS n_rows,
         coalesce(bool_or(p.f <= r.m AND (p.g IS NULL OR r.m < p.g)), false) AS holds,
         coalesce(max(p.f) > r.m, false) AS later
  FROM refs r LEFT JOIN parents p
    ON p.k = r.ref_key AND p.kind = CASE WHEN r.field_name = 'doc' THEN 'doc' ELSE 'page' END
  GROUP BY r.note_id, r.field_name, r.ref_key, r.m),
orphan AS (
  SELECT note_id, field_name, ref_key,
         CASE WHEN n_rows = 0 THEN 'missing' WHEN later THEN 'late' ELSE 'deleted' END AS reason,
         strftime(make_timestamp(m * 1000), '%Y-%m') AS period
  FROM found WHERE NOT holds)
"""


@GENERAL.query("p1_found", _REFS_SQL + "SELECT * FROM orphan")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphans(orphans.replay(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "notes")))


@GENERAL.query("p1_snapshot", _REFS_SQL + "SELECT field_name, period, reason, count(*) AS n_refs FROM orphan GROUP BY ALL")
def p1_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.snapshot(orphans.replay(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "notes")))


def _snapshots_sql(slices: int = 3) -> str:
    """The orphans of the references before each cut, by the arrivals and retirements before it; the last batch has no cut."""
    dated = _REFS_SQL.rstrip()
    seen = dated.replace("refs AS (SELECT", "refs0 AS (SELECT").replace(
        "parents AS (",
        f"""lim AS (SELECT min(m) AS lo, max(m) AS hi FROM refs0),
    cut AS (SELECT k::INT AS batch, CASE WHEN k < {slices} THEN lo + (hi - lo) * k // {slices} END AS c FROM lim, generate_series(1, {slices}) AS g(k)),
    refs AS (SELECT refs0.*, batch, c FROM refs0, cut WHERE c IS NULL OR m IS NULL OR m < c),
    parents AS (""",
    )
    seen = seen.replace("SELECT r.note_id, r.field_name", "SELECT r.batch, r.note_id, r.field_name").replace("GROUP BY r.note_id", "GROUP BY r.batch, r.note_id").replace("SELECT note_id, field_name, ref_key,\n         CASE", "SELECT batch, note_id, field_name, ref_key,\n         CASE")
    seen = seen.replace("ON p.k = r.ref_key AND", "ON p.k = r.ref_key AND (r.c IS NULL OR coalesce(p.f, 0) < r.c) AND")
    return seen.replace("(p.g IS NULL OR r.m < p.g)", "(p.g IS NULL OR p.g >= coalesce(r.c, p.g + 1) OR r.m < p.g)") + " SELECT batch, field_name, period, reason, count(*) AS n_refs FROM orphan GROUP BY ALL"


@GENERAL.query("p1_snapshots", _snapshots_sql())
def p1_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of orphans after each of the three batches."""
    return orphans.snapshots(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "notes"))


_STATE_SQL = r"""
WITH parsed AS (
  SELECT seq, lower(regexp_replace(type, '^\s+|\s+$', '', 'g')) AS kind,
         coalesce(lower(replace(event_id, '-', '')), '#' || seq) AS msg,
         CASE WHEN json_valid(payload) THEN payload END AS j FROM outbox),
ops AS (
  SELECT msg, seq, j->>'$.id' AS note_id, (kind = 'note.deleted')::INT AS is_delete,
         coalesce(CASE WHEN json_type(j, '$.updated_at') IN ('UBIGINT', 'BIGINT', 'DOUBLE') OR regexp_full_match(j->>'$.updated_at', '[0-9]+')
                       THEN try_cast(j->>'$.updated_at' AS BIGINT) END,
                  CASE WHEN json_type(j, '$.ts') IN ('UBIGINT', 'BIGINT', 'DOUBLE') OR regexp_full_match(j->>'$.ts', '[0-9]+')
                       THEN try_cast(j->>'$.ts' AS BIGINT) END * 1000) AS version, j
  FROM parsed WHERE kind IN ('note.upserted', 'note.deleted') AND json_type(j) = 'OBJECT' AND j->>'$.id' IS NOT NULL),
once AS (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY msg ORDER BY seq) = 1),
every AS (
  SELECT note_id, version, is_delete, seq, j FROM once WHERE version IS NOT NULL
  UNION ALL SELECT id, coalesce(updated_at, ts * 1000), 0, NULL,
    to_json({'id': id, 'doc': doc, 'page': page, 'mode': mode, 'selection': selection, 'session': session, 'status': status}) FROM notes
  UNION ALL SELECT id, updated_at, 1, NULL, NULL FROM tombstones),
top AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY version DESC, is_delete DESC, seq DESC NULLS LAST) = 1)
"""


@GENERAL.query("p3_found", _STATE_SQL + "SELECT note_id, seq, CASE WHEN is_delete = 1 THEN 'delete' ELSE 'upsert' END AS final_op FROM top WHERE seq IS NOT NULL")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = changefeed.current_state(*[table(spark, sf_dir, t) for t in ("notes", "tombstones", "outbox")])
    return state.where(F.col("seq") != changefeed.BASE_SEQ).select(
        "note_id", "seq", F.when(F.col("is_delete") == 1, "delete").otherwise("upsert").alias("final_op")
    )


@GENERAL.query(
    "p3_notebook",
    _STATE_SQL
    + """SELECT note_id, version, seq AS decided_by, j->>'$.doc' AS doc, (j->>'$.page')::INT AS page, j->>'$.mode' AS mode,
         j->>'$.selection' AS selection, j->>'$.session' AS session, j->>'$.status' AS status FROM top WHERE is_delete = 0""",
)
def p3_notebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.current_notebook(*[table(spark, sf_dir, t) for t in ("notes", "tombstones", "outbox")])


#: (table, identifier, delivery order) of the two tables of messages.
MESSAGES = [("outbox", "event_id", "seq"), ("deliveries", "id", "delivery_id")]

_SURPLUS_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS src, {o} AS row_key FROM (SELECT {o}, row_number() OVER (PARTITION BY lower(replace({i}, '-', '')) ORDER BY {o}) AS rn FROM {t} WHERE {i} IS NOT NULL) WHERE rn > 1"
    for t, i, o in MESSAGES
)


@GENERAL.query("p4_found", _SURPLUS_SQL)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        delivery.surplus_rows(spark, table_path(sf_dir, t), i, o).select(F.lit(t).alias("src"), F.col(o).alias("row_key"))
        for t, i, o in MESSAGES
    ]
    return parts[0].unionByName(parts[1])


def _kept_sql(t: str, i: str, o: str) -> str:
    return f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY lower(replace({i}, '-', '')) ORDER BY {o}) AS rn FROM {t}) WHERE rn = 1 OR {i} IS NULL"


for _t, _i, _o in MESSAGES:
    GENERAL.query(f"p4_{_t}_once", _kept_sql(_t, _i, _o))(
        lambda spark, sf_dir, t=_t, i=_i, o=_o: delivery.one_row_per_message(spark, table_path(sf_dir, t), i, o)
    )
