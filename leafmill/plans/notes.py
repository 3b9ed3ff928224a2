"""Queries over notes, changes, web references, deliveries and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import answers, changefeed, insights, notebook, retrieval, telemetry, web
from leafmill.operators.running import running
from leafmill.plans.general import _STATE_SQL
from leafmill.plans.reading import kept_index, sql_excerpt, sql_squash, sql_tokens
from leafmill.plans.registry import Registry
from leafmill.session import table

NOTES = Registry()

_ONCE_SQL = _STATE_SQL.split("every AS (")[0].rstrip().removesuffix(",")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes, each once."""
    return table(spark, sf_dir, "notes").dropDuplicates(["id"])


_OUTCOME_SQL = (
    _ONCE_SQL
    + """, top AS (SELECT note_id, seq, version, is_delete, max({'v': version, 'd': is_delete}) OVER (PARTITION BY note_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
         FROM once WHERE version IS NOT NULL),
    outcome AS (SELECT note_id, seq, version, is_delete, CASE WHEN is_delete = 0 AND m.d = 1 AND m.v >= version THEN 'stale_deleted' WHEN m.d = 0 AND m.v > version THEN 'stale' ELSE 'applied' END AS outcome FROM top)
    """
)


@NOTES.query("change_outcomes", _OUTCOME_SQL + "SELECT * FROM outcome")
def change_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notebook.change_outcomes(changefeed.read_changes(table(spark, sf_dir, "outbox")))


@NOTES.query(
    "note_lineages",
    _OUTCOME_SQL
    + """, lin AS (SELECT note_id, seq, is_delete, coalesce(sum(is_delete) OVER (PARTITION BY note_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lineage FROM outcome WHERE outcome = 'applied')
    SELECT note_id, seq, lineage, min(seq) OVER (PARTITION BY note_id, lineage) AS first_seq FROM lin WHERE is_delete = 0""",
)
def note_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notebook.created_at(changefeed.read_changes(table(spark, sf_dir, "outbox")))


@NOTES.query("sessions", "SELECT session, count(*) AS n_notes, count_if(mode = 'highlight') AS highlights, count_if(mode = 'web') AS web, count_if(coalesce(comment, '') <> '') AS commented FROM (SELECT DISTINCT * FROM notes) WHERE session <> '' GROUP BY session")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _stored(spark, sf_dir).where("session <> ''")
    return kept.groupBy("session").agg(
        F.count("*").alias("n_notes"), F.count_if(F.col("mode") == "highlight").alias("highlights"), F.count_if(F.col("mode") == "web").alias("web"), F.count_if(F.coalesce("comment", F.lit("")) != "").alias("commented")
    )


@NOTES.query(
    "latest_notes",
    "SELECT id, session, coalesce(updated_at, ts * 1000) AS version, row_number() OVER (PARTITION BY session ORDER BY coalesce(updated_at, ts * 1000) DESC, id) AS rank FROM (SELECT DISTINCT * FROM notes) QUALIFY rank <= 500",
)
def latest_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 500 notes of every session, the limit of a listing."""
    rows = _stored(spark, sf_dir).select("id", "session", F.coalesce("updated_at", F.col("ts") * 1000).alias("version"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("session").orderBy(F.desc("version"), "id"))).where("rank <= 500")


@NOTES.query(
    "progress",
    """WITH seen AS (SELECT session, doc, max(page) - 1 AS furthest FROM (SELECT DISTINCT session, trim(doc, ' ' || chr(9)) AS doc, page FROM notes) WHERE doc <> '' GROUP BY ALL),
    size AS (SELECT doc, count(*) AS pages FROM chunks GROUP BY doc)
    SELECT session, doc, furthest, least(100, floor((furthest + 1) / pages * 100 + 0.5))::INT AS percent FROM seen JOIN size USING (doc)""",
)
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "notes").select("session", F.btrim("doc", F.lit(" \t")).alias("doc"), "page").where("doc <> ''").groupBy("session", "doc").agg((F.max("page") - 1).alias("furthest"))
    size = table(spark, sf_dir, "chunks").groupBy("doc").agg(F.count("*").alias("pages"))
    percent = F.least(F.lit(100), F.floor((F.col("furthest") + 1) / F.col("pages") * 100 + 0.5)).cast("int")
    return seen.join(size, "doc").select("session", "doc", "furthest", percent.alias("percent"))


@NOTES.query(
    "referenced_pages",
    """WITH r AS (SELECT doc_short, page FROM notes WHERE mode IS NULL OR mode <> 'web'
      UNION SELECT x->>'$.docShort', (x->>'$.page')::INT FROM (SELECT unnest(from_json(CASE WHEN json_valid(related) AND json_type(related) = 'ARRAY' THEN related ELSE '[]' END, '["JSON"]')) AS x FROM notes WHERE mode IS NULL OR mode <> 'web'))
    SELECT DISTINCT doc_short, page FROM r WHERE doc_short IS NOT NULL AND page IS NOT NULL""",
)
def referenced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notebook.related_pages(table(spark, sf_dir, "notes"))


_ASKED_SQL = f"""asked AS (SELECT DISTINCT request_id AS query, unnest({sql_tokens('selection')}) AS term FROM generate_requests WHERE regexp_extract(request_id, '(\\d+)$', 1)::BIGINT % 20 = 0)"""


@NOTES.query(
    "notes_search",
    f"""WITH {_ASKED_SQL},
    n AS (SELECT id, {sql_tokens("concat_ws(' ', selection, answer, comment, session)")} AS t FROM (SELECT DISTINCT * FROM notes)),
    post AS (SELECT id, term, len, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM n) GROUP BY ALL),
    scored AS (SELECT query, id, sum(tf / (1 + sqrt(len))) AS score FROM asked JOIN post USING (term) GROUP BY ALL)
    SELECT query, id AS note_id, round_even(score, 3) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM scored QUALIFY rank <= 10""",
)
def notes_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best notes for the selection of every request whose number is divisible by 20."""
    stated = table(spark, sf_dir, "generate_requests").where(F.regexp_extract("request_id", r"(\d+)$", 1).try_cast("long") % 20 == 0)
    asked = retrieval.query_terms(stated, "request_id", "selection")
    scored = retrieval.note_scores(_stored(spark, sf_dir), "id", F.concat_ws(" ", "selection", "answer", "comment", "session"), asked)
    return retrieval.best(scored, 10).select("query", F.col("page").alias("note_id"), F.bround("score", 3).alias("score"), "rank")


@NOTES.query(
    "sync_merge",
    _ONCE_SQL
    + """, local AS (SELECT note_id, arg_max({'v': version, 'd': is_delete, 's': seq}, {'v': version, 'd': is_delete, 's': seq}) AS m FROM once WHERE version IS NOT NULL GROUP BY note_id),
    pend AS (SELECT DISTINCT o.note_id FROM once o JOIN outbox x USING (seq) WHERE x.published_at IS NULL AND o.version IS NOT NULL),
    near AS (SELECT l.note_id, m.v AS v, m.d = 1 AS gone, p.note_id IS NOT NULL AS pending FROM local l LEFT JOIN pend p USING (note_id)),
    far AS (SELECT id AS note_id, max(coalesce(updated_at, ts * 1000)) AS fv FROM notes GROUP BY id), ton AS (SELECT id AS note_id, max(updated_at) AS gv FROM tombstones GROUP BY id),
    al AS (SELECT note_id, v, gone, coalesce(pending, false) AS pending, fv, gv FROM near FULL JOIN far USING (note_id) FULL JOIN ton USING (note_id)),
    t AS (SELECT *, NOT pending AND fv IS NOT NULL AND (v IS NULL OR fv > v) AS takes FROM al),
    e AS (SELECT *, NOT pending AND gv IS NOT NULL AND gv >= coalesce(CASE WHEN takes THEN fv ELSE v END, gv) AS ends FROM t)
    SELECT note_id, CASE WHEN ends THEN gv WHEN takes THEN fv ELSE v END AS version, CASE WHEN ends OR takes THEN 'remote' ELSE 'local' END AS origin,
           CASE WHEN ends THEN true WHEN takes THEN false ELSE coalesce(gone, true) END AS deleted FROM e""",
)
def sync_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's notes and tombstones pulled into a client that holds the outcome of the feed; changes not yet published are pending."""
    feed = table(spark, sf_dir, "outbox")
    local = notebook.newest_change(feed)
    changes = changefeed.read_changes(feed)
    open_ = feed.where("published_at IS NULL").select("seq").join(changes, "seq").select("note_id", F.lit(True).alias("pending")).distinct()
    local = local.join(open_, "note_id", "left").withColumn("pending", F.coalesce("pending", F.lit(False)))
    notes = table(spark, sf_dir, "notes").select(F.col("id").alias("note_id"), F.coalesce("updated_at", F.col("ts") * 1000).alias("version"))
    gone = table(spark, sf_dir, "tombstones").select(F.col("id").alias("note_id"), F.col("updated_at").alias("version"))
    return notebook.sync_merge(notes, gone, local)


@NOTES.query("outbox_backlog", "SELECT topic, lower(trim(type)) AS kind, count(*) AS n_rows, count_if(published_at IS NULL) AS unpublished, min(seq) FILTER (published_at IS NULL) AS oldest, max(attempts) AS most_attempts FROM outbox GROUP BY ALL")
def outbox_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    waits = F.col("published_at").isNull()
    return table(spark, sf_dir, "outbox").groupBy("topic", F.lower(F.trim("type")).alias("kind")).agg(
        F.count("*").alias("n_rows"), F.count_if(waits).alias("unpublished"), F.min(F.when(waits, F.col("seq"))).alias("oldest"), F.max("attempts").alias("most_attempts")
    )


@NOTES.query(
    "dead_letters",
    "SELECT topic, CASE WHEN NOT coalesce(CASE WHEN json_valid(data) THEN json_type(data) = 'OBJECT' END, false) THEN 'malformed' WHEN attempts >= 5 THEN 'exhausted' WHEN attempts > 0 THEN 'retried' ELSE 'delivered' END AS fate, error, count(*) AS n_rows, sum(CASE WHEN attempts > 0 THEN 0.5 * (2 ** attempts - 1) ELSE 0 END) AS waited_s FROM deliveries GROUP BY ALL",
)
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fate of all deliveries by topic and error, with the time that doubling waits between attempts have taken."""
    ok = changefeed.one_object(F.col("data"), "id: STRING").isNotNull()
    fate = F.when(~ok, "malformed").when(F.col("attempts") >= 5, "exhausted").when(F.col("attempts") > 0, "retried").otherwise("delivered")
    waited = F.when(F.col("attempts") > 0, 0.5 * (F.pow(F.lit(2.0), F.col("attempts")) - 1)).otherwise(0.0)
    return table(spark, sf_dir, "deliveries").groupBy("topic", fate.alias("fate"), "error").agg(F.count("*").alias("n_rows"), F.sum(waited).alias("waited_s"))


@NOTES.query(
    "traces",
    "SELECT batch_id, count(*) AS n_rows, count(DISTINCT CASE WHEN regexp_matches(traceparent, '^[0-9a-f]{2}-[0-9a-f]{32}-[0-9a-f]{16}-[0-9a-f]{2}$') AND substr(traceparent, 4, 32) <> repeat('0', 32) AND substr(traceparent, 37, 16) <> repeat('0', 16) THEN substr(traceparent, 4, 32) END) AS n_traces FROM deliveries GROUP BY batch_id",
)
def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "deliveries").groupBy("batch_id").agg(F.count("*").alias("n_rows"), F.countDistinct(T.trace_parts(F.col("traceparent"))["trace_id"]).alias("n_traces"))


@NOTES.query("request_keys", f"SELECT request_id, substr(sha256(mode || chr(31) || coalesce({sql_squash('lower(selection)')}, '') || chr(31) || coalesce(doc_short, '') || chr(31) || coalesce(page::VARCHAR, '') || chr(31) || web::VARCHAR), 1, 40) AS cache_key FROM generate_requests WHERE mode IS NOT NULL AND web IS NOT NULL")
def request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "generate_requests").where("mode IS NOT NULL AND web IS NOT NULL")
    return rows.select("request_id", T.cache_key(F.col("mode"), T.squash(F.lower("selection")), F.col("doc_short"), F.col("page"), F.col("web")).alias("cache_key"))


def _web_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The web references of all notes as results of the note's document: a query per document, a provider per mode of note."""
    notes = _stored(spark, sf_dir).select(F.col("doc_short").alias("query"), "id", notebook.one_array(F.col("web"), "title STRING, url STRING").alias("w"))
    number = F.pmod(F.length("id"), F.lit(2))
    return notes.select("query", "id", number.alias("provider_no"), F.posexplode_outer("w").alias("pos", "r")).where("pos IS NOT NULL").select("query", "id", "provider_no", "pos", "r.title", "r.url")


_TIER_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(
        [f"h = '{e}'" for e in exact] + [f"h = '{d}' OR ends_with(h, '.{d}')" for d in domains] + [f"ends_with(h, '{s}')" for s in suffixes] + [f"contains(h, '{i}')" for i in infixes]
    ) + f" THEN {{'t': {tier}, 'l': '{label}'}}"
    for tier, label, exact, domains, suffixes, infixes in T.TIERS
) + f" ELSE {{'t': {T.OTHER_TIER[0]}, 'l': '{T.OTHER_TIER[1]}'}} END"


@NOTES.query(
    "web_sources",
    rf"""WITH r AS (SELECT unnest(from_json(CASE WHEN json_valid(web) AND json_type(web) = 'ARRAY' THEN web ELSE '[]' END, '["JSON"]'))->>'$.url' AS u FROM (SELECT DISTINCT * FROM notes)),
    p AS (SELECT regexp_extract(u, '^(https?)://([^/?#]+)([^?#]*)(\?[^#]*)?', ['s', 'a', 'p', 'q']) AS x FROM r),
    n AS (SELECT x.s || '://' || lower(x.a) || CASE WHEN x.p = '' THEN '/' ELSE x.p END || x.q AS url, regexp_replace(lower(x.a), '^www\.', '') AS h FROM p WHERE x.a <> '')
    SELECT url, h AS domain, ({_TIER_SQL}).t AS tier, ({_TIER_SQL}).l AS tier_label, count(*) AS n_refs FROM n GROUP BY ALL""",
)
def web_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = T.normalise_url(F.col("url"))
    rows = _web_results(spark, sf_dir).select(url.alias("url")).where("url IS NOT NULL").groupBy("url").agg(F.count("*").alias("n_refs"))
    host = T.url_host(F.col("url"))
    return rows.select("url", host.alias("domain"), T.source_tier(host).alias("t"), "n_refs").select("url", "domain", "t.tier", "t.tier_label", "n_refs")


@NOTES.query(
    "web_ranked",
    rf"""WITH r0 AS (SELECT id, doc_short AS query, length(id) % 2 AS provider_no, from_json(CASE WHEN json_valid(web) AND json_type(web) = 'ARRAY' THEN web ELSE '[]' END, '["JSON"]') AS l FROM (SELECT DISTINCT * FROM notes)),
    r AS (SELECT id, query, provider_no, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM r0),
    b AS (SELECT query, provider_no, row_number() OVER (PARTITION BY query, provider_no ORDER BY id, i) - 1 AS pos, x->>'$.title' AS title, x->>'$.url' AS u FROM r),
    p AS (SELECT *, regexp_extract(u, '^(https?)://([^/?#]+)([^?#]*)(\?[^#]*)?', ['s', 'a', 'p', 'q']) AS y FROM b),
    n AS (SELECT query, provider_no, pos, pos + 0.5 * provider_no AS place, title, y.s || '://' || lower(y.a) || CASE WHEN y.p = '' THEN '/' ELSE y.p END || y.q AS url, regexp_replace(lower(y.a), '^www\.', '') AS h FROM p WHERE y.a <> ''),
    f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query, url ORDER BY provider_no, pos, place, title) = 1)
    SELECT query, row_number() OVER (PARTITION BY query ORDER BY ({_TIER_SQL}).t, place, provider_no, pos) AS rank, url, h AS domain, ({_TIER_SQL}).t AS tier, ({_TIER_SQL}).l AS tier_label,
      CASE WHEN {sql_excerpt("title", 200)} <> '' THEN {sql_excerpt("title", 200)} ELSE h END AS title FROM f QUALIFY rank <= 8""",
)
def web_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best web references per document; ties within a batch are settled by note."""
    rows = _web_results(spark, sf_dir)
    order = F.row_number().over(W.partitionBy("query", "provider_no").orderBy("id", "pos"))
    return web.ranked(rows.withColumn("pos", order - 1))


@NOTES.query(
    "event_error_ratios",
    "SELECT event_type = 'error' OR event_type = 'click' AS page_event, time_bucket(INTERVAL '5 minutes', ts) AS window_start, count(*) AS n_events, count_if(event_type = 'error') AS n_errors, count_if(event_type = 'error') / count(*) AS ratio FROM events GROUP BY 1, 2",
)
def event_error_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("page_event", F.col("event_type").isin("error", "click"))
    return telemetry.error_ratios(rows, "ts", F.col("event_type") == "error", "5 minutes", ["page_event"])


@NOTES.query(
    "burning_windows",
    """WITH s AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS w, count(*) AS n, count_if(event_type = 'error') / count(*) AS ratio FROM events GROUP BY 1),
    l AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS w, count_if(event_type = 'error') / count(*) AS ratio FROM events GROUP BY 1)
    SELECT s.w AS window_start, s.n AS n_events, s.ratio, l.ratio AS long_ratio FROM s JOIN l ON date_trunc('hour', s.w) = l.w WHERE s.ratio > 14.4 * 0.02 AND l.ratio > 14.4 * 0.02""",
)
def burning_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    got = telemetry.burning(telemetry.error_ratios(events, "ts", failed, "5 minutes", []), telemetry.error_ratios(events, "ts", failed, "1 hour", []), [], 0.02)
    return got.select("window_start", "n_events", "ratio", "long_ratio")


_LE = "[" + ", ".join(str(b) for b in telemetry.BUCKETS) + "]"


@NOTES.query(
    "value_buckets",
    f"""WITH b AS (SELECT event_type, len(list_filter({_LE}, lambda x: x < value)) AS b FROM events WHERE value IS NOT NULL), i AS (SELECT unnest(generate_series(0, {len(telemetry.BUCKETS)})) AS k),
    types AS (SELECT event_type, min(b) AS lo FROM b GROUP BY 1)
    SELECT t.event_type, i.k::INT AS b, (SELECT count(*) FROM b WHERE b.event_type = t.event_type AND b.b <= i.k) AS n FROM types t, i WHERE i.k >= t.lo""",
)
def value_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.bucket_counts(table(spark, sf_dir, "events"), F.col("value"), ["event_type"])


@NOTES.query(
    "value_p95",
    f"""WITH b AS (SELECT event_type, len(list_filter({_LE}, lambda x: x < value)) AS b FROM events WHERE value IS NOT NULL), n AS (SELECT event_type, b, count(*) AS n FROM b GROUP BY ALL),
    c AS (SELECT event_type, b, n, sum(n) OVER (PARTITION BY event_type ORDER BY b) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM n),
    h AS (SELECT event_type, arg_min({{'b': b, 'n': n, 'upto': upto, 'total': total}}, b) AS h FROM c WHERE upto >= 0.95 * total GROUP BY event_type)
    SELECT event_type, CASE WHEN h.b >= {len(telemetry.BUCKETS)} THEN {telemetry.BUCKETS[-1]} ELSE ([0.0] || {_LE})[h.b + 1] + ({_LE}[h.b + 1] - ([0.0] || {_LE})[h.b + 1]) * (0.95 * h.total - (h.upto - h.n)) / h.n END::DOUBLE AS value FROM h""",
)
def value_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile read off the buckets."""
    return telemetry.quantile(telemetry.bucket_counts(table(spark, sf_dir, "events"), F.col("value"), ["event_type"]), 0.95, ["event_type"])


@NOTES.query("outbox_scan", "SELECT seq, event_id, topic, attempts FROM outbox WHERE published_at IS NULL ORDER BY seq LIMIT 100")
def outbox_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next hundred rows to publish, in order: the batch of a relay."""
    return table(spark, sf_dir, "outbox").where("published_at IS NULL").select("seq", "event_id", "topic", "attempts").orderBy("seq").limit(100)


@NOTES.query(
    "outbox_retained",
    "SELECT topic, published_at IS NULL AS waiting, count(*) AS n_rows, min(seq) AS first_seq FROM outbox WHERE published_at IS NULL OR published_at >= (SELECT max(published_at) FROM outbox) - 7 * 86400 GROUP BY ALL",
)
def outbox_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after published rows older than seven days are purged."""
    rows = table(spark, sf_dir, "outbox")
    newest = rows.agg(F.max("published_at")).first()[0]
    waiting = F.col("published_at").isNull()
    kept = rows if newest is None else rows.where(waiting | (F.col("published_at") >= newest - 7 * 86400))
    return kept.groupBy("topic", waiting.alias("waiting")).agg(F.count("*").alias("n_rows"), F.min("seq").alias("first_seq"))


@NOTES.query(
    "outbox_in_flight",
    """WITH e AS (SELECT topic, seq, created_at AS t, 1 AS d, 0 AS o FROM outbox WHERE published_at IS NOT NULL UNION ALL SELECT topic, seq, published_at, -1, -1 FROM outbox WHERE published_at IS NOT NULL),
    r AS (SELECT topic, seq, d, sum(d) OVER (PARTITION BY topic ORDER BY t, o, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM e)
    SELECT topic, seq, coalesce(n, 0)::BIGINT AS ahead FROM r WHERE d = 1""",
)
def outbox_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of the topic were under way when each row was created; a topic is a long key, so the count runs in buckets of minutes."""
    rows = table(spark, sf_dir, "outbox").where("published_at IS NOT NULL")
    one = lambda at, d: F.struct(F.col(at).alias("at"), F.lit(d).cast("long").alias("d"), F.lit(min(d, 0)).alias("o"))
    events = rows.select("topic", "seq", F.explode(F.array(one("created_at", 1), one("published_at", -1))).alias("e")).select("topic", "seq", "e.*")
    counted = running(events, ["topic"], [F.col("at"), F.col("o"), F.col("seq")], F.floor(F.col("at") / 60), F.col("d"), "sum", "n")
    return counted.where("d = 1").select("topic", "seq", F.coalesce("n", F.lit(0)).alias("ahead"))


@NOTES.query(
    "note_projection",
    _ONCE_SQL + """ SELECT note_id, version, is_delete, seq FROM once WHERE version IS NOT NULL QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY version DESC, seq DESC) = 1""",
)
def note_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The read model: lower versions are ignored, equal ones applied, so the last arrival of the highest version stands, upsert or not."""
    changes = changefeed.read_changes(table(spark, sf_dir, "outbox"))
    return changes.groupBy("note_id").agg(F.max(F.struct("version", "seq", "is_delete")).alias("m")).select("note_id", "m.version", "m.is_delete", "m.seq")


@NOTES.query(
    "search_merge",
    f"""WITH {_ASKED_SQL.replace('asked AS', 'asked0 AS')}, asked AS (SELECT * FROM asked0),
    n AS (SELECT id, {sql_tokens("concat_ws(' ', selection, answer, comment, session)")} AS t FROM (SELECT DISTINCT * FROM notes)),
    post AS (SELECT id, term, len, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM n) GROUP BY ALL),
    scored AS (SELECT query, id, sum(tf / (1 + sqrt(len))) AS score FROM asked JOIN post USING (term) GROUP BY ALL),
    top AS (SELECT query, id FROM scored QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) <= 10),
    gone AS (SELECT DISTINCT id FROM tombstones),
    mine AS (SELECT request_id AS query, n.id FROM generate_requests g JOIN (SELECT DISTINCT id, chunk_id FROM notes) n ON n.chunk_id = g.chunk_id WHERE regexp_extract(request_id, '(\\d+)$', 1)::BIGINT % 20 = 0)
    SELECT query, id AS note_id, 'server' AS origin FROM top WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT DISTINCT query, id, 'local' FROM mine WHERE (query, id) NOT IN (SELECT (query, id) FROM top)""",
)
def search_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found notes that are not deleted by now, and the notes on the request's own page that were not found."""
    stated = table(spark, sf_dir, "generate_requests").where(F.regexp_extract("request_id", r"(\d+)$", 1).try_cast("long") % 20 == 0)
    notes = _stored(spark, sf_dir)
    scored = retrieval.note_scores(notes, "id", F.concat_ws(" ", "selection", "answer", "comment", "session"), retrieval.query_terms(stated, "request_id", "selection"))
    top = retrieval.best(scored, 10).select("query", F.col("page").alias("note_id"))
    gone = table(spark, sf_dir, "tombstones").select(F.col("id").alias("note_id")).distinct()
    mine = stated.select(F.col("request_id").alias("query"), "chunk_id").join(notes.select("chunk_id", F.col("id").alias("note_id")), "chunk_id").select("query", "note_id").distinct()
    return top.join(gone, "note_id", "left_anti").select("query", "note_id", F.lit("server").alias("origin")).unionByName(
        mine.join(top, ["query", "note_id"], "left_anti").select("query", "note_id", F.lit("local").alias("origin"))
    )


@NOTES.query(
    "rejected_changes",
    _STATE_SQL.split("ops AS (")[0].rstrip().removesuffix(",")
    + r""", o AS (SELECT CASE WHEN json_type(j) = 'OBJECT' THEN j END AS j FROM parsed WHERE kind = 'note.upserted'),
    r AS (SELECT CASE WHEN j IS NULL THEN 'unreadable' WHEN NOT coalesce(regexp_full_match(j->>'$.id', '[A-Za-z0-9_\-]{1,64}'), false) THEN 'id'
      WHEN length(coalesce(j->>'$.selection', '')) > 5000 THEN 'selection' WHEN length(coalesce(j->>'$.answer', '')) > 50000 THEN 'answer' WHEN length(coalesce(j->>'$.comment', '')) > 10000 THEN 'comment'
      WHEN length(coalesce(j->>'$.session', '')) > 80 THEN 'session' WHEN NOT coalesce(regexp_full_match(j->>'$.color', '[a-z]{1,12}'), true) THEN 'color' ELSE 'accepted' END AS verdict FROM o)
    SELECT verdict, count(*) AS n_rows FROM r GROUP BY verdict""",
)
def rejected_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts by the first limit they break."""
    b = changefeed.one_object(F.col("payload"), "id: STRING, selection: STRING, answer: STRING, comment: STRING, session: STRING, color: STRING")
    rows = table(spark, sf_dir, "outbox").where(F.lower(F.regexp_replace("type", r"(?U)^\s+|\s+$", "")) == "note.upserted").select(b.alias("b"))
    long_ = lambda c, n: F.length(F.coalesce(F.col(f"b.{c}"), F.lit(""))) > n
    verdict = (
        F.when(F.col("b").isNull(), "unreadable").when(~F.coalesce(F.col("b.id").rlike(r"\A[A-Za-z0-9_\-]{1,64}\z"), F.lit(False)), "id")
        .when(long_("selection", 5000), "selection").when(long_("answer", 50000), "answer").when(long_("comment", 10000), "comment").when(long_("session", 80), "session")
        .when(~F.coalesce(F.col("b.color").rlike(r"\A[a-z]{1,12}\z"), F.lit(True)), "color").otherwise("accepted")
    )
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n_rows"))


@NOTES.query(
    "session_briefs",
    f"""WITH n AS (SELECT session, doc_short, coalesce(page, -1) AS p, coalesce(created_at, ts * 1000) AS t, id, '- p.' || coalesce(page::VARCHAR, '?') || ' ' || {sql_excerpt('selection', 200)} || CASE WHEN coalesce(comment, '') <> '' THEN ' — ' || {sql_excerpt('comment', 200)} ELSE '' END AS line
      FROM (SELECT DISTINCT * FROM notes) WHERE session <> '' AND status = 'done')
    SELECT session, doc_short, row_number() OVER (PARTITION BY session, doc_short ORDER BY p, t, id) AS line_no, line FROM n""",
)
def session_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.brief_lines(_stored(spark, sf_dir))


@NOTES.query("extractive_answers")
def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every request whose number is divisible by 20: an answer quoted from the defined terms in its selection, the five best pages, its
    own left out, and, where it asks for the web, the web references of its page's notes."""
    stated = table(spark, sf_dir, "generate_requests").where(F.regexp_extract("request_id", r"(\d+)$", 1).try_cast("long") % 20 == 0)
    return extracted(stated, table(spark, sf_dir, "chunks"), _stored(spark, sf_dir), kept_index(spark, sf_dir, "chunks", "id"))


def extracted(stated: DataFrame, pages: DataFrame, notes: DataFrame, index: retrieval.Index | None = None) -> DataFrame:
    """(request_id, answer) of requests over pages and notes, each note once."""
    asked = retrieval.query_terms(stated, "request_id", "selection")
    own = stated.select(F.col("request_id").alias("query"), F.col("chunk_id").alias("page"))
    top = retrieval.top(index or retrieval.build(pages, "id", "text"), asked, 5, own)
    texts = pages.select(F.col("id").alias("page"), "doc_short", F.col("page").alias("page_no"), "text")
    passages = top.join(texts, "page").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_short", F.col("page_no").alias("page"), "text"))).alias("passages"))  # five at most

    glossary = insights.definitions(pages, ["doc", "page", "id", "doc_short"])
    matching = insights.matching_definitions(stated, "request_id", "selection", glossary, 6, ("doc", "page", "id", "doc_short"))
    terms = matching.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("doc", F.col("page").alias("page"), "id", "term", "definition", "doc_short"))).alias("terms"))  # six at most

    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    wanted = stated.where("web").select("request_id", trimmed("chunk_id").alias("query"))
    cited = notes.select(trimmed("chunk_id").alias("query"), "id", F.posexplode(notebook.one_array(F.col("web"), "title STRING, url STRING")).alias("i", "r"))
    cited = cited.join(wanted.select("query").distinct(), "query", "left_semi").select("query", F.lit(0).alias("provider_no"), "id", "i", "r.title", "r.url", F.lit("").alias("snippet"))
    order = F.row_number().over(W.partitionBy("query").orderBy("id", "i"))
    best = web.ranked(cited.withColumn("pos", order - 1), 4).join(wanted, "query")
    results = best.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "url", F.lit("").alias("snippet"), "domain", "tier_label"))).alias("results"))  # four at most

    rows = stated.join(passages.withColumnRenamed("query", "request_id"), "request_id", "left").join(terms, "request_id", "left").join(results, "request_id", "left")
    held = lambda df, c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType))
    text = answers.answer(F.col("mode"), F.coalesce("selection", F.lit("")), held(passages, "passages"), held(terms, "terms"), held(results, "results"), F.lit("model switched off"))
    return rows.select("request_id", text.alias("answer"))


@NOTES.query(
    "related_notes",
    f"""WITH p AS (SELECT id, doc, page, {sql_tokens('text')} AS t FROM chunks WHERE page % 20 = 0),
    each AS (SELECT id, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM p),
    terms AS (SELECT id, term FROM (SELECT id, term, count(*) AS tf, min(i) AS i FROM each GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY tf, i) <= 12),
    n AS (SELECT * FROM (SELECT DISTINCT * FROM notes) WHERE status = 'done'),
    said AS (SELECT id AS note_id, unnest({sql_tokens("concat_ws(' ', selection, comment)")}) AS term FROM n),
    used AS (SELECT terms.id, note_id, count(*) AS s FROM said JOIN terms USING (term) GROUP BY ALL),
    cites AS (SELECT DISTINCT x->>'$.id' AS id, n_id AS note_id, 3 AS s FROM (SELECT id AS n_id, unnest(from_json(CASE WHEN json_valid(related) AND json_type(related) = 'ARRAY' THEN related ELSE '[]' END, '["JSON"]')) AS x FROM n) WHERE x->>'$.id' IN (SELECT id FROM p)),
    sc AS (SELECT id, note_id, sum(s)::BIGINT AS score FROM (SELECT * FROM used UNION ALL SELECT * FROM cites) GROUP BY ALL HAVING sum(s) >= 3)
    SELECT sc.id AS page, note_id, score, row_number() OVER (PARTITION BY sc.id ORDER BY score DESC, note_id) AS rank FROM sc JOIN p USING (id) JOIN n ON n.id = note_id
    WHERE NOT coalesce(n.doc = p.doc AND n.page = p.page, false) QUALIFY rank <= 3""",
)
def related_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every twentieth page of each document."""
    pages = table(spark, sf_dir, "chunks").where("page % 20 = 0").select(F.col("id").alias("page"), "doc", F.col("page").alias("page_no"), "text")
    cited = F.coalesce(F.transform(notebook.one_array(F.col("related"), "id STRING"), lambda r: r["id"]), F.array().cast("array<string>"))
    notes = _stored(spark, sf_dir).where("status = 'done'").select(
        F.col("id").alias("note_id"), "doc", F.col("page").alias("page_no"), F.concat_ws(" ", "selection", "comment").alias("said"), cited.alias("related")
    )
    return retrieval.related_notes(notes, pages)
