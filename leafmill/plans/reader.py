"""Queries of the reading view: sentences, marks, terms, references, sections, the notebook's view, look-ups and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import answers, changefeed, insights, notebook, structure, telemetry
from leafmill.plans.notes import _OUTCOME_SQL, _stored
from leafmill.plans.reading import _SPACE, sql_squash, sql_tokens
from leafmill.plans.registry import Registry
from leafmill.session import materialise, table

READER = Registry()

_STORED_SQL = "(SELECT DISTINCT * FROM notes)"


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests whose number is divisible by 20."""
    return table(spark, sf_dir, "generate_requests").where(F.regexp_extract("request_id", r"(\d+)$", 1).try_cast("long") % 20 == 0)


_STATED_SQL = r"(SELECT * FROM generate_requests WHERE regexp_extract(request_id, '(\d+)$', 1)::BIGINT % 20 = 0)"


def sql_reader_sentences(x: str) -> str:
    """Here the text has a sentence wherever it has any other character than a stop, so the whole text never stands for one."""
    found = rf"regexp_extract_all({x}, '[^.!?]+[.!?]+[\"”’)]?(?:{_SPACE}|$)|[^.!?]+$')"
    return f"list_filter(list_transform({found}, lambda s: regexp_replace(s, '^{_SPACE}|{_SPACE}$', '', 'g')), lambda s: s <> '')"


@READER.query(
    "reader_sentences",
    f"WITH s AS (SELECT id, {sql_reader_sentences('text')} AS l FROM chunks WHERE text IS NOT NULL) SELECT id, unnest(l) AS sentence, (generate_subscripts(l, 1) - 1)::INT AS pos FROM s",
)
def reader_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("id", F.posexplode_outer(T.reader_sentences(F.col("text"))).alias("pos", "sentence")).where("pos IS NOT NULL")


@READER.query(
    "marked_sentences",
    f"""WITH s0 AS (SELECT id, doc, page, {sql_reader_sentences('text')} AS l FROM chunks), s AS (SELECT id, doc, page, unnest(l) AS s, (generate_subscripts(l, 1) - 1)::INT AS pos FROM s0),
    n AS (SELECT id AS note_id, mode, doc, page, lower({sql_squash('selection')}) AS a FROM {_STORED_SQL} WHERE mode IN ('highlight', 'note') AND selection IS NOT NULL),
    t AS (SELECT id, doc, page, pos, lower({sql_squash('s')}) AS t FROM s)
    SELECT note_id, mode, id AS chunk, pos FROM n JOIN t USING (doc, page) WHERE length(t) >= 3
      AND (contains(a, t) OR contains(t, a) OR (length(a) >= 12 AND (contains(t, a[1:30]) OR contains(t, CASE WHEN length(a) > 30 THEN a[-30:] ELSE a END))))""",
)
def marked_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sentences of its page a highlight or note marks: joined on the page, matched within the row."""
    notes = _stored(spark, sf_dir).where("mode IN ('highlight', 'note')").select(F.col("id").alias("note_id"), "mode", "doc", "page", "selection")
    pages = table(spark, sf_dir, "chunks").select(F.col("id").alias("chunk"), "doc", "page", T.reader_sentences(F.col("text")).alias("s"))
    each = notes.join(pages, ["doc", "page"]).select("note_id", "mode", "chunk", "selection", F.posexplode_outer("s").alias("pos", "sentence")).where("pos IS NOT NULL")
    return each.where(T.marks_sentence(F.col("selection"), F.col("sentence"))).select("note_id", "mode", "chunk", "pos")


@READER.query(
    "query_hits",
    f"""WITH q AS (SELECT request_id, chunk_id, list_distinct({sql_tokens('selection')}) AS q FROM {_STATED_SQL}),
    s0 AS (SELECT id, {sql_reader_sentences('text')} AS l FROM chunks), s AS (SELECT id, unnest(l) AS s, (generate_subscripts(l, 1) - 1)::INT AS pos FROM s0 WHERE id IN (SELECT chunk_id FROM q))
    SELECT request_id, pos FROM q JOIN s ON s.id = q.chunk_id WHERE len(q) > 0 AND len(list_intersect({sql_tokens('s')}, q)) >= least(2, len(q))""",
)
def query_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of a request's page that its selection, taken as a query, hits."""
    asked = _stated(spark, sf_dir).select("request_id", F.col("chunk_id").alias("id"), T.tokens(F.col("selection")).alias("q"))
    pages = table(spark, sf_dir, "chunks").join(asked.select("id").distinct(), "id", "left_semi").select("id", F.posexplode_outer(T.reader_sentences(F.col("text"))).alias("pos", "s")).where("pos IS NOT NULL")
    return asked.join(pages, "id").where(T.hits_query(F.col("s"), F.col("q"))).select("request_id", "pos")


@READER.query(
    "defined_terms",
    rf"""WITH g AS (SELECT lower(regexp_extract(doc_title, '^\w+')) AS low, max({{'doc': doc, 'page': page, 'term': regexp_extract(doc_title, '^\w+')}}) AS m FROM chunks WHERE page = 1 GROUP BY 1),
    w0 AS (SELECT id, doc, page, regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+') AS l FROM chunks),
    w AS (SELECT id, doc, page, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM w0),
    hit AS (SELECT id, m.term AS term, x, i FROM w JOIN g ON lower(x) = low WHERE length(low) BETWEEN 4 AND 60 AND NOT (regexp_matches(m.term, '^[A-Z]') AND NOT regexp_matches(x, '^[A-Z]')) AND NOT (m.doc = doc AND m.page = page))
    SELECT id, term, arg_min(x, i) AS word, min(i)::INT AS place FROM hit GROUP BY id, term""",
)
def defined_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first use on each page of the names that documents begin their titles with. The pages define no terms of their own; those of a
    glossary from `insights.definitions` are linked alike."""
    pages = table(spark, sf_dir, "chunks")
    glossary = pages.where("page = 1").select(F.regexp_extract("doc_title", r"^\w+", 0).alias("term"), "doc", "page")
    return insights.term_uses(pages, "id", "doc", "page", "text", glossary).select("id", "term", F.col("use").alias("word"), F.col("at").alias("place"))


@READER.query("glossary")
def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defined terms of the pages with a row for each document that has none, so that the absence shows."""
    pages = table(spark, sf_dir, "chunks")
    found = insights.definitions(pages, ["doc", "page", "id"]).select("doc", "term", "definition", "page")
    return pages.select("doc").distinct().join(found, "doc", "left")


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(structure.outline(structure.page_blocks(table(spark, sf_dir, "chunks"), ["doc", "page"])))


@READER.query("sections_done")
def sections_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections that each session has read to their end, by the furthest page of its notes."""
    seen = table(spark, sf_dir, "notes").select("session", F.btrim("doc", F.lit(" \t")).alias("doc"), "page").where("doc <> ''").groupBy("session", "doc").agg((F.max("page") - 1).alias("furthest"))
    return structure.sections_done(_heads(spark, sf_dir), seen)


@READER.query(
    "resolved_references",
    rf"""WITH l AS (SELECT doc, page, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_squash('x')}), lambda x: x <> '') AS l FROM chunks WHERE regexp_matches(doc, '^bill') AND text IS NOT NULL),
    p AS (SELECT doc, page, unnest(l) AS x FROM l WHERE len(list_filter(l, lambda x: regexp_full_match(x, '(?i)(?:table of )?contents'))) = 0
          AND NOT (len(l) >= 8 AND len(list_filter(l, lambda x: regexp_matches(x, '\s\.?\s?\d{{1,3}}$') AND length(x) < 90)) / len(l) > 0.45)),
    c AS (SELECT upper(regexp_extract(x, '(?i)^CLAUSE\s+(\d+[A-Z]?)\s*[—–:-]?\s*(.*)$', 1)) AS number, min({{'doc': doc, 'page': page}}) AS t FROM p WHERE regexp_full_match(x, '(?i)CLAUSE\s+(\d+[A-Z]?)\s*[—–:-]?\s*(.*)') GROUP BY 1),
    m AS (SELECT id, doc, page, regexp_extract_all(text, '(?i)\b(?:section|clause|article)\s+\d{{1,3}}[A-Z]?') AS l FROM chunks WHERE regexp_matches(doc, '^(bill|digest)')),
    e AS (SELECT id, doc, page, upper(regexp_extract(unnest(l), '\d.*$')) AS number, generate_subscripts(l, 1) AS i FROM m),
    r AS (SELECT * FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY id, number ORDER BY i) = 1) QUALIFY row_number() OVER (PARTITION BY id ORDER BY i) <= 6)
    SELECT id, number, t.doc AS target_doc, t.page AS target_page FROM r JOIN c USING (number) WHERE NOT (r.doc = t.doc AND r.page = t.page)""",
)
def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References on the pages of bills and digests that lead to a clause on another page: its first heading in the bills, in order."""
    pages = table(spark, sf_dir, "chunks").where("doc RLIKE '^(bill|digest)'")
    refs = insights.cross_references(pages, "id", "text").join(pages.select("id", "doc", "page"), "id")
    heads = structure.outline(structure.page_blocks(pages.where("doc LIKE 'bill%'"), ["doc", "page"]))
    return structure.resolved(refs, heads).select("id", "number", "target_doc", "target_page")


# The kinds of document that come first, in order.
DOC_ORDER = ["strategy", "roadmap", "bill", "digest"]


@READER.query(
    "document_order",
    "SELECT doc, list_position(['strategy', 'roadmap', 'bill', 'digest'], regexp_replace(doc, '\\d+$', '')) AS place FROM (SELECT DISTINCT doc FROM chunks) ORDER BY coalesce(place, 999), doc",
)
def document_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in order: kinds in their fixed places first, then the others by key."""
    kind = F.array_position(F.array(*[F.lit(d) for d in DOC_ORDER]), F.regexp_replace("doc", r"\d+$", ""))
    docs = table(spark, sf_dir, "chunks").select("doc").distinct().select("doc", F.when(kind > 0, kind.cast("int")).alias("place"))
    return docs.orderBy(F.coalesce("place", F.lit(999)), "doc")


_GROUP_SQL = "CASE mode WHEN 'highlight' THEN 'highlights' WHEN 'note' THEN 'mine' ELSE 'research' END"


@READER.query(
    "notes_view",
    f"""WITH n AS (SELECT id, session, doc, page, coalesce(created_at, ts * 1000) AS t, {_GROUP_SQL} AS grp, {sql_tokens("concat_ws(' ', selection, answer, comment)")} AS words FROM {_STORED_SQL})
    SELECT session, grp, id, row_number() OVER (PARTITION BY session, grp ORDER BY coalesce(list_position(['strategy', 'roadmap', 'bill', 'digest'], regexp_replace(trim(doc, ' ' || chr(9)), '\\d+$', '')), 999), trim(doc, ' ' || chr(9)), page, t, id) AS place
    FROM n WHERE session <> '' AND list_contains(words, 'council') QUALIFY place <= 100""",
)
def notes_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every session and group the first hundred notes, in reading order, that speak of a council: documents in order, then pages, then time."""
    rows = notebook.view(_stored(spark, sf_dir), None, "all", F.array(F.lit("council"))).where("session <> ''")
    doc = F.btrim("doc", F.lit(" \t"))
    kind = F.array_position(F.array(*[F.lit(d) for d in DOC_ORDER]), F.regexp_replace(doc, r"\d+$", ""))
    order = [F.when(kind > 0, kind).otherwise(999).asc_nulls_last(), doc.asc_nulls_last(), F.col("page").asc_nulls_last(), F.coalesce("created_at", F.col("ts") * 1000).asc_nulls_last(), F.col("id")]
    grouped = rows.withColumn("grp", notebook.note_group(F.col("mode")))
    return grouped.withColumn("place", F.row_number().over(W.partitionBy("session", "grp").orderBy(*order))).where("place <= 100").select("session", "grp", "id", "place")


@READER.query(
    "note_groups",
    f"SELECT session, count(*) AS n_all, count_if({_GROUP_SQL} = 'highlights') AS highlights, count_if({_GROUP_SQL} = 'mine') AS mine, count_if({_GROUP_SQL} = 'research') AS research FROM {_STORED_SQL} GROUP BY session",
)
def note_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = notebook.note_group(F.col("mode"))
    return _stored(spark, sf_dir).groupBy("session").agg(F.count("*").alias("n_all"), *[F.count_if(group == g).alias(g) for g in ("highlights", "mine", "research")])


@READER.query(
    "session_names",
    f"""WITH saved AS (SELECT DISTINCT CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload->>'$.session' END AS name FROM outbox),
    used AS (SELECT session AS name, count(*) AS n FROM {_STORED_SQL} GROUP BY 1)
    SELECT name, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, coalesce(n, 0) AS n_notes FROM (SELECT name FROM saved UNION SELECT name FROM used) LEFT JOIN used USING (name) WHERE name <> ''""",
)
def session_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that changes have saved, and those on notes, with the number of notes and the name as part of a file's name."""
    saved = table(spark, sf_dir, "outbox").select(changefeed.one_object(F.col("payload"), "session: STRING")["session"].alias("name"))
    used = _stored(spark, sf_dir).groupBy(F.col("session").alias("name")).agg(F.count("*").alias("n"))
    names = saved.unionByName(used.select("name")).where("name <> ''").distinct()
    return names.join(used, "name", "left").select("name", T.slug(F.col("name")).alias("slug"), F.coalesce("n", F.lit(0)).alias("n_notes"))


@READER.query(
    "note_ages",
    f"""WITH n AS (SELECT id, coalesce(created_at, ts * 1000) AS made FROM {_STORED_SQL}), m AS (SELECT id, made, (SELECT max(made) FROM n) AS newest FROM n), s AS (SELECT id, made, floor((newest - made) / 1000 + 0.5) AS s FROM m)
    SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN floor(s / 60 + 0.5)::BIGINT || ' min ago' WHEN s < 86400 THEN floor(s / 3600 + 0.5)::BIGINT || ' h ago' ELSE strftime(make_timestamp(made * 1000), '%Y-%m-%d') END AS age FROM s""",
)
def note_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How old each note was when the newest was made."""
    rows = _stored(spark, sf_dir).select("id", F.coalesce("created_at", F.col("ts") * 1000).alias("at"))
    newest = rows.agg(F.max("at")).first()[0]
    return rows.select("id", T.age_label(F.lit(newest).cast("long"), F.col("at")).alias("age"))


@READER.query(
    "newest_on_device",
    f"SELECT id, session, coalesce(created_at, ts * 1000) AS made, row_number() OVER (PARTITION BY session ORDER BY coalesce(created_at, ts * 1000) DESC NULLS LAST, id) AS rank FROM {_STORED_SQL} QUALIFY rank <= 500",
)
def newest_on_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The device's order: newest by creation, where the store's is by change; 500 a session, the limit of a listing."""
    rows = _stored(spark, sf_dir).select("id", "session", F.coalesce("created_at", F.col("ts") * 1000).alias("made"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("session").orderBy(F.desc("made"), "id"))).where("rank <= 500")


@READER.query(
    "requested_pages",
    "SELECT request_id, g.chunk_id, c.doc, c.page, CASE WHEN c.id IS NULL THEN 404 ELSE 200 END AS status FROM generate_requests g LEFT JOIN chunks c ON c.id = g.chunk_id",
)
def requested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each request by its id; 404 where there is none."""
    pages = table(spark, sf_dir, "chunks").select(F.col("id").alias("chunk_id"), "doc", "page", F.lit(200).alias("status"))
    asked = table(spark, sf_dir, "generate_requests").select("request_id", "chunk_id")
    return asked.join(pages, "chunk_id", "left").select("request_id", "chunk_id", "doc", "page", F.coalesce("status", F.lit(404)).alias("status"))


@READER.query(
    "changed_notes_by_id",
    f"""WITH c AS (SELECT DISTINCT CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload->>'$.id' END AS id FROM outbox)
    SELECT id, n.mode, n.status, n.id IS NOT NULL AS stored FROM c LEFT JOIN {_STORED_SQL} n USING (id) WHERE id IS NOT NULL""",
)
def changed_notes_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored note of every id that the feed names."""
    asked = table(spark, sf_dir, "outbox").select(changefeed.one_object(F.col("payload"), "id: STRING")["id"].alias("id")).where("id IS NOT NULL").distinct()
    notes = _stored(spark, sf_dir).select("id", "mode", "status", F.lit(True).alias("stored"))
    return asked.join(notes, "id", "left").select("id", "mode", "status", F.coalesce("stored", F.lit(False)).alias("stored"))


@READER.query(
    "corpus_versions",
    """WITH p AS (SELECT doc, floor(page / 256)::BIGINT AS b, page, id, sha256(coalesce(text, '')) AS h FROM chunks), s AS (SELECT doc, b, sha256(string_agg(h, '' ORDER BY page, id)) AS h FROM p GROUP BY doc, b)
    SELECT doc, substr(sha256(string_agg(h, '' ORDER BY b)), 1, 32) AS version FROM s GROUP BY doc""",
)
def corpus_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version of each document's content: hashes of pages, then of 256 pages each, then of the document."""
    joined = lambda *order: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "h"))), lambda x: x["h"]), ""), 256)
    pages = table(spark, sf_dir, "chunks").select("doc", F.floor(F.col("page") / 256).alias("b"), "page", "id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    parts = pages.groupBy("doc", "b").agg(joined("page", "id").alias("h"))  # 256 pages at most
    return parts.groupBy("doc").agg(F.substring(joined("b"), 1, 32).alias("version"))


@READER.query("request_fingerprints", "SELECT request_id, sha256('POST /api/v1/research' || chr(10) || coalesce(context_text, '')) AS fingerprint FROM generate_requests")
def request_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "generate_requests").select("request_id", T.request_fingerprint(F.lit("POST"), F.lit("/api/v1/research"), F.col("context_text")).alias("fingerprint"))


@READER.query(
    "change_log",
    _OUTCOME_SQL + "SELECT seq, note_id, CASE WHEN is_delete = 1 THEN 'note.deleted' ELSE 'note.upserted' END AS type, version FROM outcome WHERE outcome = 'applied'",
)
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per change that was applied, none for those that were stale."""
    applied = notebook.change_outcomes(changefeed.read_changes(table(spark, sf_dir, "outbox"))).where("outcome = 'applied'")
    return applied.select("seq", "note_id", F.when(F.col("is_delete") == 1, "note.deleted").otherwise("note.upserted").alias("type"), "version")


@READER.query("note_writes", _OUTCOME_SQL + "SELECT CASE WHEN is_delete = 1 THEN 'delete' ELSE 'upsert' END AS op, outcome AS result, count(*) AS n FROM outcome GROUP BY ALL")
def note_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes counted by operation and result."""
    each = notebook.change_outcomes(changefeed.read_changes(table(spark, sf_dir, "outbox")))
    return each.groupBy(F.when(F.col("is_delete") == 1, "delete").otherwise("upsert").alias("op"), F.col("outcome").alias("result")).agg(F.count("*").alias("n"))


@READER.query(
    "relay_batch",
    """WITH b AS (SELECT seq, event_id, type, coalesce(json_valid(payload), false) AS ok FROM outbox WHERE published_at IS NULL ORDER BY seq LIMIT 100)
    SELECT seq, event_id, type FROM b WHERE seq < coalesce((SELECT min(seq) FROM b WHERE NOT ok), seq + 1)""",
)
def relay_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one step of the relay publishes: the next hundred rows in order, up to the first that cannot be read."""
    readable = F.try_parse_json("payload").isNotNull()
    batch = table(spark, sf_dir, "outbox").where("published_at IS NULL").select("seq", "event_id", "type", F.coalesce(readable, F.lit(False)).alias("ok")).orderBy("seq").limit(100)
    failed = batch.where("NOT ok").agg(F.min("seq").alias("failed"))
    return batch.join(F.broadcast(failed), (F.col("failed").isNull()) | (F.col("seq") < F.col("failed"))).select("seq", "event_id", "type")


@READER.query(
    "click_shares",
    """WITH e AS (SELECT time_bucket(INTERVAL '5 minutes', ts) - INTERVAL '5 minutes' * k AS w, event_type FROM events, generate_series(0, 2) AS g(k) WHERE event_type IN ('click', 'view'))
    SELECT w AS window_start, count(*) AS n_events, count_if(event_type = 'click') AS n_clicks, count_if(event_type = 'click') / count(*) AS share, count_if(event_type = 'click') / count(*) > 0.5 AS alert FROM e GROUP BY w""",
)
def click_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of clicks among clicks and views in ranges of 15 minutes, every 5 minutes, and whether it is over a half."""
    rows = table(spark, sf_dir, "events").where("event_type IN ('click', 'view')")
    counted = telemetry.shares(rows, "ts", F.col("event_type") == "click", "15 minutes", "5 minutes")
    return counted.select("window_start", "n_events", F.col("n_hits").alias("n_clicks"), "share", (F.col("share") > 0.5).alias("alert"))


@READER.query(
    "requests_red",
    f"""WITH b AS (SELECT mode, coalesce(web::VARCHAR, '') AS web, coalesce(len(list_filter([500, 1000, 2000, 4000, 6000], lambda x: x < length(context_text))), 0) AS b FROM generate_requests)
    SELECT mode, web, b::INT AS b, count(*) AS n FROM b GROUP BY ALL""",
)
def requests_red(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests counted by mode, use of the web and bucket of their context's length."""
    size = F.length("context_text")
    bucket = sum((F.when(size > b, 1).otherwise(0) for b in (500, 1000, 2000, 4000, 6000)), F.lit(0))
    return table(spark, sf_dir, "generate_requests").groupBy("mode", F.coalesce(F.col("web").cast("string"), F.lit("")).alias("web"), bucket.cast("int").alias("b")).agg(F.count("*").alias("n"))


@READER.query(
    "web_titles",
    rf"""WITH r AS (SELECT id, unnest(from_json(CASE WHEN json_valid(web) AND json_type(web) = 'ARRAY' THEN web ELSE '[]' END, '["JSON"]')) AS x FROM {_STORED_SQL})
    SELECT DISTINCT x->>'$.url' AS url, {sql_squash("regexp_replace(x->>'$.title', '<[^>]+>', '', 'g')")} AS title FROM r""",
)
def web_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of web references as plain text."""
    refs = _stored(spark, sf_dir).select(F.explode_outer(notebook.one_array(F.col("web"), "title STRING, url STRING")).alias("r")).where("r IS NOT NULL").select("r.url", "r.title").distinct()
    return refs.select("url", T.html_text(200)(F.col("title")).alias("title")).distinct()


@READER.query("answer_html")
def answer_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored answers as HTML."""
    return _stored(spark, sf_dir).where("answer IS NOT NULL").select("id", T.markdown_html(F.col("answer")).alias("html"))


_YOURS_SQL = "CASE WHEN coalesce(comment, '') <> '' THEN chr(10) || chr(10) || '**My note:** ' || comment ELSE '' END"
_NESTED_SQL = r"regexp_replace(coalesce(answer, ''), '(?m)^#{1,4}\s+', '#### ', 'g')"
_QUOTE_SQL = f"'> ' || {sql_squash('selection')}"
_GAP = "chr(10) || chr(10)"


@READER.query(
    "research_brief",
    rf"""WITH t AS (SELECT doc, arg_min(doc_title, page) AS title, coalesce(list_position(['strategy', 'roadmap', 'bill', 'digest'], regexp_replace(doc, '\d+$', '')), 999) AS place FROM chunks GROUP BY doc),
    n AS (SELECT x.* EXCLUDE (doc), regexp_replace(x.doc, '^\s+|\s+$', '', 'g') AS doc, coalesce(created_at, ts * 1000) AS made FROM {_STORED_SQL} x WHERE session <> '' AND status = 'done'),
    d AS (SELECT n.*, title, coalesce(place, 999) AS place FROM n LEFT JOIN t USING (doc)),
    w0 AS (SELECT session, made, id, from_json(CASE WHEN json_valid(web) AND json_type(web) = 'ARRAY' THEN web ELSE '[]' END, '["JSON"]') AS l FROM d), w1 AS (SELECT session, made, id, unnest(l) AS r, generate_subscripts(l, 1) AS i FROM w0),
    w AS (SELECT * FROM w1 WHERE r->>'$.url' IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session, r->>'$.url' ORDER BY made, id, i) = 1),
    l AS (
      SELECT session, 1 AS part, 0 AS place, '' AS name, 0 AS p, made AS t, id, '### ' || coalesce(selection, '') || {_GAP} || {_NESTED_SQL} || {_YOURS_SQL} AS line FROM d WHERE mode = 'ask'
      UNION ALL SELECT session, 2, place, doc, -2, -2, '', '### ' || min(coalesce(title, doc_short, '?')) FROM d WHERE mode IN ('highlight', 'note') GROUP BY session, place, doc
      UNION ALL SELECT session, 2, place, doc, coalesce(page, -1), made, id, '**p.' || coalesce(page::VARCHAR, '?') || '**' || {_GAP} || {_QUOTE_SQL} || {_YOURS_SQL} FROM d WHERE mode IN ('highlight', 'note')
      UNION ALL SELECT session, 3, place, doc, coalesce(page, -1), made, id, '### ' || CASE mode WHEN 'research' THEN 'Research' ELSE 'Simplified' END || ' — ' || coalesce(doc_short, '') || ', p.' || coalesce(page::VARCHAR, '?') || {_GAP} || {_QUOTE_SQL} || {_GAP} || {_NESTED_SQL} || {_YOURS_SQL} FROM d WHERE mode IN ('research', 'simplify')
      UNION ALL SELECT session, 4, 0, '', 0, made, id || format(' {{:06d}}', i - 1), '- [' || coalesce(r->>'$.title', '') || '](' || (r->>'$.url') || ') — ' || coalesce(r->>'$.domain', '') || ' · ' || coalesce(r->>'$.tier_label', '') FROM w
      UNION ALL SELECT session, 5, place, doc, page, 0, '', '- ' || min(coalesce(title, doc_short, '?')) || ' — p. ' || page FROM d WHERE mode <> 'web' AND page IS NOT NULL GROUP BY session, place, doc, page),
    a AS (SELECT * FROM l UNION ALL SELECT DISTINCT session, part, -1, '', -9, -9, '', ['## Questions', '## Highlights and notes (in reading order)', '## Research notes', '## Sources beyond the documents', '## References'][part] FROM l)
    SELECT session, part, row_number() OVER (PARTITION BY session, part ORDER BY place, coalesce(name, ''), p, t, id) AS line_no, line FROM a""",
)
def research_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brief of every session."""
    kind = F.array_position(F.array(*[F.lit(d) for d in DOC_ORDER]), F.regexp_replace("doc", r"\d+$", ""))
    docs = table(spark, sf_dir, "chunks").groupBy("doc").agg(F.min_by("doc_title", "page").alias("title")).select("doc", "title", F.when(kind > 0, kind.cast("int")).alias("place"))
    return answers.research_brief(_stored(spark, sf_dir), docs)
