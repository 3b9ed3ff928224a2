"""Queries over pages: text functions, catalogue, retrieval and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import insights, retrieval, structure
from leafmill.operators.running import running
from leafmill.plans.registry import Registry
from leafmill.session import materialise, table, table_path

READING = Registry()

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_SPACE = r"[\s\x0B\x{1c}-\x{1f}\x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def sql_tokens(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z][a-z\-]{{2,}}'), lambda w: NOT list_contains({_STOP}, w))"


def sql_squash(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_SPACE}', ' ', 'g'))"


def sql_excerpt(x: str, n: int) -> str:
    return f"CASE WHEN length({sql_squash(x)}) <= {n} THEN {sql_squash(x)} ELSE rtrim(substr({sql_squash(x)}, 1, {n - 1})) || '…' END"


def sql_sentences(x: str) -> str:
    """A piece counts if the next piece begins with a space or there is none."""
    return rf"""list_filter(list_transform(list_filter(list_transform(regexp_extract_all({x}, '[^.!?]+[.!?]*'),
        lambda s, i: {{'s': s, 'n': regexp_extract_all({x}, '[^.!?]+[.!?]*')[i + 1]}}), lambda p: p.n IS NULL OR p.n[1] = ' '), lambda p: trim(p.s)), lambda s: length(s) > 2)"""


@READING.query(
    "token_stats",
    f"""WITH t AS (SELECT id, unnest({sql_tokens('text')}) AS term FROM chunks)
        SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM t GROUP BY term""",
)
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = retrieval.with_counts(table(spark, sf_dir, "chunks").select(T.tokens(F.col("text")).alias("t")))
    return counted.select(F.inline_outer("posts")).where("term IS NOT NULL").groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@READING.query("page_excerpts", f"SELECT id, {sql_squash('text')} AS squashed, {sql_excerpt('text', 320)} AS excerpt FROM chunks")
def page_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("id", T.squash(F.col("text")).alias("squashed"), T.excerpt(F.col("text"), 320).alias("excerpt"))


@READING.query(
    "page_sentences",
    f"""WITH p AS (SELECT id, {sql_squash('text')} AS t FROM chunks), s AS (SELECT id, {sql_sentences('t')} AS l FROM p)
        SELECT id, unnest(l) AS sentence, (generate_subscripts(l, 1) - 1)::INT AS pos FROM s""",
)
def page_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("id", F.posexplode_outer(T.sentences(F.col("text"))).alias("pos", "sentence")).where("pos IS NOT NULL")


@READING.query(
    "doc_catalog",
    """SELECT doc, arg_min(doc_title, page) AS title, arg_min(doc_short, page) AS short, count(*) AS pages, sum(coalesce(words, 0)) AS n_words,
       greatest(1, floor(sum(coalesce(words, 0)) / 230 + 0.5))::INT AS minutes FROM chunks GROUP BY doc""",
)
def doc_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.sum(F.coalesce("words", F.lit(0)))
    return table(spark, sf_dir, "chunks").groupBy("doc").agg(
        F.min_by("doc_title", "page").alias("title"), F.min_by("doc_short", "page").alias("short"), F.count("*").alias("pages"), words.alias("n_words"), T.reading_minutes(words).alias("minutes")
    )


@READING.query("words_left", "SELECT id, doc, page, sum(coalesce(words, 200)) OVER (PARTITION BY doc ORDER BY page, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS words_left FROM chunks")
def words_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "chunks").select("id", "doc", "page", F.coalesce("words", F.lit(200)).cast("long").alias("w"))
    return running(pages, ["doc"], [F.col("page"), F.col("id")], F.floor(F.col("page") / 256), F.col("w"), "sum", "words_left", before=False).drop("w")


_BM25_SQL = f"""
WITH w AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN ['_'] ELSE t END AS t FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)),
post AS (SELECT doc_id, term, any_value(len) AS len, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM w) GROUP BY doc_id, term),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM w),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM (SELECT term, count(*) AS df FROM post GROUP BY term), corpus),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
asked AS (SELECT query, term, count(*) AS times FROM (SELECT item_id AS query, unnest({sql_tokens('text')}) AS term FROM benchmark WHERE item_id % 20 = 0) GROUP BY ALL),
scored AS (SELECT query, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score
           FROM asked JOIN post USING (term) JOIN idf USING (term), corpus GROUP BY query, doc_id HAVING score > 0)
"""


_INDEXES: dict[tuple, retrieval.Index] = {}


def kept_index(spark: SparkSession, sf_dir: str, name: str, key: str) -> retrieval.Index:
    """The index of a table's texts, built once in a session for the same files."""
    files = spark.read.parquet(table_path(sf_dir, name))
    known = (spark.sparkContext.applicationId, name, str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), *sorted(files.inputFiles()))
    if known not in _INDEXES:
        _INDEXES[known] = retrieval.build(table(spark, sf_dir, name), key, "text")
    return _INDEXES[known]


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents for the stated queries: the test items whose id is divisible by 20."""
    index = kept_index(spark, sf_dir, "documents", "doc_id")
    items = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0")
    return retrieval.scores(index, retrieval.query_terms(items, "item_id", "text"))


@READING.query(
    "bm25_top_k",
    _BM25_SQL + "SELECT query, doc_id, round_even(score, 3) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 10",
)
def bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieval.best(_searched(spark, sf_dir), 10)
    return top.select("query", F.col("page").alias("doc_id"), F.bround("score", 3).alias("score"), "rank")


@READING.query(
    "bm25_floor",
    _BM25_SQL.replace("FROM documents))", "FROM documents WHERE lang = 'sw'))").replace("FROM benchmark WHERE item_id % 20 = 0", "FROM documents WHERE lang = 'sw' AND doc_id % 20 = 0").replace("SELECT item_id AS query", "SELECT doc_id AS query")
    + "SELECT query, doc_id, round_even(score, 3) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 5",
)
def bm25_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in Swahili most like every twentieth of them: the stopwords are English, so the commonest words reach the floor of the idf."""
    docs = table(spark, sf_dir, "documents").where("lang = 'sw'")
    asked = retrieval.query_terms(docs.where("doc_id % 20 = 0"), "doc_id", "text")
    top = retrieval.best(retrieval.scores(retrieval.build(docs, "doc_id", "text"), asked), 5)
    return top.select("query", F.col("page").alias("doc_id"), F.bround("score", 3).alias("score"), "rank")


@READING.query(
    "bm25_filtered",
    _BM25_SQL
    + """SELECT query, doc_id, round_even(score, 3) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank
         FROM scored JOIN documents USING (doc_id) WHERE kind = 'minutes' AND doc_id <> 10 * query QUALIFY rank <= 5""",
)
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One kind of document, one document left out: both after scoring."""
    kinds = table(spark, sf_dir, "documents").where("kind = 'minutes'").select(F.col("doc_id").alias("page"))
    kept = _searched(spark, sf_dir).join(kinds, "page", "left_semi").where(F.col("page") != 10 * F.col("query"))
    return retrieval.best(kept, 5).select("query", F.col("page").alias("doc_id"), F.bround("score", 3).alias("score"), "rank")


@READING.query(
    "bm25_snippets",
    _BM25_SQL
    + f""", hits AS (SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 5),
    said AS (SELECT query, rank, doc_id, {sql_squash('d.text')} AS t, {sql_tokens('b.text')} AS q FROM hits JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query),
    cut AS (SELECT query, rank, doc_id, t, q, {sql_sentences('t')} AS l FROM said),
    each AS (SELECT query, rank, i, l[i] AS s, len(list_intersect({sql_tokens('l[i]')}, q)) AS o FROM (SELECT query, rank, l, q, unnest(generate_series(1, len(l))) AS i FROM cut)),
    two AS (SELECT query, rank, string_agg(s, ' ' ORDER BY o DESC, i) AS s FROM (SELECT * FROM each WHERE o > 0 QUALIFY row_number() OVER (PARTITION BY query, rank ORDER BY o DESC, i) <= 2) GROUP BY query, rank)
    SELECT query, rank, doc_id, {sql_excerpt("coalesce(s, t)", 320)} AS snippet FROM cut LEFT JOIN two USING (query, rank)""",
)
def bm25_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieval.best(_searched(spark, sf_dir), 5).select("query", "rank", F.col("page").alias("doc_id"))
    items = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query"), T.tokens(F.col("text")).alias("q"))
    found = top.join(items, "query").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return found.select("query", "rank", "doc_id", T.snippet(F.col("q"), F.col("text")).alias("snippet"))


_TERMS_SQL = f"""
WITH p AS (SELECT id, doc, {sql_tokens('text')} AS t FROM chunks),
each AS (SELECT id, doc, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM p),
tf AS (SELECT id, doc, term, count(*) AS tf, min(i) AS first FROM each GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM chunks),
weighed AS (SELECT id, doc, term, first, tf * ln(n / (1 + df)) AS weight FROM tf JOIN df USING (term), n),
terms AS (SELECT id, doc, term, first,
          row_number() OVER (PARTITION BY id ORDER BY round(weight, 9) DESC, first) AS rank FROM weighed QUALIFY rank <= 8)
"""


@READING.query("key_terms", _TERMS_SQL + "SELECT id, term, rank FROM terms")
def key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieval.key_terms(kept_index(spark, sf_dir, "chunks", "id"), 8)
    return top.select(F.col("page").alias("id"), "term", "rank")


@READING.query(
    "related_elsewhere",
    _TERMS_SQL
    + f""", w AS (SELECT id, CASE WHEN len(t) = 0 THEN ['_'] ELSE t END AS t FROM p),
    corpus AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM w),
    post AS (SELECT id, term, any_value(len) AS len, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM w) GROUP BY id, term),
    raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM (SELECT term, count(*) AS df FROM post GROUP BY term), corpus),
    idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
    asked AS (SELECT terms.id AS query, terms.doc AS from_doc, term FROM terms JOIN chunks USING (id) WHERE chunks.page % 20 = 0),
    scored AS (SELECT query, from_doc, post.id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score
               FROM asked JOIN post USING (term) JOIN idf USING (term), corpus WHERE post.id <> query GROUP BY ALL HAVING score > 0),
    twelve AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS r FROM scored QUALIFY r <= 12)
    SELECT query, id AS related_id, round_even(score, 3) AS score, row_number() OVER (PARTITION BY query ORDER BY r) AS rank
    FROM twelve JOIN chunks USING (id) WHERE chunks.doc <> from_doc QUALIFY rank <= 3""",
)
def related_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every twentieth page of each document: of the twelve pages most like it, the first three in other documents."""
    pages = table(spark, sf_dir, "chunks")
    index = kept_index(spark, sf_dir, "chunks", "id")
    top = retrieval.key_terms(index, 8)
    stated = pages.where("page % 20 = 0").select(F.col("id").alias("page"))
    asked = top.join(stated, "page", "left_semi").select(F.col("page").alias("query"), "term", F.lit(1).alias("times"))
    twelve = retrieval.best(retrieval.scores(index, asked).where("query <> page"), 12)
    docs = pages.select(F.col("id").alias("page"), "doc")
    other = twelve.join(docs, "page").join(docs.select(F.col("page").alias("query"), F.col("doc").alias("from_doc")), "query").where("doc <> from_doc")
    order = W.partitionBy("query").orderBy("rank")
    return other.withColumn("r", F.row_number().over(order)).where("r <= 3").select("query", F.col("page").alias("related_id"), F.bround("score", 3).alias("score"), F.col("r").alias("rank"))


def _kind_sql() -> str:
    return ", ".join(f"({n}, '{k}', {w}, regexp_matches(s, '{insights.sql_rule(r)}'))" for n, (k, r, w) in enumerate(insights.KINDS))


@READING.query(
    "key_points",
    f"""WITH p AS (SELECT id, {sql_squash('text')} AS t FROM chunks), l AS (SELECT id, {sql_sentences('t')} AS l FROM p),
    s AS (SELECT id, unnest(l) AS s, (generate_subscripts(l, 1) - 1)::INT AS pos FROM l),
    hit AS (SELECT id, pos, s, k.n, k.kind, k.weight FROM s, LATERAL (VALUES {_kind_sql()}) AS k(n, kind, weight, hit) WHERE length(s) BETWEEN 40 AND 600 AND k.hit),
    scored AS (SELECT id, pos, s, arg_min(kind, n - 100 * weight) AS kind, sum(weight) AS score FROM hit GROUP BY id, pos, s),
    first AS (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY score DESC, pos) AS in_kind FROM scored),
    picked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY in_kind > 1, score DESC, pos) AS r FROM first QUALIFY r <= 5)
    SELECT id, pos, kind, score::INT AS score, s AS sentence FROM picked""",
)
def key_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.key_points(table(spark, sf_dir, "chunks"), "id", "text")


@READING.query(
    "cross_references",
    r"""WITH m AS (SELECT id, regexp_extract_all(text, '(?i)\b(?:section|clause|article)\s+\d{1,3}[A-Z]?') AS l FROM chunks),
    each AS (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM m),
    parts AS (SELECT id, i, lower(regexp_extract(x, '^[A-Za-z]+')) AS kind, upper(regexp_extract(x, '\d.*$')) AS number FROM each)
    SELECT id, kind, number, row_number() OVER (PARTITION BY id ORDER BY i) AS rank FROM (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY id, number ORDER BY i) = 1) QUALIFY rank <= 6""",
)
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.cross_references(table(spark, sf_dir, "chunks"), "id", "text")


@READING.query("page_blocks")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.page_blocks(table(spark, sf_dir, "chunks"), ["id", "doc", "page"])


@READING.query("outline")
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.outline(structure.page_blocks(table(spark, sf_dir, "chunks"), ["doc", "page"]))


@READING.query("section_at")
def section_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "chunks")
    heads = materialise(structure.outline(structure.page_blocks(pages, ["doc", "page"])))
    return structure.sections(pages, heads)


_UNIFIED_SQL = (
    _BM25_SQL
    + f""", noted AS (SELECT id, t, len(t) AS len FROM (SELECT id, {sql_tokens("concat_ws(' ', selection, answer, comment, session)")} AS t FROM (SELECT DISTINCT * FROM notes))),
    npost AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len, unnest(t) AS term FROM noted) GROUP BY ALL),
    nscored AS (SELECT query, id, sum(tf / (1 + sqrt(len))) AS score FROM asked JOIN npost USING (term) GROUP BY ALL)
    SELECT 'page' AS kind, query, doc_id::VARCHAR AS hit, round_even(score, 3) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 8
    UNION ALL SELECT 'note', query, id, round_even(score, 3), row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM nscored QUALIFY rank <= 8"""
)


@READING.query("unified_search", _UNIFIED_SQL)
def unified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight documents and eight notes for each stated query, told apart by kind."""
    items = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0")
    asked = retrieval.query_terms(items, "item_id", "text")
    found = retrieval.best(_searched(spark, sf_dir), 8)
    notes = table(spark, sf_dir, "notes").dropDuplicates(["id"])
    noted = retrieval.best(retrieval.note_scores(notes, "id", F.concat_ws(" ", "selection", "answer", "comment", "session"), asked), 8)
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), "query", F.col("page").cast("string").alias("hit"), F.bround("score", 3).alias("score"), "rank")
    return one(found, "page").unionByName(one(noted, "note"))
