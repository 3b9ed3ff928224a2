"""Queries of the operators on training texts, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import leak, mix, ocr, spans, split
from leafmill.plans.registry import Registry
from leafmill.session import table

LLM = Registry()

#: Table, id and text of the fields that are split.
SPLIT_FIELDS = [("chunks", "id", "text"), ("generate_requests", "request_id", "context_text")]


@LLM.query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.repairs(table(spark, sf_dir, "chunks"))


@LLM.query("p2_repaired")
def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.repaired(table(spark, sf_dir, "chunks")).select("id", "doc", "page", "text")


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = split.limits(table(spark, sf_dir, "split_limits"))
    out = None
    for name, id_col, text_col in SPLIT_FIELDS:
        most, overlap = known[f"{name}.{text_col}"]
        part = split.oversized(table(spark, sf_dir, name), name, id_col, text_col, F.lit(most), F.lit(overlap))
        out = part if out is None else out.unionByName(part)
    return out


@LLM.query(
    "p5_found",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {i} AS item_id FROM {t}, (SELECT max_chars FROM split_limits WHERE field_name = '{t}.{x}') WHERE length({x}) > max_chars"
        for t, i, x in SPLIT_FIELDS
    ),
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bounds = split.piece_table(split.text_ranges(_oversized(spark, sf_dir)))
    return bounds.select("item").distinct().select("item.table_name", "item.item_id")


@LLM.query("p5_pieces")
def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = split.pieces(split.text_ranges(_oversized(spark, sf_dir)))
    return got.select("item.table_name", "item.item_id", "piece_no", "start_char", "end_char", "cut", "text")


_GRAMS = """SELECT {id}, unnest(list_transform(generate_series(1, len(w) - 11), lambda k: array_to_string(w[k:k+11], ' '))) AS g
    FROM (SELECT {id}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+') AS w FROM {table}) WHERE len(w) >= 12"""


@LLM.query("p6_found", f"SELECT DISTINCT doc_id, item_id FROM ({_GRAMS.format(id='doc_id', table='documents')}) JOIN ({_GRAMS.format(id='item_id', table='benchmark')}) USING (g)")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = leak.leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


_PLACED = """SELECT {id}, k, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT {id}, w, unnest(generate_series(1, len(w) - 11)) AS k
    FROM (SELECT {id}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+') AS w FROM {table}) WHERE len(w) >= 12)"""


@LLM.query(
    "p6_matches",
    f"""WITH h AS (SELECT DISTINCT doc_id AS doc, item_id AS item, d.k - 1 AS p, i.k - 1 AS q FROM ({_PLACED.format(id='doc_id', table='documents')}) d JOIN ({_PLACED.format(id='item_id', table='benchmark')}) i USING (g)),
    r AS (SELECT *, p - row_number() OVER (PARTITION BY doc, item, p - q ORDER BY p) AS run FROM h)
    SELECT doc, item, min(p) AS doc_word, min(q) AS item_word, count(*) + 11 AS n_words FROM r GROUP BY doc, item, p - q, run""",
)
def p6_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@LLM.query("p6_clean", f"SELECT doc_id, source, kind, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_GRAMS.format(id='doc_id', table='documents')}) JOIN ({_GRAMS.format(id='item_id', table='benchmark')}) USING (g))")
def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "source", "kind", "lang")


@LLM.query("p7_mix")
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.collection(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@LLM.query("p7_mix_of_available")
def p7_mix_of_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection as large as the wanted sources: most documents are used, many more than once."""
    return mix.collection(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), mix.AVAILABLE)


@LLM.query("p7_shares")
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@LLM.query("p7_shares_of_available")
def p7_shares_of_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the wanted sources have: small sources give all they may and are reported as short."""
    return mix.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), mix.AVAILABLE)


@LLM.query(
    "p8_found",
    """WITH w AS (SELECT doc_id, unnest(generate_series(1, length(text) - 399)) AS k, text FROM documents WHERE length(text) >= 400),
    h AS (SELECT doc_id, k, md5_number(substr(text, k, 400)) AS h FROM w),
    twice AS (SELECT h FROM h GROUP BY h HAVING min(doc_id) <> max(doc_id)),
    s AS (SELECT doc_id, k, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS n FROM h WHERE h IN (SELECT h FROM twice))
    SELECT doc_id, sum(least(400, coalesce(n - k, 400)))::BIGINT AS shared_chars FROM s GROUP BY doc_id""",
)
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_chars(table(spark, sf_dir, "documents"))


@LLM.query("p8_spans")
def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "documents")).select(F.col("rec").cast("long").alias("doc_id"), "start_char", "end_char")
