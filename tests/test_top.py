import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.operators import insights, retrieval
from leafmill.plans.notes import extracted


@pytest.mark.parametrize("kind", ["string", "int"])
@pytest.mark.parametrize(("asked", "cells", "again"), [(500_000, 1 << 19, 0), (3, 7, 0), (3, 7, 40)])
def test_top_is_the_best_of_all_scores(spark, monkeypatch, kind, asked, cells, again):
    """With ties, pages set apart, repeated pages, and any size of blocks."""
    monkeypatch.setattr(retrieval, "ASKED", asked)
    monkeypatch.setattr(retrieval, "CELLS", cells)
    rng = random.Random(7)
    words = ["water", "tariff", "plan", "school", "land", "budget", "harbour", "rare"]
    texts = [" ".join(rng.choices(words[:7], k=rng.randint(0, 5))) for _ in range(40)] + ["rare water", None]
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(i, t) for i, t in enumerate(texts[:again])]
    pages = spark.createDataFrame(rows, "id int, text string").select(F.col("id").cast(kind).alias("id"), "text").repartition(5)
    queries = [(q, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for q in range(12)] + [(12, ""), (13, None), (14, "unheard"), (None, "water")]
    terms = retrieval.query_terms(spark.createDataFrame(queries, "q int, t string").select(F.col("q").cast(kind).alias("q"), "t"), "q", "t")
    apart = spark.createDataFrame([(q, p) for q in range(0, 12, 2) for p in range(q, 126, 9)] + [(1, None)], "query int, page int").select(*[F.col(c).cast(kind).alias(c) for c in ("query", "page")])
    index = retrieval.build(pages, "id", "text")
    shown = lambda df: {(r.query, r["rank"]): (r.page, round(r.score, 6)) for r in df.collect()}
    want = shown(retrieval.best(retrieval.scores(index, terms.where("query IS NOT NULL")).join(apart, ["query", "page"], "left_anti"), 5))
    assert shown(retrieval.top(index, terms, 5, apart)) == want and len(want) > 40


def test_a_task_gives_away_its_best_pages_only():
    class Told:
        value = (pa.array(["q", "r"]), pa.array(["water"]), np.array([0, 2]), np.array([0, 1]), np.array([1.0, 2.0]), pa.array([], pa.string()), np.array([0]), np.array([], np.int64))

    schema = pa.schema([("query", pa.string()), ("page", pa.string()), ("score", pa.float64())])
    parts = pa.array([[{"term": "water", "share": 1.0}]] * 5000)
    got = list(retrieval._finder(Told, 3, schema)(iter(pa.RecordBatch.from_arrays([pa.array([f"{b}-{i:04}" for i in range(5000)]), parts], ["page", "parts"]) for b in range(2))))
    assert sum(len(b) for b in got) == 6 and {p for b in got for p in b.column("page").to_pylist()} == {"0-0000", "0-0001", "0-0002"}


def test_answers_make_no_rows_of_queries_and_pages(spark, monkeypatch):
    def refused(*_):
        raise AssertionError

    monkeypatch.setattr(retrieval, "scores", refused)
    rows = [(f"p{i}", "d", "D", i, "The harbour is dredged.") for i in range(9)] + [(f"x{i}", "e", "E", i, "abc" * (i + 1)) for i in range(20)]
    pages = spark.createDataFrame(rows, "id string, doc string, doc_short string, page int, text string")
    asked = spark.createDataFrame([("r1", "ask", "harbour dredged", "p1", True)], "request_id string, mode string, selection string, chunk_id string, web boolean")
    notes = spark.createDataFrame([], "id string, chunk_id string, web string")
    (got,) = extracted(asked, pages, notes).collect()
    assert [f"p.{i}]" in got.answer for i in range(6)] == [True, False, True, True, True, False]


def test_selections_are_not_laid_beside_anchors_that_no_term_has(spark):
    """A selection of many characters has as many anchors; rows with all of it go only to those of terms."""
    said = spark.createDataFrame([("k", "harbour office " * 40)], "k string, s string")
    shown = insights.matching_definitions(said, "k", "s", spark.createDataFrame([("Harbour", "x"), ("no", "y")], "term string, definition string"))
    assert [(r.k, r.term) for r in shown.collect()] == [("k", "Harbour")]
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "collect_set" in plan
