import random

import pytest
from pyspark.sql import functions as F

from leafmill.llm import mix

WORDS = "the a policy of report water land to be kept by each"


def make(spark, n=1500, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choice(["A_one", "a-one ", "b_two", "b_two", "b_two", "c_three", "other", None])
        rows.append((i, " ".join(rng.choice(WORDS.split()) for _ in range(rng.randint(5, 60))), s, "x"))
    rows += [(5000, None, "a_one", ""), (5001, "", "b_two", ""), (None, "text without an id", "c_three", ""), (1, rows[1][1], "a_one", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")
    targets = spark.createDataFrame([("a_one", 0.5, 2), ("b_two", 0.2, 1), ("C_three", 0.2, 3), ("none", 0.1, 4), (None, 0.3, 1), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    return docs, targets


def test_shares_are_met(spark):
    docs, targets = make(spark)
    got = {r.source: r for r in mix.shares(docs, targets).collect()}
    assert set(got) == {"a_one", "b_two", "c_three", "none"}
    assert got["none"].state == "no documents" and got["none"].mixed_tokens == 0
    for s, want in (("a_one", 5 / 9), ("b_two", 2 / 9), ("c_three", 2 / 9)):
        assert got[s].state == "met" and got[s].actual_share == pytest.approx(want, abs=2e-3)
        assert got[s].most_copies <= got[s].max_repeats
    assert max(r.mixed_tokens / (r.available_tokens * r.max_repeats) for r in got.values() if r.available_tokens) == pytest.approx(1, abs=1e-3)


def test_asked_total_leaves_short_sources(spark):
    docs, targets = make(spark)
    free = {r.source: r for r in mix.shares(docs, targets).collect()}
    total = 3 * sum(r.mixed_tokens for r in free.values())
    got = {r.source: r for r in mix.shares(docs, targets, total).collect()}
    short = [s for s, r in got.items() if r.state == "short"]
    assert short and all(got[s].mixed_tokens == got[s].available_tokens * got[s].max_repeats for s in short)


def test_collection_matches_report(spark):
    docs, targets = make(spark)
    rows = mix.collection(docs, targets)
    assert rows.columns == ["doc_id", "source", "tokens", "copies"]
    by = {r.source: r.t for r in rows.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()}
    assert by == {r.source: r.mixed_tokens for r in mix.shares(docs, targets).collect() if r.mixed_tokens}


def test_rates_solve_the_balance(spark):
    docs, targets = make(spark)
    sources = mix.read_targets(targets)
    sized = mix.sized_documents(docs, sources)
    rate = mix.solve(sized, sources, 5000)
    for r in mix.with_rates(sized, sources, rate).groupBy("source").agg(F.sum(F.col("rate") * F.col("tokens")).alias("t")).collect():
        assert r.t == pytest.approx(sources[r.source].goal, rel=1e-6)


def test_rounding_keeps_sums(spark):
    docs, targets = make(spark)
    sources = mix.read_targets(targets)
    sized = mix.sized_documents(docs, sources)
    rate = mix.solve(sized, sources)
    for r in mix.rounded(mix.with_rates(sized, sources, rate)).groupBy("source").agg(F.sum("rate").alias("r"), F.sum("copies").alias("c"), F.max(F.col("copies") - F.col("cap")).alias("over"), F.max(F.abs(F.col("copies") - F.col("rate"))).alias("off")).collect():
        assert abs(r.r - r.c) <= 1 and r.over <= 0 and r.off < 1.001


def test_nothing_usable(spark):
    docs, targets = make(spark)
    assert mix.collection(docs.limit(0), targets).count() == 0
    assert mix.collection(docs, targets.limit(0)).count() == 0
    assert {r.state for r in mix.shares(docs.limit(0), targets).collect()} == {"no documents"}


def test_token_counter(spark):
    import tiktoken  # noqa: F401

    df = spark.createDataFrame([("hello world",), (None,), ("",), ("<|endoftext|>",)], "t string")
    assert [r.n for r in df.select(mix.token_counter()("t").alias("n")).collect()] == [2, 0, 0, 7]


def test_rates_that_do_not_converge_are_an_error(spark):
    docs, targets = make(spark)
    sources = mix.read_targets(targets)
    sized = mix.sized_documents(docs, sources)
    with pytest.raises(RuntimeError, match="converge"):
        mix.solve(sized, sources, 3000, steps=1)


def test_a_collection_of_all_there_is(spark, data_dir):
    """Most documents are used; no cap is broken, and every source is within a document of its goal."""
    docs, targets = spark.read.parquet(f"{data_dir}/documents.parquet"), spark.read.parquet(f"{data_dir}/mix_targets.parquet")
    chosen, sources = mix.mixed(docs, targets, mix.AVAILABLE)
    rows = chosen.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("t"), F.max("tokens").alias("largest"), F.max(F.col("copies") - F.col("cap")).alias("over"), F.count_if(F.col("copies") > 0).alias("used"), F.count("*").alias("n"), F.min("copies").alias("least")).collect()
    assert sum(r.used for r in rows) > 0.5 * sum(r.n for r in rows)
    for r in rows:
        assert r.over <= 0 and r.least >= 0 and abs(r.t - sources[r.source].goal) <= r.largest
