"""Rates, ratios and percentiles over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds in seconds of the latency buckets.
BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0]


def error_ratios(events: DataFrame, at: str, failed: Column, length: str, by: list[str]) -> DataFrame:
    """(by, window_start, n_events, n_errors, ratio) in windows of `length`."""
    grouped = events.groupBy(F.window(at, length).alias("w"), *by)
    return grouped.agg(F.count("*").alias("n_events"), F.count_if(failed).alias("n_errors")).select(
        *by, F.col("w.start").alias("window_start"), "n_events", "n_errors", (F.col("n_errors") / F.col("n_events")).alias("ratio")
    )


def shares(events: DataFrame, at: str, hit: Column, length: str, every: str) -> DataFrame:
    """(window_start, n_events, n_hits, share) in windows of `length`, one every `every`."""
    grouped = events.groupBy(F.window(at, length, every).alias("w")).agg(F.count("*").alias("n_events"), F.count_if(hit).alias("n_hits"))
    return grouped.select(F.col("w.start").alias("window_start"), "n_events", "n_hits", (F.col("n_hits") / F.col("n_events")).alias("share"))


def burning(ratios_short: DataFrame, ratios_long: DataFrame, by: list[str], budget: float, factor: float = 14.4) -> DataFrame:
    """Short windows in which the error ratio burns the budget `factor` times too fast, in the long window around them as well."""
    long_ = ratios_long.select(*by, F.col("window_start").alias("long_start"), F.col("ratio").alias("long_ratio"))
    within = ratios_short.withColumn("long_start", F.date_trunc("hour", "window_start"))
    limit = factor * budget
    return within.join(long_, [*by, "long_start"]).where((F.col("ratio") > limit) & (F.col("long_ratio") > limit))


def bucket_counts(events: DataFrame, seconds: Column, by: list[str]) -> DataFrame:
    """(by, le, n): cumulative counts per latency bucket, the last one open."""
    first = F.lit(len(BUCKETS))
    for n in range(len(BUCKETS) - 1, -1, -1):
        first = F.when(seconds <= BUCKETS[n], n).otherwise(first)
    counts = events.where(seconds.isNotNull()).groupBy(*by, first.alias("b")).agg(F.count("*").alias("n"))
    spread = counts.select(*by, F.explode(F.sequence("b", F.lit(len(BUCKETS)))).alias("b"), "n")
    return spread.groupBy(*by, "b").agg(F.sum("n").alias("n"))


def quantile(buckets: DataFrame, q: float, by: list[str]) -> DataFrame:
    """(by, value): the quantile interpolated within its bucket; the open bucket yields the last bound."""
    rows = buckets.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("h"))  # as many as there are buckets
    total = F.element_at("h", -1)["n"]
    hit = F.get(F.filter("h", lambda x: x["n"] >= q * total), F.lit(0))
    below = F.coalesce(F.array_max(F.transform(F.filter("h", lambda x: x["b"] < hit["b"]), lambda x: x["n"])), F.lit(0))
    bounds = F.array(*[F.lit(x) for x in [0.0, *BUCKETS]])
    lo, hi = F.get(bounds, hit["b"]), F.get(bounds, hit["b"] + 1)
    inside = lo + (hi - lo) * (q * total - below) / (hit["n"] - below)
    return rows.select(*by, F.when(hit["b"] >= len(BUCKETS), F.lit(BUCKETS[-1])).otherwise(inside).alias("value"))
