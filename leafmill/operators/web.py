"""Ranking of web results by the quality of their source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions.text import excerpt, normalise_url, source_tier, url_host


def ranked(results: DataFrame, k: int = 8) -> DataFrame:
    """(query, rank, url, domain, tier, tier_label, title) of results (query, provider_no, pos, title, url, snippet).

    A result's place counts before any is dropped: rank in its batch plus half the provider's number. URLs that are not http(s) are dropped, a
    URL counts once per query, in the first batch that has it; better tiers come first. Null titles fall back to the host."""
    placed = results.select(
        "query", "provider_no", "pos", normalise_url(F.col("url")).alias("url"), (F.col("pos") + 0.5 * F.col("provider_no")).alias("place"), "title"
    ).where("url IS NOT NULL")
    first = placed.groupBy("query", "url").agg(F.min(F.struct("provider_no", "pos", "place", "title")).alias("m"))
    host = url_host(F.col("url"))
    judged = first.select("query", "url", host.alias("domain"), source_tier(host).alias("t"), "m.provider_no", "m.pos", "m.place", "m.title")
    order = W.partitionBy("query").orderBy("t.tier", "place", "provider_no", "pos")
    top = judged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    title = excerpt(F.regexp_replace(F.coalesce("title", F.lit("")), "<[^>]+>", ""), 200)
    return top.select("query", "rank", "url", "domain", "t.tier", "t.tier_label", F.when(title != "", title).otherwise(F.col("domain")).alias("title"))
