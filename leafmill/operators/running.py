"""Running aggregates over long keys.

A window over a key brings all its rows into one task. Here rows fall into buckets of the order column first; the buckets
are aggregated before the shuffle, their running values are windows over one row per bucket, and the rows themselves
meet only within their bucket. A key that holds a third of all rows is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, value: Column, how: str, name: str, before: bool = True) -> DataFrame:
    """`df` with column `name`: the sum or maximum (`how`) of `value` over the earlier rows of the key (`before`), or over this and
    all later rows (not `before`). `bucket` must be monotone in `order`. Null where there are none."""
    agg = {"sum": F.sum, "max": F.max}[how]
    rows = df.withColumns({"_run_bucket": bucket, "_run_value": value})
    total = rows.groupBy(*keys, "_run_bucket").agg(agg("_run_value").alias("_run_total"))
    along = W.partitionBy(*keys).orderBy("_run_bucket")
    frame = along.rowsBetween(W.unboundedPreceding, -1) if before else along.rowsBetween(1, W.unboundedFollowing)
    total = total.select(*keys, "_run_bucket", agg("_run_total").over(frame).alias("_run_base"))
    inside = W.partitionBy(*keys, "_run_bucket").orderBy(*order)
    near = inside.rowsBetween(W.unboundedPreceding, -1) if before else inside.rowsBetween(0, W.unboundedFollowing)
    rows = rows.withColumn("_run_near", agg("_run_value").over(near))
    same = None
    for k in [*keys, "_run_bucket"]:
        c = rows[k].eqNullSafe(total[k])
        same = c if same is None else same & c
    joined = rows.join(total, same, "left").select(*[rows[c] for c in rows.columns], total["_run_base"])
    both = F.coalesce(F.col("_run_base"), F.lit(0)) + F.coalesce(F.col("_run_near"), F.lit(0)) if how == "sum" else F.greatest("_run_base", "_run_near")
    out = F.when(F.col("_run_base").isNotNull() | F.col("_run_near").isNotNull(), both)
    return joined.withColumn(name, out).drop("_run_bucket", "_run_value", "_run_base", "_run_near")
