"""Reports over decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import BLOCK, FLAG, PASS


def verdict_report(decisions: DataFrame, *by: str) -> DataFrame:
    of = lambda v: F.count_if(F.col("final_verdict") == v)
    return decisions.groupBy(*by).agg(F.count(F.lit(1)).alias("events"), of(PASS).alias("passed"), of(FLAG).alias("flagged"), of(BLOCK).alias("blocked"), F.count_if(F.col("degraded_reason") != 0).alias("degraded"))


def ranked_percentiles(df: DataFrame, value: Column, percents: tuple[int, ...], *by: str) -> DataFrame:
    """The value at place n * p div 100 (from 0) of each group's sorted values, a column p<percent> each.

    Values are counted first, so a group's window holds its distinct values, not its rows."""
    counted = df.groupBy(*by, value.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*by)
    counted = counted.withColumn("_upto", F.sum("_n").over(w.orderBy("_v").rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(w))
    at = lambda p: F.floor(F.col("_all") * p / 100)
    return counted.groupBy(*by).agg(*[F.min(F.when(F.col("_upto") > at(p), F.col("_v"))).alias(f"p{p}") for p in percents])
