"""Benchmark reports: summaries, differences to a reference, timing statistics by nearest rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def output_summary(values: DataFrame, group: str, value: str) -> DataFrame:
    """n, finite, min_value, max_value, sum_value of each group's values."""
    v = F.col(value).cast("double")
    return values.groupBy(group).agg(F.count(v).alias("n"), F.bool_and(~F.isnan(v) & (F.abs(v) < float("inf"))).alias("finite"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.sum(v).alias("sum_value"))


def reference_diff(actual: DataFrame, expected: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """max_abs, mean_abs and threshold mismatches (at 0.5) of each group, over the elements that both have."""
    both = actual.select(*keys, F.col(value).cast("double").alias("a")).join(expected.select(*keys, F.col(value).cast("double").alias("e")), keys)
    gap = F.abs(F.col("a") - F.col("e"))
    return both.groupBy(group).agg(F.max(gap).alias("max_abs"), F.avg(gap).alias("mean_abs"), F.count_if((F.col("a") >= 0.5) != (F.col("e") >= 0.5)).alias("threshold_mismatches"))


def argmax_mismatches(actual: DataFrame, expected: DataFrame, group: str, row: str, cls: str, value: str) -> DataFrame:
    """rows and mismatches: rows of a group whose largest class, the last of equal ones, differs."""

    def best(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(group, row).agg(F.max(F.struct(F.col(value), F.col(cls)))[cls].alias(name))

    both = best(actual, "a").join(best(expected, "e"), [group, row])
    return both.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("a") != F.col("e")).alias("mismatches"))


def timing_statistics(samples: DataFrame, group: str, milliseconds: str) -> DataFrame:
    """n, average_ms, p50_ms, p90_ms, p95_ms, throughput_per_second; percentiles are samples, at the nearest rank.

    Equal samples are counted first, so the ranks come from a running sum over distinct values and no group is sorted whole.
    """
    counted = samples.groupBy(group, F.col(milliseconds).cast("double").alias("ms")).agg(F.count(F.lit(1)).alias("k"))
    whole = Window.partitionBy(group)
    ranked = counted.withColumn("upto", F.sum("k").over(whole.orderBy("ms"))).withColumn("n", F.sum("k").over(whole)).withColumn("sum_ms", F.sum(F.col("ms") * F.col("k")).over(whole))

    def percentile(p: float) -> Column:
        place = F.round((F.col("n") - 1) * F.lit(p))
        return F.min(F.when(F.col("upto") > place, F.col("ms")))

    out = ranked.groupBy(group).agg(F.max("n").alias("n"), (F.max("sum_ms") / F.max("n")).alias("average_ms"), percentile(0.5).alias("p50_ms"), percentile(0.9).alias("p90_ms"), percentile(0.95).alias("p95_ms"))
    return out.withColumn("throughput_per_second", 1000.0 / F.col("average_ms"))
