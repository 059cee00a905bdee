"""Views over the driver's tables that stand in for tensors, heatmaps, probabilities and boxes; each in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A pixel of `heat8` is active from here on.
HEAT_THRESHOLD = 0.0338


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, a: each embedding as array<double>."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(vectors(spark, sf_dir), F.col("a"), "v")


def exploded(rows: DataFrame, array: Column, name: str = "v") -> DataFrame:
    """vec_id, idx and the numbers of an array, rounded."""
    return rows.select("vec_id", F.posexplode(array).alias("idx", "x")).select("vec_id", F.col("idx").cast("long").alias("idx"), rounded(F.col("x")).alias(name))


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits) + F.lit(0.0)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, det_idx, x0, y0, w, h, score and the polygon."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey as image_id",
        "row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate) as det_idx",
        "cast(l_partkey % 700 as double) as x0", "cast(l_orderkey % 400 as double) as y0",
        "20.0D + 6.0D * l_quantity as w", "8.0D + 4.0D * l_linenumber as h", "0.5D + l_discount * 4.0D as score",
    )
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    polygon = F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))
    return rows.withColumn("polygon", polygon).withColumn("det_idx", F.col("det_idx").cast("long"))


EMB = "emb as (select vec_id, i - 1 as idx, cast(embedding[i] as double) as v from embeddings, range(1, 65) t(i))"
HEAT = f"px as (select vec_id as image_id, idx % 8 as x, idx // 8 as y, v from emb where v >= {HEAT_THRESHOLD})"
BOXES = """boxes as (select l_suppkey as image_id,
  row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate) as det_idx,
  cast(l_partkey % 700 as double) as x0, cast(l_orderkey % 400 as double) as y0,
  20.0e0 + 6.0e0 * l_quantity as w, 8.0e0 + 4.0e0 * l_linenumber as h, 0.5e0 + l_discount * 4.0e0 as score from lineitem)"""


def r6(sql: str) -> str:
    return f"round({sql}, 6) + 0e0"
