"""Lookups by keys of which a few may stand on very many rows."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key on more than this part of all rows is hot; there are fewer such keys than this number.
HOT_SHARE = 1000


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or what the context already has.

    Where neither is set, a local master, whose driver and tasks are one process, gets a folder of its own; a cluster has no
    place that they all see, which is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="ocrloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder: never into executors' own, so it survives the loss of any."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys on more than 1 / HOT_SHARE of the rows: fewer than HOT_SHARE of them, whatever the table."""
    counts = rows.groupBy(*keys).count()
    return cut_lineage(counts.where(F.col("count") * HOT_SHARE > rows.count()).select(*keys))


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame | None = None) -> DataFrame:
    """rows joined with table, which has a row for each key. Rows of hot keys stay where they lie and meet a broadcast of
    those keys' entries, which are fewer than HOT_SHARE; the others are shuffled, and none of their keys is large.

    rows is read several times: give a table or a checkpoint. Rows whose key is null or isn't in table go.
    """
    hot = hot_keys(rows, keys) if hot is None else hot
    entries = F.broadcast(table.join(F.broadcast(hot), keys, "left_semi"))
    out = rows.join(entries, keys)
    return out.unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys))
