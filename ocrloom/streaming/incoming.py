"""The same flow over images or heatmaps that arrive, in micro-batches; not a part of what one-image tools do.

Detection iterates until its components are settled, which a streaming plan can't express, so a batch is transformed as a
table. Windowed counts of what was found run as a plain streaming aggregation with a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run_on_arrival(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Parquet files that arrive in source go through transform and are appended to out, each batch once: a batch that is
    run again writes its own folder again. Ends when what is there has been read."""

    def one(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_over_time(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per key and time window; rows later than `late` behind the newest time don't count. Works on streams and tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
