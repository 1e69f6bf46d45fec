"""Documents as they arrive: a file stream of pages whose batches go through the same plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def page_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_batches(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch through ``plan``, written under its own number: a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, ts: str, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Pages a source delivered in each window; what comes later than ``late`` is left out: ``window_start, source, pages``."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), "source").agg(F.count("*").alias("pages")).select(F.col("w.start").alias("window_start"), "source", "pages")
