"""Streams of rows into stored tables, and running counts; what batch queries read stays fresh by them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def upserted(stream: DataFrame, path: str, key: str, version: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each batch's rows, of each key the one of greatest version, with the batch's number; a batch that
    runs again writes its folder again. `latest` reads the table they make.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct("*"), F.col(version)).alias("_r")).select("_r.*")
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(table: DataFrame, key: str, version: str) -> DataFrame:
    """Of each key the row of greatest version, then of the latest batch."""
    picked = F.max_by(F.struct("*"), F.struct(version, "batch"))
    return table.groupBy(key).agg(picked.alias("_r")).select("_r.*").drop("batch")


def windowed_counts(stream: DataFrame, time: str, keys: list[str], late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Rows of each key in each window of event time, final once the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def fresh_only(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, name: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda x: x, mode: str = "append") -> DataFrame:
    """All rows available now, through the transform, into a table in memory: for tests and small streams."""
    q = transform(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
