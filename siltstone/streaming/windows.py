"""Event-time streams: windows, sessions, duplicates, with late rows bounded by a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replay(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream; times without a zone are taken in the session's, as watermarks need."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")
    return rows.select(*(F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema.fields))


def tumbling(events: DataFrame, ts: str, length: str, late: str, key: Sequence[str], value: str) -> DataFrame:
    """(start, key, n, total) per window and key; state goes with the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), *key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *key, "n", "total")


def sliding(events: DataFrame, ts: str, length: str, step: str, late: str, key: Sequence[str], value: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, length, step).alias("w"), *key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), *key, "n", "mean")


def sessions(events: DataFrame, ts: str, gap: str, late: str, key: Sequence[str]) -> DataFrame:
    """(key, start, end, n) of runs without a gap of this length."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *key).agg(F.count(F.lit(1)).alias("n")).select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def unique(events: DataFrame, ts: str, late: str, key: Sequence[str]) -> DataFrame:
    """The first of events of equal key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(key))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Run what there is to the end, into files; starting again goes on where it ended."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return q


def to_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run what there is to the end, into a named table on the driver: for small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
