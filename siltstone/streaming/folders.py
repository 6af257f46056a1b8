"""A watched folder: new files come as a stream, what changed or went is found against the last listing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import exists
from .stateful import watched
from .upserts import KeyedTable

_SCHEMA = "path string, at timestamp, size long, gone boolean"
#: Of Spark's source of whole files.
_BINARY = "path string, modificationTime timestamp, length long, content binary"


@dataclass
class FolderWatch:
    """The files of a folder, of some extensions and up to a size, as they were at the last check.

    Each change is reported once: the rows of a run are written before the run is committed, and a run that was committed is not repeated.
    """

    spark: SparkSession
    folder: str
    state: str
    extensions: Sequence[str]
    max_bytes: int = 5 << 20
    max_files: int = 500  # of a batch of new files

    @property
    def files(self) -> KeyedTable:
        """(path, at, size, gone): the newest that is known of each file."""
        return KeyedTable(self.spark, f"{self.state}/files", _SCHEMA, ["path"], "at", buckets=8)

    def _slim(self, listing: DataFrame) -> DataFrame:
        rows = listing.select("path", F.col("modificationTime").alias("at"), F.col("length").alias("size"), F.lit(False).alias("gone"))
        return watched(rows, list(self.extensions), self.max_bytes)

    def _report(self, changes: DataFrame, source: str, batch: int) -> None:
        """Write (path, change) and then the files, unless the batch was committed before."""
        if self.files.committed(batch, source):
            return
        changes.select("path", "change").write.mode("overwrite").parquet(f"{self.state}/changes/source={source}/batch={batch}")
        self.files.apply(changes, batch, source)

    def _new(self, listing: DataFrame, batch: int) -> None:
        known = self.files.read().filter("NOT gone").select("path")
        self._report(self._slim(listing).join(known, "path", "left_anti").withColumn("change", F.lit("added")), "new", batch)

    def check(self) -> None:
        """One run: files that are new since the last one (the stream's checkpoint), then those that changed, came back or went."""
        stream = self.spark.readStream.format("binaryFile").schema(_BINARY).option("maxFilesPerTrigger", self.max_files).load(self.folder)
        start = stream.drop("content").writeStream.foreachBatch(self._new).option("checkpointLocation", f"{self.state}/checkpoint")
        start.trigger(availableNow=True).start().awaitTermination()
        now = self._slim(self.spark.read.format("binaryFile").load(self.folder).drop("content"))  # content is not read
        last = self.files.read().select(F.col("path").alias("_p"), F.col("at").alias("_at"), F.col("gone").alias("_gone"))
        both = now.join(last, F.col("path") == F.col("_p"), "full_outer")
        change = F.when(F.col("path").isNull() & ~F.col("_gone"), "deleted").when(F.col("_gone") & F.col("path").isNotNull(), "added").when(F.col("at") > F.col("_at"), "changed")
        # a file that went keeps its time: one that comes back with the same is added again
        rows = both.select(F.coalesce("path", "_p").alias("path"), F.coalesce("at", F.col("_at") + F.expr("INTERVAL 1 MICROSECOND")).alias("at"), F.coalesce("size", F.lit(0)).alias("size"), F.col("path").isNull().alias("gone"), change.alias("change"))
        rows = rows.filter("change IS NOT NULL")
        runs = self.files._manifests().filter("source = 'run'").count()
        self._report(rows.withColumn("at", F.when(F.col("change") == "added", F.current_timestamp()).otherwise(F.col("at"))), "run", runs)

    def changes(self) -> DataFrame:
        """(path, change, source, batch) of all committed runs."""
        schema = "path string, change string, source string, batch long"
        if not exists(self.spark, f"{self.state}/changes"):
            return self.spark.createDataFrame([], schema)
        done = self.files._manifests().select("source", "batch")
        return self.spark.read.schema(schema).parquet(f"{self.state}/changes").join(done, ["source", "batch"], "left_semi").select("path", "change", "source", "batch")
