"""Keyed tables that streams write to: exactly once for each batch, and only the buckets that a batch touches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import upserted
from ..session import exists

#: Buckets of keys: a batch rewrites those that it touches.
BUCKETS = 64


@dataclass
class KeyedTable:
    """The newest row of each key, by order, under a folder of the shared store.

    Rows lie in files by version and bucket; a manifest names the version of each bucket after each batch, and is written
    last. A batch whose manifest is there is skipped, so a batch that is replayed, or delivered again after a failure, changes nothing; one
    that failed on its way is written again over what it left.
    """

    spark: SparkSession
    path: str
    schema: str
    key: Sequence[str]
    order: str
    buckets: int = BUCKETS

    def _manifests(self) -> DataFrame:
        schema = "seq long, source string, batch long, versions map<int,long>"
        if not exists(self.spark, f"{self.path}/manifest"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/manifest")

    def _last(self) -> tuple[int, dict[int, int]]:
        """The number of the last batch that was committed, and the version of each bucket that has rows: at most `buckets` numbers."""
        last = self._manifests().orderBy(F.col("seq").desc()).select("seq", "versions").first()
        return (last.seq, dict(last.versions)) if last else (0, {})

    def committed(self, batch: int, source: str = "") -> bool:
        return not self._manifests().filter((F.col("batch") == batch) & (F.col("source") == source)).isEmpty()

    def _read(self, versions: dict[int, int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/rows/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        return self._read(self._last()[1])

    def apply(self, changes: DataFrame, batch: int, source: str = "") -> bool:
        """Upsert a batch of rows of a source; False if it was committed before."""
        if self.committed(batch, source):
            return False
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        changes = changes.select(*self.spark.createDataFrame([], self.schema).columns)
        seq, old = self._last()
        seq += 1
        touched = [r[0] for r in changes.select(bucket.alias("b")).distinct().collect()]  # at most `buckets` numbers
        merged = upserted(self._read({b: old[b] for b in touched if b in old}), changes, list(self.key), self.order)
        if touched:
            merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={seq}")
        row = self.spark.createDataFrame([(seq, source, batch, old | {b: seq for b in touched})], "seq long, source string, batch long, versions map<int,long>")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return True

    def feed(self, stream: DataFrame, checkpoint: str, source: str = "") -> None:
        """Upsert all batches of a stream until it has no more."""
        start = stream.writeStream.foreachBatch(lambda df, batch: self.apply(df, batch, source)).option("checkpointLocation", checkpoint)
        start.trigger(availableNow=True).start().awaitTermination()
