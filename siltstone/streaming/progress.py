"""Progress of streams as rows of a table."""

from __future__ import annotations

import threading

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Writes (name, batch, rows, rows_per_second) of each batch of the streams of one name to a table, `every` batches at a time and at the end.

        with Progress(spark, "import", path):
            stream.writeStream.queryName("import")...
    """

    SCHEMA = "name string, batch long, rows long, rows_per_second double"

    def __init__(self, spark: SparkSession, name: str, path: str, every: int = 25):
        self.spark, self.name, self.path, self.every = spark, name, path, every
        self._rows: list[tuple] = []
        self._runs: set[str] = set()
        self._open = threading.Condition()

    def __enter__(self) -> Progress:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        with self._open:  # events come after the query has ended
            self._open.wait_for(lambda: not self._runs, timeout=30)
        self.spark.streams.removeListener(self)
        self._flush()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            with self._open:
                self._runs.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self.name:
            with self._open:
                self._rows.append((p.name, p.batchId, p.numInputRows, float(p.processedRowsPerSecond or 0)))
                full = len(self._rows) >= self.every
            if full:
                self._flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._open:
            self._runs.discard(str(event.runId))
            self._open.notify_all()

    def _flush(self) -> None:
        with self._open:
            rows, self._rows = self._rows, []
        if rows:
            self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
