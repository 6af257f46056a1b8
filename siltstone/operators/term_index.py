"""A TF-IDF index in segments: additions, replacements and removals write what they change, and searches read what is live.

Under a folder of the shared store, segment k has the stems and ids of the documents that one call added, or the ids that it removed. A
document is a row with its stems in their order, of which a search counts the terms, so what finds the live ones moves a row for each. An id in segment k ends the same id in all earlier ones, so
nothing old is rewritten or read by a change; a search counts the documents with a term where it brings a term's postings together to weigh them. A manifest
of the segments in use is written last: a call that fails on the way leaves the index as it was. compact() writes the live documents as one segment.
Documents are read twice by add(), so they must be files or another deterministic scan.

Defined cases: a document without terms counts as one; null text has no terms; a null id is left out; of rows that repeat an id in one call
one counts (that with the largest text); an index without documents finds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import exists, saved
from .search import cosine_topk
from .terms import postings, stem_vectors, stemmed

_POSTINGS = "id {kind}, words int, stems string"
#: Ended documents up to which they may be sent to all tasks.
ENDED = 1 << 20


@dataclass
class SegmentedIndex:
    """The index of a folder at one version of its manifest."""

    spark: SparkSession
    path: str
    kind: str = "bigint"  # of the ids
    version: int = 0
    segments: list[int] = field(default_factory=list)
    documents: int = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, kind: str = "bigint") -> SegmentedIndex:
        """The newest version of a folder's index; an empty one where there is none."""
        out = cls(spark, path, kind)
        if exists(spark, f"{path}/manifest"):
            last = spark.read.parquet(f"{path}/manifest").orderBy(F.col("version").desc()).first()
            out.version, out.segments, out.documents = last.version, list(last.segments), last.documents
        return out

    def __len__(self) -> int:
        return self.documents

    def _read(self, what: str, schema: str) -> DataFrame:
        if not self.segments:
            return self.spark.createDataFrame([], f"{schema}, segment int")
        paths = [f"{self.path}/{what}/segment={k}" for k in self.segments]
        return self.spark.read.schema(f"{schema}, segment int").option("basePath", f"{self.path}/{what}").parquet(*paths)

    def live(self) -> DataFrame:
        """(id, segment): the documents, each in the segment that has its newest text."""
        ids = self._read("ids", f"id {self.kind}, alive boolean")
        last = ids.groupBy("id").agg(F.max(F.struct("segment", "alive")).alias("last"))
        return last.filter("last.alive").select("id", F.col("last.segment").alias("segment"))

    def stems(self) -> DataFrame:
        """(id, words, stems) of the live documents.

        A segment of which all is live is read as it is, one of which nothing is live is not read.
        """
        rows = self._read("postings", _POSTINGS.format(kind=self.kind))
        if len(self.segments) > 1:
            ids = self._read("ids", f"id {self.kind}, alive boolean").filter("alive").select("id", "segment")
            ended = ids.join(self.live(), ["id", "segment"], "left_anti")
            held, gone = ({r.segment: r["count"] for r in df.groupBy("segment").count().collect()} for df in (ids, ended))
            mixed = [k for k in held if 0 < gone.get(k, 0) < held[k]]
            whole = rows.filter(F.col("segment").isin([k for k in held if not gone.get(k)]))
            if mixed:
                ended = ended.filter(F.col("segment").isin(mixed))
                ended = F.broadcast(ended) if sum(gone[k] for k in mixed) <= ENDED else ended
                whole = whole.unionByName(rows.filter(F.col("segment").isin(mixed)).join(ended, ["id", "segment"], "left_anti"))
            rows = whole
        return rows.select("id", "words", "stems")

    def vectors(self) -> DataFrame:
        """(id, size, terms, tf) of the live documents; terms are 64-bit hashes."""
        return stem_vectors(self.stems())

    def postings(self) -> DataFrame:
        """(id, term, tf) of the live documents."""
        return postings(self.vectors())

    def frequencies(self) -> DataFrame:
        """(term, df) of the live documents."""
        return self.postings().groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def _commit(self, segments: list[int], documents: int) -> None:
        row = self.spark.createDataFrame([(self.version + 1, segments, documents)], "version int, segments array<int>, documents long")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self.version, self.segments, self.documents = self.version + 1, segments, documents

    def _write(self, ids: DataFrame, stems: DataFrame | None, alive: bool) -> None:
        """A new segment: ids that are added or removed, and stems of the added ones."""
        # a number of its own, also after a call that failed: its files are never in a manifest
        k = max([*self.segments, self.version * 1000]) + 1
        while exists(self.spark, f"{self.path}/ids/segment={k}"):
            k += 1
        to = lambda df, what: df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").option("parquet.page.size", str(8 << 20)).parquet(f"{self.path}/{what}/segment={k}")
        to(ids.select("id", F.lit(alive).alias("alive")), "ids")
        ids = self.spark.read.parquet(f"{self.path}/ids/segment={k}").select("id")
        if stems is None:
            stems = self.spark.createDataFrame([], _POSTINGS.format(kind=self.kind))
        to(stems, "postings")
        ended = self.live().join(ids, "id", "left_semi").count() if self.segments else 0
        self._commit([*self.segments, k], self.documents - ended + (ids.count() if alive else 0))

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SegmentedIndex:
        """Add documents, or replace those whose id is known."""
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
        if not rows.groupBy("id").count().filter("count > 1").isEmpty():
            rows = saved(rows.groupBy("id").agg(F.max("text").alias("text")), "index-docs")
        self._write(rows.select("id"), stemmed(rows, "id", "text"), True)
        return self

    def remove(self, ids: DataFrame) -> SegmentedIndex:
        """Remove documents (id); unknown ids change nothing."""
        known = ids.select(F.col("id")).distinct().join(self.live(), "id", "left_semi")
        self._write(known, None, False)
        return self

    def clear(self) -> SegmentedIndex:
        self._commit([], 0)
        return self

    def compact(self) -> SegmentedIndex:
        """The live documents as one segment; the old segments' files stay for readers of older versions."""
        if len(self.segments) < 2:
            return self
        ids, stems = saved(self.live().select("id"), "index-ids"), self.stems()
        whole = SegmentedIndex(self.spark, self.path, self.kind, self.version)
        whole._write(ids, stems, True)
        self.version, self.segments, self.documents = whole.version, whole.segments, whole.documents
        return self

    def search(self, queries: DataFrame, k: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """(query, id, score, rank): the k best documents of each query by the cosine of its TF with their TF-IDF; ties go to the smaller id.

        The length of a document changes with every document added, so lengths are computed in the search, for documents that are met alone.
        """
        return cosine_topk(self.stems(), self.documents, queries, k, id_col, text_col)
