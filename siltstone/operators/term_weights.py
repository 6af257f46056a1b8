"""Lengths of documents and products with queries by TF-IDF, from the documents' stems, by arrays over many documents at once.

A task deals the postings of a piece by the hash of their terms: a row has those of one bucket, in order of terms, as compressed arrays of their differences,
so a posting takes about as many bytes as tell its term from the others. Where a bucket's rows meet, the documents with each term are counted and
every document's share of its length is added up; only that leaves the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved
from .terms import ROWS, counted

#: Postings of a bucket, and of a task, which has several buckets.
BUCKET, PART = 2 << 20, 16 << 20
#: Bytes of stems whose postings are dealt together, and kinds of ids that are packed.
WHOLE, WHOLES = 8 << 20, ("bigint", "int", "smallint", "tinyint")
#: Postings of queries that are sent to all tasks, products that are added at once, and documents whose lengths may be sent to all tasks.
QUERIED, ADDED, SENT = 1 << 20, 1 << 22, 1 << 20


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes: the high ones are mostly alike."""
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T), asbytes=True)


def unpacked(b: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(b, n * width, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def _dealt(stems: DataFrame, buckets: int) -> DataFrame:
    """(bucket, ids, n, docs, terms, places, times, sizes, known): the postings of a piece in a bucket, by term; places are those of their documents in ids.

    Ids that are whole numbers are packed as differences."""

    def run(batches):
        for b, c in counted(batches, True, WHOLE):
            h = c.all_hashes().view(np.uint64)
            if not len(h):
                continue
            order = np.argsort(h)
            h, doc, times = h[order], c.row[order], c.n[order].astype(np.uint32)
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            some, begin = np.unique(bucket, return_index=True)
            known = b.column(0).to_numpy(zero_copy_only=False) if whole and not b.column(0).null_count else None
            ids, ends, own, docs_of = [], [0], [[], [], [], [], []], []
            for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(h)], strict=True):
                here, place = np.unique(doc[i:j], return_inverse=True)
                docs_of.append(len(here))
                own[3].append(packed(c.size[here].astype(np.int64)))
                own[4].append(None if known is None else packed(np.diff(known[here], prepend=0).astype(np.int64)))
                here = here if known is None else here[:0]
                ids.append(here)
                ends.append(ends[-1] + len(here))
                own[0].append(packed(np.diff(h[i:j], prepend=np.uint64(0))))
                own[1].append(packed(place.astype(np.uint32)))
                own[2].append(packed(times[i:j]))
            docs, ends = np.concatenate(ids), pa.array(np.array(ends, np.int32))
            lists = pa.ListArray.from_arrays(ends, b.column(0).take(pa.array(docs)))
            count = [pa.array(np.array(x, np.int32)) for x in (np.diff(np.append(begin, len(h))), docs_of)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), lists, *count, *(pa.array(x, pa.binary()) for x in own)], names=["bucket", "ids", "n", "docs", "terms", "places", "times", "sizes", "known"])

    kind = stems.schema["id"].dataType.simpleString()
    whole = kind in WHOLES
    return stems.select("id", "stems").mapInArrow(run, f"bucket int, ids array<{kind}>, n int, docs int, terms binary, places binary, times binary, sizes binary, known binary")


def lengths(stems: DataFrame, documents: int, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, norm) of stems (id, words, stems) by the TF-IDF of their terms among so many documents, and (term, df) of the asked terms (at most QUERIED)."""
    spark = stems.sparkSession
    total = 2 * (stems.agg(F.sum("words")).first()[0] or 0)
    parts = max(-(-total // PART), 2 * spark.sparkContext.defaultParallelism)
    buckets = max(-(-total // BUCKET), 8 * parts)
    wanted = spark.sparkContext.broadcast(np.sort(asked.toArrow().column(0).to_numpy()).view(np.uint64) if asked is not None else np.empty(0, np.uint64))
    n_docs = float(max(1, documents))

    def weighed(rows):
        terms = [np.cumsum(unpacked(t, n, np.uint64), dtype=np.uint64) for _, _, n, t, _, _ in rows]
        term, which, df = np.unique(np.concatenate(terms), return_inverse=True, return_counts=True)
        squares = np.log(n_docs / df) ** 2
        begin = 0
        for ids, sizes, n, _, places, times in rows:
            place = unpacked(places, n, np.uint32)
            tf = unpacked(times, n, np.uint32) / sizes[place]
            w2 = np.bincount(place, weights=tf * tf * squares[which[begin : begin + n]], minlength=len(sizes))
            begin += n
            yield pa.RecordBatch.from_arrays([ids, pa.array(w2), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.int64())], names=names)
        found = np.flatnonzero(np.isin(term, wanted.value))
        for i in range(0, len(found), ROWS):
            at = found[i : i + ROWS]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), rows[0][0].type), pa.nulls(len(at), pa.float64()), pa.array(term[at].view(np.int64)), pa.array(df[at])], names=names)

    def run(batches):
        here, rows = None, []
        for b in batches:
            for i, bucket in enumerate(b.column(0).to_pylist()):
                if bucket != here and rows:
                    yield from weighed(rows)
                    rows = []
                here = bucket
                ids, (n, docs, terms, places, times, sizes, known) = b.column(1).slice(i, 1).flatten(), (b.column(x)[i].as_py() for x in range(2, 9))
                if known is not None:
                    ids = pa.array(np.cumsum(unpacked(known, docs, np.int64))).cast(ids.type)
                rows.append((ids, unpacked(sizes, docs, np.int64), n, terms, places, times))
        if rows:
            yield from weighed(rows)

    names = ["id", "w2", "term", "df"]
    kind = stems.schema["id"].dataType.simpleString()
    met = _dealt(stems, buckets).repartition(parts, "bucket").sortWithinPartitions("bucket")
    out = saved(met.mapInArrow(run, f"id {kind}, w2 double, term long, df long").groupBy("id", "term").agg(F.sum("w2").alias("w2"), F.sum("df").alias("df")), "index-lengths")
    return out.filter("term IS NULL").select("id", F.sqrt("w2").alias("norm")), out.filter("term IS NOT NULL").select("term", "df")


def products(stems: DataFrame, weights: DataFrame) -> DataFrame:
    """(query, id, dot): the sum over common terms of a document's TF and the weight (query, term, w; at most QUERIED rows) that a query gives the term."""
    w = weights.toArrow()
    names, query = np.unique(w.column(0).to_numpy(), return_inverse=True) if w.num_rows else (np.empty(0), np.empty(0, np.int64))
    term = w.column(1).to_numpy()
    order = np.argsort(term, kind="stable")
    terms, begin = np.unique(term[order], return_index=True)
    sent = stems.sparkSession.sparkContext.broadcast((terms, np.append(begin, len(term)), query[order], w.column(2).to_numpy()[order], pa.array(names, w.schema.field(0).type)))

    def run(batches):
        terms, begin, query, weight, names = sent.value
        if not len(terms):
            return
        for b, c in counted(batches, True):
            h = c.all_hashes()
            at = np.searchsorted(terms, h)
            at[at == len(terms)] = 0
            hit = np.flatnonzero(terms[at] == h)
            if not len(hit):
                continue
            at, row, tf = at[hit], c.row[hit], c.n[hit] / c.size[c.row[hit]]
            each = begin[at + 1] - begin[at]
            step = (np.cumsum(each) - each) // ADDED
            last = np.flatnonzero(np.diff(row)) + 1  # documents are not cut
            cuts = [0, *(x for x, y in zip(last.tolist(), np.diff(step[np.append(0, last)]).tolist(), strict=True) if y), len(row)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                n = each[i:j]
                place = np.repeat(begin[at[i:j]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                key, to = np.unique(np.repeat(row[i:j], n) * len(names) + query[place], return_inverse=True)
                dot = np.bincount(to, weights=np.repeat(tf[i:j], n) * weight[place], minlength=len(key))
                doc, of = np.divmod(key, len(names))
                for x in range(0, len(key), ROWS):
                    y = slice(x, x + ROWS)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(of[y])), b.column(0).take(pa.array(doc[y])), pa.array(dot[y])], names=["query", "id", "dot"])

    kinds = weights.schema["query"].dataType.simpleString(), stems.schema["id"].dataType.simpleString()
    return stems.select("id", "stems").mapInArrow(run, f"query {kinds[0]}, id {kinds[1]}, dot double")
