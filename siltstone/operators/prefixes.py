"""Prefixes of rare words: what two sets that reach a Jaccard likeness must share one of.

Words are ordered rare first. Of two sets whose likeness is at least t, the first n - ceil(t n) + 1 words of each (n its size) have one in common,
whatever the order; with the frequent words last, a word that is in very many sets brings nothing together. Only frequent
words have to be known for that: at most HOT of them, sent to all tasks. Each set is sorted in its own row, and nothing but prefixes is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent words that are told apart by their number of sets, and words of sets that are sorted at a time (or one larger set).
HOT, PIECE = 65_536, 1 << 18


def hashed(sets: DataFrame) -> DataFrame:
    """sets (id, words) with h: the words as 64-bit hashes."""
    return sets.withColumn("h", F.transform("words", lambda x: F.xxhash64(x)))


def frequent(sets: DataFrame) -> Broadcast:
    """Hashes of the words of hashed sets that most sets have, in order, and their numbers of sets."""
    words = sets.select(F.explode("h").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    total = sets.agg(F.sum(F.size("h"))).first()[0] or 0
    found = words.filter(F.col("n") > max(1, total // HOT)).toArrow()  # as the numbers add up to total, there are at most HOT
    w, n = (found.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(w)
    return sets.sparkSession.sparkContext.broadcast((w[order], n[order]))


def pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about PIECE words in all, so that the arrays of a task do not grow with a batch."""
    sizes = np.diff(b.column(1).offsets.to_numpy())
    cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // PIECE)) + 1).tolist(), len(sizes)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        yield b.slice(i, j - i)


def prefixes(sets: DataFrame, threshold: float, hot: Broadcast) -> DataFrame:
    """(id, n, word) for the prefix of each hashed set; words are hashes."""

    def run(batches):
        w, count = hot.value
        for b in (x for whole in batches for x in pieces(whole)):
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.searchsorted(w, values)
            at[at == len(w)] = 0
            df = np.where(w[at] == values, count[at], 0) if len(w) else np.zeros(len(values), int)
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((values, df, row))
            place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = np.array([n - ceil(n * threshold - 1e-9) + 1 for n in sizes.tolist()], int)
            chosen = place < np.repeat(np.maximum(keep, 0), sizes)
            row, values = row[chosen], values[order][chosen]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(sizes[row], pa.int32()), pa.array(values, pa.int64())], names=["id", "n", "word"])

    kind = sets.schema["id"].dataType.simpleString()
    return sets.select("id", "h").mapInArrow(run, f"id {kind}, n int, word long")
