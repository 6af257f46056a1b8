"""Parts of word sets: what two sets of a high Jaccard likeness must have equal.

The words are dealt by hash into P parts, for sets of one band of sizes alike. Two sets whose likeness is at least t differ in at most H words, so
all but H of their parts are equal. Each set names the L of its parts that tell most, H < L <= P, in one order for all sets: two such sets have at
least L - H named parts in common, as with prefixes of words (P - L of the P - H equal ones may be unnamed). A part is some words at once, and several
must be equal, so hardly any other two sets meet, however many there are. The order is by the words' rarity, of which SKETCH counts are known to all tasks.

Words are 64-bit hashes. Texts are given as words with one space between them (spaced()).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import saved
from .terms import ROWS, mixed, pieces

#: Counts of words by hash; named parts and sets that are dealt to a task; ids of sets to compare up to which they may be sent to all tasks.
SKETCH, DEALT, SETS, ASKED = 1 << 16, 1 << 21, 4096, 1 << 20
#: Members and words of a group whose pairs are compared in one place, and different words of it that are compared at a time.
BLOCK, WORDS, WIDTH = 1024, 1 << 21, 1 << 13
_SLACK = 1e-9


def spaced(text: Column) -> Column:
    """Lower-case words with one space for all white space; null: empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")


def word_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the different words of each text, by row."""
    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten().dictionary_encode()
    words, code = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    some = (pc.binary_length(words).to_numpy(zero_copy_only=False) > 0)[code] if len(words) else np.empty(0, bool)
    row, code = np.divmod(np.unique(row[some] * max(1, len(words)) + code[some]), max(1, len(words)))
    return row, pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)[code] if len(code) else np.empty(0, np.uint64)


def rarity(texts: DataFrame) -> tuple[Broadcast, int]:
    """How much a word tells, by its hash modulo SKETCH, and the sum of the sizes of all sets of texts (.., words)."""

    def run(batches):
        count = np.zeros(SKETCH, np.int64)
        for b in pieces(batches):
            _, h = word_sets(b.column(b.num_columns - 1))
            count += np.bincount((h % SKETCH).astype(np.int64), minlength=SKETCH)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at])], names=["at", "n"])

    found = texts.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    count = np.ones(SKETCH, np.int64)
    count[found.column(0).to_numpy()] = found.column(1).to_numpy()
    total = int(count.sum())
    return texts.sparkSession.sparkContext.broadcast(np.round(16 * np.log2(total / count)).astype(np.int64)), total


def most_apart(words: np.ndarray, threshold: float) -> np.ndarray:
    """H: in how many words two sets of so many words in all can differ that have the likeness."""
    return np.floor(words * ((1 - threshold) / (1 + threshold)) + _SLACK).astype(np.int64)


def bands(threshold: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(greatest size, L, P) of each band of sizes; the larger of two alike sets is in the band of the smaller or the next."""
    top, lo = [], 1
    while not top or top[-1] < most:
        top.append(int(lo / threshold + _SLACK))
        lo = top[-1] + 1
    top = np.array(top)
    apart = most_apart(top + np.floor(top / threshold + _SLACK), threshold)
    named = apart + 1 + (apart + 1) // 4
    return top, named, named + (apart + 1) // 4


def _named(h: np.ndarray, row: np.ndarray, band: np.ndarray, named: np.ndarray, parts: np.ndarray, tells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, part) of the parts that each set names, as 64-bit hashes of their words; band, L and P are by set."""
    begin = np.cumsum(parts) - parts
    salt = mixed(band.astype(np.uint64) + np.uint64(1))
    at = begin[row] + ((mixed(h ^ salt[row]) >> np.uint64(32)) * parts[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    total = int(parts.sum())
    sums = np.zeros(total, np.uint64)
    np.add.at(sums, at, mixed(h))
    weight = np.bincount(at, weights=tells[(h % SKETCH).astype(np.int64)], minlength=total)
    of = np.repeat(np.arange(len(parts)), parts)
    place = np.arange(total) - begin[of]
    part = mixed(sums + mixed(salt[of] + place.astype(np.uint64)))
    order = np.lexsort((part, -weight, of))
    keep = place < named[of]  # rows stay together in the order, so places are those of the order too
    return of[keep], part[order][keep]


def named_parts(texts: DataFrame, threshold: float, tells: Broadcast) -> DataFrame:
    """(part, id, n) of texts (id, words): each set's named parts in its own band, and in the band below (n negative) where a smaller set can be like it."""

    def run(batches):
        for b in pieces(batches):
            row, h = word_sets(b.column(1))
            n = np.bincount(row, minlength=b.num_rows)
            top, named, parts = bands(threshold, int(n.max(initial=1)))
            own = np.searchsorted(top, n)
            below = np.maximum(own - 1, 0)
            for band, some, sign in ((own, n > 0, 1), (below, (own > 0) & (n * threshold <= top[below] + _SLACK), -1)):
                here = np.flatnonzero(some)
                if not len(here):
                    continue
                to = np.cumsum(some) - 1
                mine = some[row]
                of, part = _named(h[mine], to[row[mine]], band[here], named[band[here]], parts[band[here]], tells.value)
                of = here[of]
                for i in range(0, len(of), ROWS):
                    at = of[i : i + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(part[i : i + ROWS].view(np.int64)), b.column(0).take(pa.array(at)), pa.array((sign * n[at]).astype(np.int32))], names=["part", "id", "n"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"part long, id {kind}, n int")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows so that rows of one part come in one batch; parts of one row are left out."""
    held = None
    for b in batches:
        held = b if held is None else pa.concat_batches([held, b])
        part = held.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(part, part[-1])) if len(part) else 0
        if last:
            yield held.slice(0, last)
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield held


def met(named: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(a, b, n), a < b: ids whose sets have as many named parts in common as the likeness asks of their sizes, and the larger size."""

    def run(batches):
        for b in _runs(batches):
            part, n = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            top, names, _ = bands(threshold, int(abs(n).max()))
            at, d = np.arange(len(part)), 0
            while len(at):
                d += 1
                at = at[at + d < len(part)]
                at = at[part[at] == part[at + d]]
                x, y = n[at], n[at + d]
                small, large = np.minimum(abs(x), abs(y)), np.maximum(abs(x), abs(y))
                fit = ((x > 0) | (y > 0)) & (small >= large * threshold - _SLACK)
                some, small, large = at[fit], small[fit], large[fit]
                # both are named by the parts of the smaller one's band
                least = (names[np.searchsorted(top, small)] - most_apart(small + large, threshold)).astype(np.int32)
                for i in range(0, len(some), ROWS):
                    j = some[i : i + ROWS]
                    yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(j)), b.column(1).take(pa.array(j + d)), pa.array(large[i : i + ROWS]), pa.array(least[i : i + ROWS])], names=["x", "y", "n", "least"])

    kind = named.schema["id"].dataType.simpleString()
    dealt = named.repartition(parts, "part").sortWithinPartitions("part")
    pairs = dealt.mapInArrow(run, f"x {kind}, y {kind}, n int, least int").filter("x <> y")
    common = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n", "least").groupBy("a", "b", "n", "least").agg(F.count(F.lit(1)).alias("m"))
    return common.filter("m >= least").select("a", "b", "n")


def squares(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, n) with a group and a square (g, x, y): sets that are all alike share a group, the least id that one of them has met.

    A group of more than BLOCK members, or of more than WORDS words, is cut into squares of pairs.
    """
    ends = pairs.select("a", "b").union(pairs.select("b", "a"))
    least = ends.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("l"))
    of = lambda x: least.select(F.col("id").alias(x), F.col("l").alias(f"l{x}"))
    dealt = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n", F.least("la", "lb").alias("g"))
    members = dealt.select("g", "a", "n").union(dealt.select("g", "b", "n")).groupBy("g", "a").agg(F.max("n").alias("n"))
    k = members.groupBy("g").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / WORDS)).cast("int").alias("k")).filter("k > 1")
    square = lambda c: F.coalesce(F.pmod(F.xxhash64(c), F.col("k")), F.lit(0)).cast("int")
    return dealt.join(k, "g", "left").select("a", "b", "g", square("a").alias("x"), square("b").alias("y"))


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of words that sets i and sets j have in common, pair by pair."""
    if len(i) < 8:
        return np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(i.tolist(), j.tolist(), strict=True)])
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, word, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    row, word = row[shared[word]], (np.cumsum(shared) - 1)[word[shared[word]]]
    order = np.argsort(word, kind="stable")
    row, word = row[order], word[order]
    out = np.zeros(len(i), np.int64)
    for begin in range(0, int(shared.sum()), WIDTH):
        at = slice(*np.searchsorted(word, [begin, begin + WIDTH]))
        has = np.zeros((len(sets), min(WIDTH, int(shared.sum()) - begin)), np.float32)
        has[row[at], word[at] - begin] = 1
        out += (has @ has.T)[i, j].astype(np.int64)
    return out


def compared(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score) of the pairs (a, b, g, x, y) that have the likeness; texts (id, words) are moved once for each square that asks for them."""
    key = ["g", "x", "y"]
    asked = saved(pairs.select(*key, F.col("a").alias("id")).union(pairs.select(*key, "b")).distinct(), "asked")
    n = asked.count()
    asked = F.broadcast(asked) if n <= ASKED else asked
    parts = max(-(-n // SETS), 2 * pairs.sparkSession.sparkContext.defaultParallelism)

    def hashes(batches):
        for b in pieces(batches):
            row, h = word_sets(b.column(4))
            ends = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=[*key, "a", "h"])

    kind = texts.schema["id"].dataType.simpleString()
    sets = texts.join(asked, "id").select(*key, "id", "words").mapInArrow(hashes, f"g {kind}, x int, y int, a {kind}, h array<long>")
    rows = sets.select(*key, "a", F.lit(None).cast(kind).alias("b"), "h").union(pairs.select(*key, "a", "b", F.lit(None).cast("array<long>")))
    # sets come before the pairs of their square
    dealt = rows.repartition(parts, *key).sortWithinPartitions(*key, F.col("b").asc_nulls_first())

    def result(ids, sets, ends):
        place = {x: i for i, x in enumerate(ids)}
        i, j = (np.array([place[e[k]] for e in ends]) for k in (0, 1))
        size = np.array([len(x) for x in sets])
        common = _common(sets, i, j)
        score = common / (size[i] + size[j] - common)
        at = np.flatnonzero(score >= threshold)
        return pa.RecordBatch.from_arrays([pa.array([ends[k][0] for k in at.tolist()], to), pa.array([ends[k][1] for k in at.tolist()], to), pa.array(score[at])], names=["a", "b", "score"])

    def run(batches):
        here, ids, sets, ends = None, [], [], []
        for b in batches:
            g, x, y, a, other = (b.column(i).to_pylist() for i in range(5))
            lists = b.column(5)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for i in range(b.num_rows):
                if (g[i], x[i], y[i]) != here or len(ends) >= ROWS:
                    if ends:
                        yield result(ids, sets, ends)
                    ends = []
                    if (g[i], x[i], y[i]) != here:
                        here, ids, sets = (g[i], x[i], y[i]), [], []
                if other[i] is None:
                    ids.append(a[i])
                    sets.append(values[offsets[i] : offsets[i + 1]].copy())
                else:
                    ends.append((a[i], other[i]))
        if ends:
            yield result(ids, sets, ends)

    to = to_arrow_type(texts.schema["id"].dataType)
    return dealt.mapInArrow(run, f"a {kind}, b {kind}, score double")



def near(texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score), a < b: different ids of texts (id, words) whose word sets have this Jaccard likeness or more."""
    tells, total = rarity(texts)
    named = total * 2 * (1 - threshold) / threshold
    parts = max(int(named) // DEALT + 1, 2 * texts.sparkSession.sparkContext.defaultParallelism)
    pairs = saved(met(named_parts(texts, threshold, tells), threshold, parts), "common-parts")
    return compared(saved(squares(pairs), "met"), texts, threshold)
