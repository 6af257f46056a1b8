"""Literal rules by the thousand: a q-gram filter join instead of an expression for each rule.

A needle can only be in a text that has all its q-grams (runs of GRAM bytes of the UTF-8 text), so each needle is filed under the
one of its grams that the fewest texts have. A text's different grams meet these keys in a bitmap of fixed size, and only the rules of
grams that are there are looked for. The plan is the same for ten rules and for a million.

A pack of at most PACK_BYTES is sent to all tasks and texts are read in one narrow pass, without a shuffle: where a gram of the
pack stands, the runs around it that could be a needle are hashed and looked up, and what is found is compared by bytes. A larger
one stays a table: (block of texts, gram) meets (gram, rule) in a join, and each block is searched in the same way for the rules that it met.

Defined cases: null text is empty; a null needle is left out, and an empty one refused, as it is everywhere; needles shorter than
GRAM are their own gram; equal needles are rules of their own; hits of a needle do not overlap; a needle is sought in the whole text, so one that holds a
line break can be found; texts of any length are read whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import saved

#: Bytes of a gram, of a pack that is sent to all tasks, of text that is cut into grams at a time, of a block of texts that a larger pack meets, and bits of the bitmap.
GRAM, PACK_BYTES, PIECE, BLOCK, MAX_BITS = 4, 32 << 20, 1 << 20, 4 << 20, 1 << 26
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _grams(raw: bytes | np.ndarray, n: int) -> np.ndarray:
    """The run of n bytes at each place, as numbers that hold n as well."""
    b = (np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw).astype(np.uint64)
    if len(b) < n:
        return np.empty(0, np.int64)
    g = sum((b[i : len(b) - n + 1 + i] << np.uint64(8 * i) for i in range(1, n)), b[: len(b) - n + 1])
    return (g + np.uint64(n << 32)).astype(np.int64)


def needle_grams(needle: bytes) -> np.ndarray:
    return np.unique(_grams(needle, min(GRAM, len(needle))))


def _slots(g: np.ndarray, bits: int) -> np.ndarray:
    return (g.astype(np.uint64) * _SPREAD) >> np.uint64(64 - (bits - 1).bit_length())


def text_grams(raw: bytes, known: np.ndarray, lengths: Sequence[int]) -> np.ndarray:
    """The text's different grams that the bitmap knows."""
    found = []
    for n in lengths:
        for at in range(0, max(1, len(raw)), PIECE):
            g = _grams(raw[at : at + PIECE + n - 1], n)
            found.append(np.unique(g[known[_slots(g, len(known))]]))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _raws(column: pa.Array) -> Iterator[bytes]:
    return (x.as_py() or b"" for x in column.cast(pa.large_binary()))


def filed(texts: DataFrame, rules: DataFrame, text_col: str, rule_col: str, needle_col: str) -> DataFrame:
    """(rule, needle, gram): each rule with the gram of its needle that the fewest texts have, saved."""
    rows = rules.select(F.col(rule_col).alias("rule"), F.col(needle_col).alias("needle")).filter("needle IS NOT NULL")
    if not rows.filter("needle = ''").isEmpty():
        raise ValueError("an empty text is found everywhere")

    def cut(batches):
        for b in batches:
            each = [needle_grams(x) for x in _raws(b.column(1))]
            rows = pa.array(np.repeat(np.arange(len(each)), [len(g) for g in each]), pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in b.columns), pa.array(np.concatenate(each) if each else [], pa.int64())], names=["rule", "needle", "gram"])

    kind = rules.schema[rule_col].dataType.simpleString()
    rows = saved(rows.mapInArrow(cut, f"rule {kind}, needle string, gram long"), "pack-grams")
    known, lengths = _bitmap_of(rows)

    def count(batches):
        for b in batches:
            each = [text_grams(raw, known.value, lengths) for raw in _raws(b.column(0))]
            g, n = np.unique(np.concatenate([np.empty(0, np.int64), *each]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n.astype(np.int64))], names=["gram", "n"])

    seen = texts.select(text_col).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    least = F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram"))
    return saved(rows.join(seen, "gram", "left").groupBy("rule", "needle").agg(least.alias("gram")), "pack")


def _bitmap_of(pack: DataFrame):
    """A bitmap of the grams of (gram), of fixed size at most, sent to all tasks; and their lengths."""
    spark = pack.sparkSession
    one = saved(pack.select("gram").distinct(), "grams")
    lengths = sorted(r[0] for r in one.select(F.shiftright("gram", 32).cast("int")).distinct().collect())  # GRAM numbers at most
    bits = min(MAX_BITS, max(1 << 16, 1 << int(one.count() * 16).bit_length()))

    def mark(batches):
        out = np.zeros(bits, bool)
        for b in batches:
            out[_slots(b.column(0).to_numpy(), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(out).tobytes()], pa.binary())], names=["bits"])

    marked = one.repartition(8).mapInArrow(mark, "bits binary").collect()  # eight bitmaps of MAX_BITS at most
    known = np.zeros(bits, bool)
    for r in marked:
        known |= np.unpackbits(np.frombuffer(r.bits, np.uint8)).astype(bool)[:bits]
    return spark.sparkContext.broadcast(known), lengths


def literal_findings(texts: DataFrame, rules: DataFrame, key: Sequence[str], text_col: str = "text", rule_col: str = "rule_id", needle_col: str = "needle", pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(key, rule, count, line): rules whose needle a text holds, how often, and the line of the first hit.

    pack_bytes: a pack of more stays a table that is joined.
    """
    pack = filed(texts, rules, text_col, rule_col, needle_col)
    known, lengths = _bitmap_of(pack)
    rows = texts.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(key)), F.col(text_col).alias("text"))
    keys = [f"k{i}" for i in range(len(key))]
    n_bytes = pack.agg(F.sum(F.octet_length("needle") + 64)).first()[0] or 0
    found = _sent(rows, keys, pack, known, lengths) if n_bytes <= pack_bytes else _joined(rows, keys, pack, known, lengths, n_bytes)
    return found.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(key)), F.col("rule").alias(rule_col), "count", "line")


def _fields(rows: DataFrame, keys: Sequence[str], *more: T.StructField) -> T.StructType:
    return T.StructType([*(rows.schema[k] for k in keys), *more])


class Needles:
    """A pack for lookups by arrays: the shapes (place of the gram, length) of each gram, and needles by hash.

    The hash of a run is a difference of prefix sums, so that a run of any length is hashed in constant time. Bytes are compared in the end.
    """

    _BASE = 0x5851F42D4C957F2D

    def __init__(self, needles: Sequence[bytes], grams: Sequence[int]):
        self.raw = needles
        self.longest = max(map(len, needles), default=0)
        size = np.array([len(x) for x in needles], np.int64)
        grams = np.array(grams, np.int64)
        ends = np.cumsum(size)
        place, hashes = np.zeros(len(size), np.int64), np.zeros(len(size), np.uint64)
        # needles on end, about a piece at a time: the hash of a run is the same wherever it stands
        for rows in np.split(np.arange(len(size)), np.flatnonzero(np.diff(ends // PIECE)) + 1):
            data = np.frombuffer(b"".join(needles[rows[0] : rows[-1] + 1]) if len(rows) else b"", np.uint8)
            to = np.cumsum(size[rows])
            hashes[rows] = self._mixed(*self._sums(data), to - size[rows], to)
            place[rows] = self._first(data, size[rows], grams[rows])
        shapes = np.unique(np.stack([grams, place, size]).T.reshape(-1, 3), axis=0)
        self.grams, self.first, self.n = np.unique(shapes[:, 0], return_index=True, return_counts=True)
        self.place, self.size = shapes[:, 1], shapes[:, 2]
        self.by_hash = np.argsort(hashes, kind="stable")
        self.hashes, self.from_, self.same = np.unique(hashes[self.by_hash], return_index=True, return_counts=True)

    @staticmethod
    def _first(data: np.ndarray, size: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Where in each of the needles that stand on end its gram begins first."""
        out = np.zeros(len(size), np.int64)
        ends = np.cumsum(size)
        for n in range(1, GRAM + 1):
            own = np.flatnonzero(np.minimum(size, GRAM) == n)
            if len(own):
                tried = size[own] - n + 1
                at = _runs(ends[own] - size[own], tried)
                hit = np.flatnonzero(_grams(data, n)[at] == np.repeat(grams[own], tried))
                which, first = np.unique(np.repeat(np.arange(len(own)), tried)[hit], return_index=True)
                out[own[which]] = at[hit[first]] - (ends - size)[own[which]]
        return out

    def _powers(self, base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)

    def _sums(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of the bytes, each times a power, and what takes the power away again."""
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b + np.uint64(1)) * self._powers(self._BASE, len(b)), out=sums[1:])
        return sums, self._powers(pow(self._BASE, -1, 1 << 64), len(b) + 1)

    @staticmethod
    def _mixed(sums: np.ndarray, back: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * back[start] ^ ((end - start).astype(np.uint64) * _SPREAD)

    def places(self, data: np.ndarray, known: np.ndarray, lengths: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of a needle, where it starts) of all needles in the bytes, in blocks."""
        for at in range(0, len(data), PIECE):
            low = max(0, at - self.longest)
            window = data[low : at + PIECE + self.longest]
            sums, back = self._sums(window)
            for n in lengths:
                g = _grams(data[at : at + PIECE + n - 1], n)
                here = np.flatnonzero(known[_slots(g, len(known))])
                of = np.searchsorted(self.grams, g[here])
                of[of == len(self.grams)] = 0
                real = self.grams[of] == g[here]
                here, of = here[real] + (at - low), of[real]
                if not len(here):
                    continue
                # so many places at a time that the shapes to be tried stay within a piece
                cuts = np.searchsorted(np.cumsum(self.n[of]), np.arange(0, self.n[of].sum(), PIECE), side="right")
                for i, j in zip(cuts, [*cuts[1:], len(here)], strict=True):
                    yield from self._tried(window, sums, back, low, here[i:j], of[i:j])

    def _tried(self, window: np.ndarray, sums: np.ndarray, back: np.ndarray, low: int, here: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        shape = _runs(self.first[of], self.n[of])
        start = np.repeat(here, self.n[of]) - self.place[shape]
        end = start + self.size[shape]
        fits = (start >= 0) & (end <= len(window))
        start, end = start[fits], end[fits]
        h = self._mixed(sums, back, start, end)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        hit = self.hashes[at] == h
        start, at = start[hit], at[hit]
        needle = self.by_hash[_runs(self.from_[at], self.same[at])]
        start = np.repeat(start, self.same[at])
        raw = window.tobytes() if len(start) else b""
        same = np.fromiter((raw.startswith(self.raw[k], s) for k, s in zip(needle.tolist(), start.tolist(), strict=True)), bool, len(start))
        yield needle[same], start[same] + low


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, n of them."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)


def _apart(start: np.ndarray, new: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the hits count when hits of one needle may not overlap; sorted by needle and start, new where another needle begins."""
    counts = np.ones(len(start), bool)
    close = np.flatnonzero(~new[1:] & (np.diff(start) < size[1:])) + 1
    last_end, before = 0, -1
    for i in close.tolist():
        if i - 1 != before:  # the hit before stands alone, so it counts
            last_end = start[i - 1] + size[i - 1]
        counts[i] = start[i] >= last_end
        if counts[i]:
            last_end = start[i] + size[i]
        before = i
    return counts


def _blocks(b: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of about PIECE bytes in all (or one longer row), with the bytes of their texts on end and where each begins."""
    raws = pc.fill_null(b.column(column).cast(pa.large_binary()), b"")
    sizes = pc.binary_length(raws).to_numpy(zero_copy_only=False)
    block = (np.cumsum(sizes) - sizes) // PIECE
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)] if len(sizes) else []
    for i, j in zip(cuts, cuts[1:], strict=False):
        starts = np.concatenate([[0], np.cumsum(sizes[i:j])])
        yield b.slice(i, j - i), np.frombuffer(b"".join(raws.slice(i, j - i).to_pylist()), np.uint8), starts


def _found(whole: pa.RecordBatch, n_keys: int, names: pa.Array, needles: Needles, known: np.ndarray, lengths: Sequence[int], columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """(keys, rule, count, line) of a batch of (keys, text)."""
    sizes = np.array([len(x) for x in needles.raw], np.int64)
    for b, data, starts in _blocks(whole, n_keys):
        found = [*needles.places(data, known, lengths)] if len(needles.raw) else []
        needle, start = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), ())))
        row = np.searchsorted(starts, start, side="right") - 1
        size = sizes[needle]
        inside = start + size <= starts[row + 1]
        order = np.lexsort((start[inside], needle[inside], row[inside]))
        row, needle, start, size = (x[inside][order] for x in (row, needle, start, size))
        new = np.ones(len(row), bool)
        new[1:] = (np.diff(row) != 0) | (np.diff(needle) != 0)
        first = np.flatnonzero(new)
        count = np.add.reduceat(_apart(start, new, size).astype(np.int64), first) if len(first) else np.empty(0, np.int64)
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, start[first]) - np.searchsorted(breaks, starts[row[first]]) + 1
        take = pa.array(row[first])
        yield pa.RecordBatch.from_arrays([*(b.column(j).take(take) for j in range(n_keys)), names.take(pa.array(needle[first])), pa.array(count), pa.array(line.astype(np.int32))], names=columns)


def _sent(rows: DataFrame, keys: Sequence[str], pack: DataFrame, known, lengths: Sequence[int]) -> DataFrame:
    """One pass over the texts, with the pack in every task."""
    table = pack.select("rule", "needle", "gram").toArrow()  # at most PACK_BYTES
    needles = Needles([x.encode() for x in table.column(1).to_pylist()], table.column(2).to_pylist())
    shared = rows.sparkSession.sparkContext.broadcast((table.column(0).combine_chunks(), needles))

    def run(batches):
        names, needles = shared.value
        for b in batches:
            yield from _found(b, len(keys), names, needles, known.value, lengths, schema.names)

    schema = _fields(rows, keys, pack.schema["rule"], T.StructField("count", T.LongType()), T.StructField("line", T.IntegerType()))
    return rows.mapInArrow(run, schema)


def _joined(rows: DataFrame, keys: Sequence[str], pack: DataFrame, known, lengths: Sequence[int], n_bytes: int) -> DataFrame:
    """The pack as a table: grams of blocks of texts meet rules, and a block is searched for the rules that it met.

    A block's texts have about BLOCK bytes (or are one longer text). Rules are dealt into parts of about PACK_BYTES, and a task has one
    block with one part, so what it holds is bounded whatever the pack's size is.
    """
    parts = -(-n_bytes // PACK_BYTES) or 1
    blocked = T.StructType([T.StructField("block", T.LongType()), *rows.schema])

    def deal(batches):
        block, free = TaskContext.get().partitionId() << 32, BLOCK
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(len(keys)).cast(pa.large_binary())), 0).to_pylist()
            own = []
            for n in sizes:
                if n > free and free < BLOCK:
                    block, free = block + 1, BLOCK
                free -= n
                own.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *b.columns], names=blocked.names)

    rows = saved(rows.mapInArrow(deal, blocked), "texts")

    def cut(batches):
        for b in batches:
            block = b.column(0).to_numpy()
            for i, j in _same(block):
                each = [text_grams(raw, known.value, lengths) for raw in _raws(b.column(1).slice(i, j - i))]
                g = np.unique(np.concatenate(each))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), block[i])), pa.array(g)], names=["block", "gram"])

    grams = rows.select("block", "text").mapInArrow(cut, "block long, gram long").distinct()
    met = grams.join(pack.withColumn("part", F.pmod(F.xxhash64("rule", "needle"), F.lit(parts))), "gram")
    if parts > 1:
        met = saved(met, "met")
        asked = rows.join(met.select("block", F.col("part").alias("own")).distinct(), "block")
    else:
        asked = rows.withColumn("own", F.lit(0).cast("long"))
    schema = _fields(rows, keys, pack.schema["rule"], T.StructField("count", T.LongType()), T.StructField("line", T.IntegerType()))

    def run(texts, rules):
        arrow = [pa.array([], t) for t in (*(texts.schema.field(k).type for k in keys), rules.schema.field("rule").type, pa.int64(), pa.int32())]
        found = [pa.RecordBatch.from_arrays(arrow, names=schema.names)]
        if len(texts) and len(rules):
            needles = Needles([x.encode() for x in rules.column("needle").to_pylist()], rules.column("gram").to_numpy())
            names = rules.column("rule").combine_chunks()
            for b in texts.select([*keys, "text"]).combine_chunks().to_batches():
                found += _found(b, len(keys), names, needles, known.value, lengths, schema.names)
        return pa.Table.from_batches(found)

    return asked.groupBy("block", "own").cogroup(met.groupBy("block", "part")).applyInArrow(run, schema)


def _same(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """From where to where equal values stand side by side."""
    cuts = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)] if len(x) else []
    return zip(cuts, cuts[1:], strict=False)
