"""Exact n-gram Jaccard join: all links between word-shingle sets at a threshold.

A document's set holds the 64-bit hashes of its different shingles; documents with
equal sets are one node (named by a 128-bit hash of the set).

1. *Order.* Counts of shingles that repeat inside a chunk of documents are added up
   in a table whose size follows the number of shingles, to a limit. It only orders shingles, rare ones first; any order
   gives the same links.
2. *Prefixes.* Two sets that link share at least k of their first n - ceil(t n) + k
   shingles in that order, for any k up to their overlap; k grows with the size of
   the smaller set. Prefixes go to buckets as compressed arrays; shingles that one
   node alone has there are gone after this step. Then shingles without a second
   node of a size that could link go, and nodes that are left with fewer shingles
   than they would share with any partner.
3. *Tiles.* A tile has the nodes that hold one shingle and are of one size band or
   the next smaller: sizes of linked sets are at most a band apart. Of tiles with
   the same nodes one is kept. First a tile's hub is compared with all others,
   which joins groups of copies in linear time. Tiles that then have more than one
   component are compared in square blocks of at most BLOCK nodes a side, so no
   tile, however common its shingle, is gathered in one task: for some turns each
   node gives its nearest node of another component, and in the last turn every
   pair that may link.
4. *Bounds.* Each node has a bitmap in which every hash flips a bit. Bits in which
   two bitmaps differ are at most the sets' symmetric difference, so they bound
   the overlap from above. Pairs that pass are intersected as sorted arrays.

The input is scanned more than once and must give the same rows each time, as files do.
Pairs between nodes that are already connected are left out: links inside a
component change nothing. No pair between components is.

Defined cases: null or blank text is an empty set that links with nothing; a text
of fewer words than a shingle is one shingle; null ids count as larger than any
other; rows that repeat an id have the same component as their equals; an empty table
gives an empty result; very long texts are read whole, in segments; extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import pack as _pack
from .arrays import unpack as _unpack
from .common import dropped, finished, packed, partitions, saved, unpacked
from .components import contract

WORDS, PERCENT = 5, 75
#: Bits of the cells of the table of frequencies, least and most (a byte a cell reaches every task), and the estimate from which a shingle is dealt by chunk.
CELL_BITS, MAX_CELL_BITS, COMMON = 22, 26, 15
_PIECE_BITS = 8
CHUNK = 1_500_000
#: Rows whose facts a task holds, and shingles for each bucket of prefixes.
FACTS, BUCKET = 1 << 16, 1 << 21
#: Places for nodes in a chunk, and for chunks in a task.
NODES = 1 << 20
BLOCK = 512
HUB_TURNS, NEAREST_TURNS, PRUNE_TURNS = 1, 2, 1
#: Bits of the filter for nodes that have candidates, least and most, in powers of two (it may let others through).
FILTER_BITS, MAX_FILTER_BITS = 23, 30
#: Tiles that are salted (at most; they are broadcast), and the parts that each of them gets.
HOT_TILES, SALTS = 10_000, 64
#: Shared shingles that are asked of two sets: one, and one more for each so many hashes of the smaller.
STEP = 16
_SEGMENT = 1 << 20
#: Fixed random numbers for bytes, and an odd base whose powers give bytes their places.
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from 0 to n at least."""
    if len(_powers[0]) <= n:
        size = max(1 << 16, 1 << n.bit_length())
        made = [np.cumprod(np.append(np.uint64(1), np.full(size, x, np.uint64)), dtype=np.uint64) for x in (_BASE, _INVERSE)]
        if size > 4 * _SEGMENT:
            return made[0], made[1]  # for a word of extreme length; not kept
        _powers[:] = made
    return _powers[0], _powers[1]


def shingles(raw: bytes | None, words: int = WORDS) -> np.ndarray:
    """The sorted hashes of the different shingles.

    A shingle's hash is a polynomial in its bytes (words with one blank between
    them), taken as a difference of prefix sums, and mixed.
    """
    text = b" ".join(raw.lower().split()) if raw else b""
    if not text:
        return np.empty(0, np.uint64)
    b = np.frombuffer(text, np.uint8)
    gaps = np.flatnonzero(b == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(b))
    k = min(words, len(starts))
    starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
    out, i = [], 0
    while i < len(starts):
        j = len(starts) if len(b) - starts[i] <= _SEGMENT else max(i + 1, int(np.searchsorted(ends, starts[i] + _SEGMENT, "right")))
        lo, hi = starts[i], ends[j - 1]
        power, inverse = _powers_to(int(hi - lo))
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[b[lo:hi]] * power[: hi - lo], out=sums[1:])
        out.append((sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * inverse[starts[i:j] - lo])
        i = j
    s = np.concatenate(out) if len(out) > 1 else out[0]
    s = (s ^ (s >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    s = (s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    s.sort()
    return s[np.append(True, s[1:] != s[:-1])]


def asked(n):
    """Shingles that a set of n hashes asks to share with a set that is no smaller."""
    return n // STEP + 1


def set_name(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def bitmap(s: np.ndarray) -> bytes:
    """Parities of hashes by their low bits; 4 to 8 bits for each hash."""
    width = max(64, 1 << int(4 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def band_edges(percent: int = PERCENT) -> list[int]:
    """Least sizes of bands: a set links only with sets of its own band and the two beside it."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * 100 // percent + 1)
    return edges


def _chunks(batches, words):
    """Lists of (name, set) of different sets, of about CHUNK shingles and at most NODES sets each."""
    own, size = {}, 0
    for b in batches:
        for t in b.column(0).cast(pa.large_binary()).to_pylist():
            s = shingles(t, words)
            if len(s):
                name = set_name(s)
                if name not in own:
                    own[name] = s
                    size += len(s)
            if size >= CHUNK or len(own) >= NODES:
                yield list(own.items())
                own, size = {}, 0
    if own:
        yield list(own.items())


def _scan(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Facts of each row (id, raw, n, ref), and counts of shingles that repeat in a chunk (piece, data)."""
    kind = df.schema[id_col].dataType

    def run(batches):
        facts, own, size, id_type = [], {}, 0, None

        def out(rows, counts=()):
            ids, raw, n, ref = zip(*rows, strict=True) if rows else ((), (), (), ())
            k = len(rows) + len(counts)
            return pa.RecordBatch.from_arrays([pa.array([*ids, *[None] * len(counts)], id_type), pa.array([*raw, *[None] * len(counts)], pa.int64()), pa.array([*n, *[None] * len(counts)], pa.int64()), pa.array([*ref, *[None] * len(counts)], pa.binary()), pa.array([*[None] * len(rows), *(c[0] for c in counts)], pa.int32()), pa.array([*[None] * len(rows), *(c[1] for c in counts)], pa.binary())], names=["doc_id", "raw", "n", "ref", "piece", "data"]) if k else None

        def counts():
            x, c = np.unique(np.concatenate(list(own.values())), return_counts=True)
            cells, back = np.unique((x[c > 1] >> np.uint64(64 - MAX_CELL_BITS)).astype(np.int64), return_inverse=True)
            sums = np.bincount(back, weights=c[c > 1]).astype(np.int64)
            piece = cells >> (MAX_CELL_BITS - _PIECE_BITS)
            cuts = np.flatnonzero(np.diff(piece)) + 1
            return [(int(p[0]), _pack(at, n)) for p, at, n in zip(np.split(piece, cuts), np.split(cells, cuts), np.split(sums, cuts), strict=True) if len(p)]

        for b in batches:
            id_type = b.schema.field(0).type
            for i, t, h in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                s = shingles(t, words)
                name = set_name(s) if len(s) else None
                facts.append((i, h, len(s), name))
                if name and name not in own:
                    own[name] = s
                    size += len(s)
                if size >= CHUNK or len(own) >= NODES:
                    yield out(facts, counts())
                    facts, own, size = [], {}, 0
                elif len(facts) >= FACTS:  # copies and empty texts add no shingles
                    yield out(facts)
                    facts = []
        if facts or own:
            yield out(facts, counts() if own else ())

    fields = [T.StructField("doc_id", kind), T.StructField("raw", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ref", T.BinaryType()), T.StructField("piece", T.IntegerType()), T.StructField("data", T.BinaryType())]
    return df.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col)).mapInArrow(run, T.StructType(fields))


def _ranks(scanned: DataFrame, bits: int) -> np.ndarray:
    """log2 of the counts in each cell: 1 << bits bytes."""
    per = 1 << (bits - _PIECE_BITS)

    def add(batches):
        piece, total = None, None
        for b in batches:
            for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p != piece:
                    if total is not None:
                        yield row(piece, total)
                    piece, total = p, np.zeros(per, np.int64)
                at, n = _unpack(blob)
                np.add.at(total, (at >> (MAX_CELL_BITS - bits)) & (per - 1), n)
        if total is not None:
            yield row(piece, total)

    def row(piece, total):
        return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([np.log2(total + 1.0).astype(np.uint8).tobytes()], pa.binary())], names=["piece", "ranks"])

    pieces = scanned.filter("piece IS NOT NULL").select("piece", "data")
    pieces = pieces.repartition(partitions(pieces.sparkSession), "piece").sortWithinPartitions("piece")
    out = np.zeros(1 << bits, np.uint8)
    for r in pieces.mapInArrow(add, "piece int, ranks binary").collect():  # 1 << _PIECE_BITS rows
        out[r.piece * per : (r.piece + 1) * per] = np.frombuffer(r.ranks, np.uint8)
    return out


def _shared_prefixes(df: DataFrame, text_col: str, words: int, percent: int, ranks: np.ndarray, n_shingles: int) -> DataFrame:
    """(token, node, base) for prefix shingles of more than one node, and (node, ref, n, band) for every node."""
    spark = df.sparkSession
    owners = max(partitions(spark), -(-n_shingles // BUCKET))
    shared, buckets, edges = spark.sparkContext.broadcast(ranks), 2 * owners, band_edges(percent)
    shift = np.uint64(64 - (len(ranks).bit_length() - 1))

    def send(batches):
        task, number = TaskContext.get().partitionId(), 0
        for own in _chunks(batches, words):
            if len(own) > NODES or number >= NODES or task >= 1 << 23:
                raise ValueError(f"chunk {number} of task {task} with {len(own)} nodes has no numbers")
            chunk = (task << 32) + number
            number += 1
            tokens, base = [], []
            for _, s in own:
                rank = shared.value[(s >> shift).astype(np.int64)]
                first = len(s) - (len(s) * percent + 99) // 100 + 1
                tokens.append(s[np.argsort(rank, kind="stable")[: first - 1 + asked(len(s))]])
                base.append(np.arange(len(tokens[-1])) < first)
            node = np.repeat(np.arange(len(own), dtype=np.uint32), [len(t) for t in tokens])
            tokens, base = np.concatenate(tokens), np.concatenate(base)
            common = shared.value[(tokens >> shift).astype(np.int64)] >= COMMON
            spread = np.where(common, tokens * np.uint64((chunk * 2 + 1) * 0x9E3779B97F4A7C15 % 2**64), tokens)
            to = ((spread >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.lexsort((tokens, to))
            rows = [(int(to[part[0]]), chunk, 0, _pack(np.diff(tokens[part], prepend=np.uint64(0)), node[part], common[part], base[part])) for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1)]
            rows.append((number % buckets, chunk, 1, _pack(np.frombuffer(b"".join(x[0] for x in own), np.uint8), np.array([len(x[1]) for x in own]))))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names=["bucket", "chunk", "kind", "data"])

    def close(rows):
        nodes = [r for r in rows if r[2] == 1]
        for _, chunk, _, blob in nodes:
            names, n = _unpack(blob)
            names = names.astype(np.uint8).tobytes()
            names, n = [names[i : i + 16] for i in range(0, len(names), 16)], n.tolist()
            at = [node_number(chunk, i) for i in range(len(n))]
            yield batch(pa.nulls(len(n), pa.bool_()), pa.nulls(len(n), pa.int64()), pa.array(at, pa.int64()), pa.array(names, pa.binary()), pa.array(n, pa.int64()), pa.array([bisect_right(edges, x) for x in n], pa.int32()))
        parts = [(r[1], *_unpack(r[3])) for r in rows if r[2] == 0]
        if parts:
            token = np.concatenate([np.cumsum(p[1].astype(np.uint64), dtype=np.uint64) for p in parts])
            node = np.concatenate([node_number(p[0], p[2]) for p in parts])
            _, back, count = np.unique(token, return_inverse=True, return_counts=True)
            keep = (count[back] > 1) | np.concatenate([p[3] for p in parts]).astype(bool)
            k = int(keep.sum())
            yield batch(pa.array(np.concatenate([p[4] for p in parts]).astype(bool)[keep]), pa.array(token[keep].view(np.int64)), pa.array(node[keep]), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()))

    def node_number(chunk, i):
        return ((chunk >> 32) << 40) + ((chunk & 0xFFFFFFFF) << 20) + i  # NODES places for nodes and for chunks

    def batch(*cols):
        return pa.RecordBatch.from_arrays(list(cols), names=["base", "token", "node", "ref", "n", "band"])

    def own(batches):
        key, rows = None, []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[0] != key and rows:
                    yield from close(rows)
                    rows = []
                key = r[0]
                rows.append(r)
        if rows:
            yield from close(rows)

    sent = df.select(text_col).mapInArrow(send, "bucket int, chunk long, kind int, data binary")
    return sent.repartition(owners, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(own, "base boolean, token long, node long, ref binary, n long, band int")


def _node_filter(refs: DataFrame) -> np.ndarray:
    """A bitmap of the nodes' hashes, of some 16 bits for each node as far as MAX_FILTER_BITS allow."""
    size = 1 << min(MAX_FILTER_BITS, max(FILTER_BITS, (16 * refs.count()).bit_length()))
    place = F.pmod(F.conv(F.hex(F.substring("ref", 1, 4)), 16, 10).cast("long"), F.lit(size)) + 1  # the bitmap functions count from 1
    pieces = refs.select(place.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("m"))
    out = np.zeros(size // 8, np.uint8)
    for r in pieces.collect():  # size bits in all
        m = np.frombuffer(r.m, np.uint8)
        at = (r.b - 1) * len(m)
        out[at : at + len(m)] = m[: len(out) - at]
    return out


def _arrays(df: DataFrame, text_col: str, words: int, wanted: np.ndarray) -> DataFrame:
    """(ref, n, bits, hashes) of the sets that the filter lets through, one row for each."""
    shared = df.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for own in _chunks(batches, words):
            rows = []
            for name, s in own:
                x = int.from_bytes(name[:4], "big") % (8 * len(shared.value))
                if shared.value[x >> 3] >> (x & 7) & 1:
                    rows.append((name, len(s), bitmap(s), s.tobytes()))
            for at in range(0, len(rows), 64):
                cols = list(zip(*rows[at : at + 64], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["ref", "n", "bits", "hashes"])

    rows = df.select(text_col).mapInArrow(run, "ref binary, n long, bits binary, hashes binary")
    return rows.groupBy("ref").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("hashes").alias("hashes"))


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of every row of a and every row of b (bitmaps as 64-bit words)."""
    out = np.empty((len(a), len(b)), np.int64)
    for i, x in enumerate(a):
        out[i] = np.bitwise_count(b ^ x).sum(1)
    return out


def _may_link(na, nb, diff, percent: int):
    """Whether sets of these sizes that differ in at least diff hashes can reach the threshold."""
    overlap = np.minimum(np.minimum(na, nb), (na + nb - diff) // 2)
    return 100 * overlap >= percent * (na + nb - overlap)


def _pass_bound(pairs: DataFrame, sig: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps let them link."""
    of = lambda x: sig.select(F.col("ref").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"s{x}"))

    def run(batches):
        for b in batches:
            keep = []
            for na, sa, nb, sb in zip(*(b.column(c).to_pylist() for c in ("na", "sa", "nb", "sb")), strict=True):
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                words = min(len(x), len(y))
                keep.append(bool(_may_link(na, nb, int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()), percent)))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(of("a"), "a").join(of("b"), "b").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return rows.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a long, b long")


def _links(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by intersecting their sorted arrays."""
    of = lambda x: arrays.select(F.col("ref").alias(x), F.col("hashes").alias(f"h{x}"))

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("ha").to_pylist(), b.column("hb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(of("a"), "a").join(of("b"), "b")
    return rows.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def _of_tiles(rows: DataFrame, tiles: DataFrame, count: int) -> DataFrame:
    """rows (token, band, ref, ..) with the columns of their tiles (t, b, k, ..), one row for each with its number of rows.

    Tiles of many rows are dealt in SALTS parts. As the tiles have count rows in all, no
    more than HOT_TILES are salted, and these alone are broadcast.
    """
    least = max(2 * BLOCK, count // HOT_TILES + 1)
    hot = tiles.filter(F.col("k") >= least).select(F.col("t").alias("_t"), F.col("b").alias("_b"))
    rows = rows.join(F.broadcast(hot), (F.col("token") == F.col("_t")) & (F.col("band") == F.col("_b")), "left")
    rows = rows.withColumn("_salt", F.when(F.col("_t").isNull(), 0).otherwise(F.pmod(F.xxhash64("ref"), F.lit(SALTS)))).drop("_t", "_b")
    parts = F.sequence(F.lit(0).cast("long"), F.when(F.col("k") >= least, SALTS - 1).otherwise(0).cast("long"))
    tiles = tiles.withColumn("_part", F.explode(parts))
    # by merging: of such joins Spark also splits partitions that are large by chance
    return rows.join(tiles.hint("merge"), (F.col("token") == F.col("t")) & (F.col("band") == F.col("b")) & (F.col("_salt") == F.col("_part"))).drop("t", "b", "_salt", "_part")


def _tiles(posted: DataFrame) -> DataFrame:
    """(token, band, ref, own): the tiles with an own node and another, one of each that hold the same nodes."""
    base = posted.filter("base").select("token", "band", F.col("id").alias("ref"))
    rows = base.select("*", F.lit(True).alias("own")).union(base.select("token", F.col("band") + 1, "ref", F.lit(False)))
    held = rows.groupBy("token", "band").agg(F.max("own").alias("any_own"), F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("ref", "own").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("own", "ref")).alias("x"))
    one = held.filter("any_own AND k > 1").groupBy("k", "s", "x").agg(F.min(F.struct("token", "band")).alias("t"))
    one = one.select(F.col("t.token").alias("t"), F.col("t.band").alias("b"), "k")
    return saved(_of_tiles(rows, one, 2 * base.count()).select("token", "band", "ref", "own"), "jaccard-tiles")


def _open_tiles(tiles: DataFrame, labels: DataFrame, count: int) -> DataFrame:
    """tiles (token, band, ref, own) with components, of tiles with more than one and an own node."""
    rows = tiles.join(labels, "ref")
    more = rows.groupBy("token", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("own").alias("any_own"), F.count(F.lit(1)).alias("k"))
    more = more.filter("lo <> hi AND any_own").select(F.col("token").alias("t"), F.col("band").alias("b"), "k")
    return _of_tiles(rows, more, count).select("token", "band", "ref", "own", "comp", F.col("k").alias("size"))


def _hub_pairs(opened: DataFrame, turn: int, count: int) -> DataFrame:
    """Each tile's hub with its other nodes of other components."""
    hub = F.min_by(F.struct("ref", "comp"), F.when(F.col("own"), F.xxhash64("ref", F.lit(turn))))
    hubs = opened.groupBy("token", "band").agg(hub.alias("hub"), F.count(F.lit(1)).alias("k"))
    hubs = hubs.select(F.col("token").alias("t"), F.col("band").alias("b"), "k", F.col("hub.ref").alias("hub"), F.col("hub.comp").alias("hub_comp"))
    rows = _of_tiles(opened, hubs, count).filter("comp <> hub_comp")
    return rows.select(F.least("ref", "hub").alias("a"), F.greatest("ref", "hub").alias("b")).distinct()


def _tile_pairs(opened: DataFrame, sig: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs of open tiles between components that their bitmaps let link: all, or each node's nearest in a block."""
    side = F.ceil(F.col("size") / BLOCK)
    mine = F.pmod(F.xxhash64("ref"), side)
    # block m meets every block: tasks (i, j) with i <= j, of two blocks each
    rows = opened.withColumn("m", mine).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), side - 1)))
    rows = rows.select("token", "band", F.least("m", "x").alias("i"), F.greatest("m", "x").alias("j"), "m", "ref", "own", "comp").join(sig.select("ref", "n", "bits"), "ref")
    rows = rows.select("token", "band", "i", "j", "m", "ref", "own", "comp", "n", "bits")
    rows = rows.repartition(partitions(rows.sparkSession), "token", "band", "i", "j").sortWithinPartitions("token", "band", "i", "j")

    def close(rows):
        """Own nodes against all; a pair inside a block only in that block's own task."""
        i, j = rows[0][2], rows[0][3]
        words = min(len(r[9]) for r in rows) // 8
        bits = np.stack([folded(np.frombuffer(r[9], np.uint64), words) for r in rows])
        n, block, own = np.array([r[8] for r in rows]), np.array([r[4] for r in rows]), np.array([r[6] for r in rows])
        _, comp = np.unique([r[7] for r in rows], return_inverse=True)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return
        diff = differing(bits[left], bits[right])
        ok = _may_link(n[left][:, None], n[right][None], diff, percent)
        ok &= (comp[left][:, None] != comp[right][None]) & (own[left][:, None] | own[right][None])
        if nearest:
            far = np.where(ok, diff / (n[left][:, None] + n[right][None]), np.inf)
            best = far.argmin(1)
            at = np.flatnonzero(ok[np.arange(len(left)), best])
            found = zip(at, best[at], strict=True)
        else:
            found = zip(*np.nonzero(np.triu(ok, 1) if i == j else ok), strict=True)
        for x, y in found:
            a, b = rows[left[x]][5], rows[right[y]][5]
            yield (a, b) if a < b else (b, a)

    def run(batches):
        key, rows = None, []
        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:4] != key and rows:
                    out += close(rows)
                    rows = []
                key = r[:4]
                rows.append(r)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])
        out = list(close(rows)) if rows else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _pruned(posted: DataFrame, percent: int) -> DataFrame:
    """posted (token, id, n, band, base) without what cannot be part of a link."""
    here = posted.groupBy("token", "band").agg(F.count(F.lit(1)).alias("k"))
    # a shingle has as many bands at most as there are band edges
    near = here.groupBy(F.col("token").alias("t")).agg(F.map_from_entries(F.collect_list(F.struct("band", "k"))).alias("bands"))
    near = near.filter((F.size("bands") > 1) | F.exists(F.map_values("bands"), lambda k: k > 1))
    at = lambda d: F.coalesce(F.try_element_at("bands", F.col("band") + d), F.lit(0))
    rows = posted.join(near, F.col("token") == F.col("t")).filter((at(0) > 1) | (at(1) > 0) | (at(-1) > 0)).select("token", "id", "n", "band", "base")
    smallest = F.floor((F.col("n") * percent + 99) / 100)
    need = F.floor(smallest / STEP) + 1  # asked() of the smallest partner
    good = rows.groupBy("id", "n").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= need).select(F.col("id").alias("i"))
    return saved(rows.join(good, F.col("id") == F.col("i")).select("token", "id", "n", "band", "base"), "jaccard-posted")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id (least id reachable by links), raw (of the text)."""
    spark = df.sparkSession
    scanned = saved(_scan(df, id_col, text_col, words), "jaccard-scan")
    facts = scanned.filter("piece IS NULL").select("doc_id", "raw", "n", "ref")
    n_shingles = facts.agg(F.sum("n")).first()[0] or 0
    ranks = _ranks(scanned, min(MAX_CELL_BITS, max(CELL_BITS, (n_shingles // 16).bit_length())))
    found = saved(_shared_prefixes(df, text_col, words, percent, ranks, n_shingles), "jaccard-prefixes")
    finished(spark)
    nodes = found.filter("token IS NULL").select("node", "ref", "n", "band")
    # of the nodes that chunks gave to one set, the least is its id
    ids = saved(nodes.groupBy("ref").agg(F.min("node").alias("id")), "jaccard-ids")
    nodes = nodes.join(ids, "ref").select(F.col("node").alias("_n"), "id", "n", "band")
    posted = found.filter("token IS NOT NULL").select("token", "node", "base").join(nodes, F.col("node") == F.col("_n"))
    posted = _pruned(posted.select("token", "id", "n", "band", "base").distinct(), percent)
    dropped(found)
    for _ in range(PRUNE_TURNS):
        less = _pruned(posted, percent)
        dropped(posted)
        posted = less
    labels = saved(posted.select(F.col("id").alias("ref")).distinct().withColumn("comp", F.col("ref")), "labels")
    wanted = saved(ids.join(labels.select(F.col("ref").alias("id")), "id", "left_semi"), "jaccard-wanted")
    finished(spark)
    arrays = _arrays(df, text_col, words, _node_filter(wanted)).join(wanted, "ref")
    arrays = saved(arrays.select(F.col("id").alias("ref"), "n", "bits", "hashes"), "jaccard-arrays")
    sig = arrays.select("ref", "n", "bits")
    tiles = _tiles(posted)
    count = tiles.count()
    finished(spark)
    for turn in range(HUB_TURNS + NEAREST_TURNS + 1):
        opened = saved(_open_tiles(tiles, labels, count), "tiles")
        if opened.isEmpty():
            break
        if turn < HUB_TURNS:
            pairs = _pass_bound(_hub_pairs(opened, turn, count), sig, percent)
        else:
            pairs = _tile_pairs(opened, sig, percent, turn < HUB_TURNS + NEAREST_TURNS)
        links = saved(_links(pairs, arrays, percent), "links")
        labels = contract(labels, links)
        dropped(opened)
        finished(spark)
    sets = facts.filter("ref IS NOT NULL").groupBy("ref").agg(F.min("doc_id").alias("first_id"))
    sets = sets.join(ids, "ref").join(labels.select(F.col("ref").alias("id"), "comp"), "id", "left").select("ref", F.coalesce("comp", "id").alias("comp"), "first_id")
    least = sets.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = sets.join(least, "comp").select(F.col("ref").alias("_r"), "component_id")
    out = facts.join(named, F.col("ref") == F.col("_r"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("ref").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "raw")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that have the least id of their component; rows of empty sets all stay.

    Rows that share the least id stay together, and so do those of a component without any id.
    """
    stay = join(df, id_col, text_col).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = stay.select(F.col("doc_id").alias("id"), F.col("raw").alias("text_hash")).distinct()
    field = F.col("row").getField
    rows = packed(df).join(stay, field(id_col).eqNullSafe(F.col("id")) & (F.xxhash64(field(text_col)) == F.col("text_hash")))
    return unpacked(rows, df.columns)
