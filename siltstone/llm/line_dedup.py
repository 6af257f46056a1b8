"""Deduplication of lines that many documents share, by two Bloom filters.

1. *Filters*: each task hashes the keys of its lines, once a document, and keeps two Bloom filters: of what it
   has met once, and of what it has met twice. Filters of two tasks are joined by (once | once', twice | twice' | once & once'),
   so nothing met in two tasks is missed. They travel in blocks, compressed, and each block is joined by one task as the
   messages come; no line and no hash is shuffled.
2. *Suspects*: the second filter, of a bounded size, is sent to all tasks. Lines that it does not know are
   in one document for certain. Only suspected repeats are shuffled, as (digest of the key, id): they are counted exactly by
   SHA-256, with partial sums, and the key's largest id is chosen.
3. *Rewriting*: a document without a suspect passes unchanged in a narrow scan. The others are joined, by
   id, to the digests that they lose.

The filters have BITS_A_KEY bits for each line, up to MAX_BITS: beyond that they let more lines through
to the exact count, which is linear and gives the same result; nothing is dropped.

Defined cases: null and empty texts are one empty line; a line of blanks has an empty key and stays; each row is a document
of its own, so a row that is repeated counts again, and all rows with a key's largest id keep it; a null id is smaller than any
other; an empty table gives an empty result; texts and lines of any length are taken whole (a key is a
digest of 32 bytes after hashing); other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import finished, partitions, saved

LEAST_CHARS, LEAST_DOCS = 20, 3
BITS_A_KEY, MIN_BITS, MAX_BITS = 12, 1 << 18, 1 << 28
#: Hash functions of a filter, and blocks that it travels in.
HASHES, BLOCKS = 4, 256
#: Keys after which a task sends its filters and begins new ones.
FLUSH = 1 << 20
_BLANK = b" \t\n\v\f\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_CODEC = pa.Codec("zstd", compression_level=1)


def key(line: bytes, least: int = LEAST_CHARS) -> bytes | None:
    """The line's key; None if it has under least code points."""
    k = line.strip(_BLANK).lower()
    if len(k) < least or len(k) < 4 * least and len(k.translate(None, _CONTINUATION)) < least:
        return None
    return k


def digests(text: bytes | None, least: int = LEAST_CHARS) -> list[bytes | None]:
    """The digest of each line's key, None for lines without one."""
    sha = hashlib.sha256
    return [k and sha(k).digest() for k in (key(x, least) for x in (text or b"").split(b"\n"))]


def positions(found: list[bytes], bits: int) -> np.ndarray:
    """A row of HASHES bit numbers below bits, a power of two, for each digest."""
    words = np.frombuffer(b"".join(found), "<u8").reshape(-1, 4)
    return (words & np.uint64(bits - 1)).astype(np.int64)


def _bitmap(words: np.ndarray, bits: int) -> np.ndarray:
    """A filter as bytes, with the bits of each row of words set."""
    out = np.zeros(bits // 8, np.uint8)
    at = np.unique(words & np.uint64(bits - 1)).astype(np.int64)
    if len(at):
        starts = np.flatnonzero(np.diff(at >> 3, prepend=-1))
        out[at[starts] >> 3] = np.bitwise_or.reduceat(np.left_shift(1, at & 7).astype(np.uint8), starts)
    return out


def _bitmap(words: np.ndarray, bits: int) -> np.ndarray:
    """A filter as bytes, with the bits of each row of words set."""
    out = np.zeros(bits // 8, np.uint8)
    at = np.unique(words & np.uint64(bits - 1)).astype(np.int64)
    if len(at):
        starts = np.flatnonzero(np.diff(at >> 3, prepend=-1))
        out[at[starts] >> 3] = np.bitwise_or.reduceat(np.left_shift(1, at & 7).astype(np.uint8), starts)
    return out


def _bitmaps(found: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The filters of digests, one for each document that has it: met, and met twice."""
    words = np.frombuffer(b"".join(found), "<u8").reshape(-1, 4)
    _, first, n = np.unique(words[:, 0], return_index=True, return_counts=True)  # equal first words are met twice at worst
    return _bitmap(words, bits), _bitmap(words[first[n > 1]], bits)


def _messages(batches, bits: int, least: int):
    """Filters of the keys in (text) batches, as rows (block, once, twice) of compressed bits."""
    held: list[bytes] = []

    def flush():
        once, twice = (x.reshape(BLOCKS, -1) for x in _bitmaps(held, bits))
        for at in range(0, BLOCKS, 32):
            rows = [i for i in range(at, at + 32) if once[i].any()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array([_CODEC.compress(x[i], asbytes=True) for i in rows], pa.binary()) for x in (once, twice))], names=["block", "once", "twice"])
        held.clear()

    for b in batches:
        for t in b.column(0).cast(pa.large_binary()):
            held.extend({k for k in digests(t.as_py(), least) if k})
            if len(held) >= FLUSH:
                yield from flush()
    if held:
        yield from flush()


def _joined(batches, bits: int):
    """The second filter of each block: all that a task holds is its blocks."""
    size = bits // 8 // BLOCKS
    have: dict[int, list[np.ndarray]] = {}
    read = lambda x: np.frombuffer(_CODEC.decompress(x.as_py(), size), np.uint8)
    for b in batches:
        for block, once, twice in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            old = have.setdefault(block, [np.zeros(size, np.uint8), np.zeros(size, np.uint8)])
            once = read(once)
            old[1] |= read(twice) | (old[0] & once)
            old[0] |= once
    for block, (_, twice) in have.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([twice.tobytes()], pa.binary())], names=["block", "twice"])


def repeated_filter(df: DataFrame, text_col: str = "text", least: int = LEAST_CHARS) -> np.ndarray:
    """The filter of keys met twice, as bytes: at most MAX_BITS / 8."""
    lines = F.size(F.filter(F.split(text_col, "\n"), lambda x: F.length(x) >= least))
    n = df.agg(F.sum(lines).alias("n")).first().n or 0
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (int(n) * BITS_A_KEY - 1).bit_length()))
    sent = df.select(text_col).mapInArrow(lambda b: _messages(b, bits, least), "block int, once binary, twice binary")
    blocks = sent.repartition(min(BLOCKS, partitions(df.sparkSession)), "block").mapInArrow(lambda b: _joined(b, bits), "block int, twice binary").toArrow()
    out = np.zeros((BLOCKS, bits // 8 // BLOCKS), np.uint8)
    for block, twice in zip(blocks.column(0).to_pylist(), blocks.column(1).to_pylist(), strict=True):
        out[block] = np.frombuffer(twice, np.uint8)
    return out.reshape(-1)


def suspected(found: list[bytes], bitmap: np.ndarray) -> list[bytes]:
    """Those digests that the filter knows."""
    if not found:
        return []
    at = positions(found, 8 * len(bitmap))
    known = ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)
    return [x for x, k in zip(found, known.tolist(), strict=True) if k]


def _suspects(batches, bitmap: np.ndarray, least: int):
    """(id, key) for each suspected key of each document."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            index, found = [], []
            for i, t in enumerate(part.column(1).cast(pa.large_binary())):
                some = suspected(list({k for k in digests(t.as_py(), least) if k}), bitmap)
                index += [i] * len(some)
                found += some
            if found:
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(index, pa.int64())), pa.array(found, pa.binary())], names=["_id", "_key"])


def _parted(batches, bitmap: np.ndarray, least: int, repeated: bool):
    """Documents with a suspected line (id, text), or those without (and their lines)."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            rows, lines = [], []
            for i, t in enumerate(part.column(1).cast(pa.large_binary())):
                raw = t.as_py() or b""
                found = [k for k in digests(raw, least) if k]
                if bool(suspected(found, bitmap)) == repeated:
                    rows.append(i)
                    lines.append(raw.count(b"\n") + 1)
            if rows:
                part = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lines, pa.int64())], names=["_id", "_text", "n_lines"])


def _rewritten(batches, least: int, name: str):
    """(id, text, n_lines, n_dropped) of documents with the digests that they lose."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            texts, dropped = [], []
            for t, lose in zip(part.column(1).cast(pa.large_binary()), part.column(3), strict=True):
                raw, lose = t.as_py() or b"", set(lose.as_py() or ())
                if lose:
                    lines = raw.split(b"\n")
                    kept = [x for x, k in zip(lines, digests(raw, least), strict=True) if k not in lose]
                    dropped.append(len(lines) - len(kept))
                    raw = b"\n".join(kept)
                else:
                    dropped.append(0)
                texts.append(raw)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary()).cast(pa.string()), part.column(2), pa.array(dropped, pa.int64())], names=[name, "text", "n_lines", "n_dropped"])


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """id, text without the lines it loses, n_lines (before) and n_dropped: one row per row of df.

    A key of at least least_chars code points found in at least least_docs documents (2 or more) stays in the one with the largest id alone.
    """
    if least_docs < 2:
        raise ValueError("a key repeats in two documents or more")
    spark, kind = df.sparkSession, df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    known = spark.sparkContext.broadcast(repeated_filter(rows, "_text", least_chars))  # at most MAX_BITS / 8 bytes
    suspects = saved(rows.mapInArrow(lambda b: _suspects(b, known.value, least_chars), T.StructType([T.StructField("_id", kind), T.StructField("_key", T.BinaryType())])), "suspects")
    counted = suspects.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_stays"))
    # saved, so that the join below reads two plain tables and a key with very many documents can be split
    counted = saved(counted.filter(F.col("_n") >= least_docs).select(F.col("_key").alias("_k"), "_stays"), "repeated")
    lost = suspects.join(counted, F.col("_key") == F.col("_k")).filter(~F.col("_id").eqNullSafe(F.col("_stays")))
    lost = saved(lost.groupBy("_id").agg(F.collect_set("_key").alias("_lose")), "lost")  # no longer than the document's own lines
    finished(spark)
    parted = T.StructType([T.StructField("_id", kind), T.StructField("_text", T.StringType()), T.StructField("n_lines", T.LongType())])
    out = T.StructType([T.StructField(id_col, kind), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    clean, rest = (rows.mapInArrow(lambda b, r=r: _parted(b, known.value, least_chars, r), parted) for r in (False, True))
    clean = clean.select(F.col("_id").alias(id_col), F.coalesce("_text", F.lit("")).alias("text"), "n_lines", F.lit(0).cast("long").alias("n_dropped"))
    lost = lost.select(F.col("_id").alias("_of"), "_lose")
    rest = rest.join(lost, F.col("_id").eqNullSafe(F.col("_of")), "left").select("_id", "_text", "n_lines", "_lose")
    return clean.union(rest.mapInArrow(lambda b: _rewritten(b, least_chars, id_col), out))


#: The digests in DuckDB.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS stays FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
m AS (SELECT k.*, g.key IS NOT NULL AND k.doc_id IS DISTINCT FROM g.stays AS gone FROM k LEFT JOIN g USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
