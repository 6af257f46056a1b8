"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

The rank file is read once on the driver (its size is checked) and sent to the
executors as bytes, so they need no file of their own. Long texts are cut where
no match of the split pattern can span the cut, so ids, digests and decoded
bytes are those of the whole text while memory stays bounded by the chunk and the text's
longest stretch without such a place: a run of letters alone, of any script, is one match and is encoded whole.

Defined cases: a null or empty text has no ids and decodes to no bytes;
repeated rows are each encoded; an empty table gives an empty result; very long texts are
encoded whole; other columns are kept by ``encode_documents`` and ignored by ``round_trip``, whatever they are called.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MAX_RANK_FILE = 64 << 20
CHUNK_CHARS = 1 << 18
#: A cut is made before white space that follows anything else (blanks are only at the start of a match, or all of
#: it), and between a letter and a mark (no match has both). The classes are those that all Unicode versions share.
_CUT = re.compile("\\S(?=[ \t\n\r])|[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u05d0-\u05ea\u0621-\u063a\u0905-\u0939\u0e01-\u0e30\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3](?=[.,;:!?()\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f\u300c\u300d])")

_cache: dict[bytes, "ByteBPE"] = {}


class ByteBPE:
    """An encoder made from the bytes of a rank file and a split pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self._enc = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.names = [b"%d" % i for i in range(max(table.values(), default=-1) + 1)]

    def chunks(self, text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
        at = 0
        while len(text) - at > size:
            m = _CUT.search(text, at + size - 1)
            if not m:
                break
            yield text[at : m.end()]
            at = m.end()
        if at < len(text):
            yield text[at:] if at else text

    def encode(self, text: str | None) -> Iterator[list[int]]:
        """Lists of ids that together are those of the whole text."""
        for part in self.chunks(text or ""):
            yield self._enc.encode_ordinary(part)

    def decode(self, ids: list[int]) -> bytes:
        return self._enc.decode_bytes(ids)


def codec(ranks: bytes, pattern: str) -> ByteBPE:
    """One encoder per Python worker."""
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    if key not in _cache:
        _cache[key] = ByteBPE(ranks, pattern)
    return _cache[key]


def load_ranks(spark: SparkSession, path: str) -> Broadcast:
    with open(path, "rb") as f:
        raw = f.read(MAX_RANK_FILE + 1)
    if len(raw) > MAX_RANK_FILE:
        raise ValueError(f"{path} is larger than {MAX_RANK_FILE} bytes")
    return spark.sparkContext.broadcast(raw)


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def encode_documents(df: DataFrame, ranks: Broadcast, pattern: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """df with the ids of each text in a new column (array<int>)."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != ids_col), T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))])
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches):
        bpe = codec(ranks.value, pattern)
        for b in _small(batches):
            ids = [[i for part in bpe.encode(t) for i in part] for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(ids, pa.list_(pa.int32()))], names=[*keep, ids_col])

    return df.select(*keep).mapInArrow(run, schema)


def decode_documents(df: DataFrame, ranks: Broadcast, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """df with the bytes of each list of ids; bytes, as ids may end inside a character."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out_col), T.StructField(out_col, T.BinaryType())])
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches):
        bpe = codec(ranks.value, pattern)
        for b in _small(batches):
            raw = [bpe.decode(ids or []) for ids in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(raw, pa.large_binary()).cast(pa.binary())], names=[*keep, out_col])

    return df.select(*keep).mapInArrow(run, schema)


def round_trip(df: DataFrame, ranks: Broadcast, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: the id, n_tokens, ids_sha256, decoded_sha256 (and token_ids).

    Ids are decoded again chunk by chunk, so that neither the ids nor the bytes
    of a very long text are held as a whole (but for the ids with with_ids).
    """
    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)))

    def run(batches):
        bpe = codec(ranks.value, pattern)
        name = bpe.names.__getitem__
        for b in _small(batches):
            n, sha_ids, sha_raw, all_ids = [], [], [], []
            for t in b.column(1).to_pylist():
                count, hi, hd, own = 0, hashlib.sha256(), hashlib.sha256(), []
                for ids in bpe.encode(t):
                    if count:
                        hi.update(b" ")
                    hi.update(b" ".join(map(name, ids)))
                    hd.update(bpe.decode(ids))
                    count += len(ids)
                    if with_ids:
                        own += ids
                n.append(count)
                sha_ids.append(hi.hexdigest())
                sha_raw.append(hd.hexdigest())
                all_ids.append(own)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(sha_ids, pa.string()), pa.array(sha_raw, pa.string())]
            if with_ids:
                cols.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return df.select(id_col, text_col).mapInArrow(run, T.StructType(fields))
