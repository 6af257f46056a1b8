"""Exact deduplication with an extendible-hash index on shared files.

1. *Facts*: every text is normalised and hashed; (id, key, digest) are saved.
2. *Directory*: different keys are counted by their leading bits. From one bucket
   for all keys, an overfull bucket is split in two by its next bit, doubling the
   directory where the bucket is as deep as the directory.
3. *Pages*: a page is a folder of files with the entries of one bucket, or of a run of
   neighbouring buckets that are small. Each task combines the copies it reads, so that a
   group of copies sends one text per task however large it is. Entries go to the owner of
   their page, a key range, which reads them in order of key, chains different texts of
   one key, and compares bytes with each text of the chain. Pages
   hold key, place in the chain, digest, first id and count; the directory is saved beside them.
   An insert brings a batch of texts to the buckets that the directory names: only their pages are read and written again, under
   new numbers. A bucket that is overfull then splits by its next bit, and the directory doubles where the bucket was as deep as it; a
   new directory is written last, so a reader of the old one still finds its pages.
4. *Probe*: the directory gives each fact its page and bucket, and the entry is sought
   there by key and digest. A probe of few texts reads the pages that the directory names and no others.

Defined cases: null counts as empty text; a null id counts as larger than any
other; of rows that repeat an id and a text one is kept; an empty table gives an empty index
and result; texts of any length are compared whole; extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import hashed_columns, packed, partitions, saved, scratch_path, unpacked

#: Keys in a bucket before it splits, and bits that the directory may use. Where so many keys need more bits, the first build
#: gives all buckets a larger capacity instead: the directory stays a few MB, and splitting never ends.
CAPACITY, MAX_DEPTH = 64, 18
#: Pages for each shuffle partition; a page has one bucket at least.
PAGES = 8
_SPACE = frozenset(b" \t\n\v\f\r")
#: Text that a task holds while it combines copies.
_HELD = 32 << 20


def normalised(raw: bytes | None) -> bytes:
    """Each run of blanks as one space."""
    if not raw:
        return b""
    words = b" ".join(raw.split())
    if not words:
        return b" "
    return (b" " if raw[0] in _SPACE else b"") + words + (b" " if raw[-1] in _SPACE else b"")


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def text_facts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _raw, key, text_sha256) of each row."""

    def run(batches):
        for b in batches:
            sha = [hashlib.sha256(normalised(t)) for t in b.column(2).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_key(x.digest()) for x in sha], pa.int64()), pa.array([x.hexdigest() for x in sha], pa.string())], names=["doc_id", "_raw", "key", "text_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_raw"), F.col(text_col).alias("_t")).mapInArrow(run, f"doc_id {kind}, _raw long, key long, text_sha256 string")


def directory(counts: dict[int, int], depth: int = MAX_DEPTH, capacity: int = CAPACITY) -> tuple[int, np.ndarray]:
    """(global depth, bucket of each entry) for counts of keys by their first depth bits.

    Buckets are numbered in order of key, so that consecutive numbers are key ranges.
    """
    level = np.zeros(1 << depth, np.int64)
    for k, n in counts.items():
        level[k] = n
    sums = [level]
    while len(sums[-1]) > 1:
        sums.append(sums[-1].reshape(-1, 2).sum(1))
    sums.reverse()  # sums[d]: counts by the first d bits
    leaves, todo = [], [(0, 0)]
    while todo:
        d, prefix = todo.pop()
        if d < depth and sums[d][prefix] > capacity:
            todo += [(d + 1, 2 * prefix + 1), (d + 1, 2 * prefix)]
        else:
            leaves.append((d, prefix))
    g = max(d for d, _ in leaves)
    slots = np.empty(1 << g, np.int32)
    for bucket, (d, prefix) in enumerate(leaves):
        slots[prefix << (g - d) : (prefix + 1) << (g - d)] = bucket
    return g, slots


def split(depth: int, slots: np.ndarray, counts: dict[int, int], capacity: int = CAPACITY, most: int = MAX_DEPTH) -> tuple[int, np.ndarray, dict[int, int]]:
    """(depth, bucket of each entry, new bucket: old bucket) of a directory after its overfull buckets have split.

    counts: keys by their first `most` bits, of the buckets in question. A bucket that is as deep as the directory doubles it; the
    upper half of its entries gets a new bucket.
    """
    slots, parents = slots.copy(), {}
    prefixes, n = np.array([*counts], np.int64), np.array([*counts.values()], np.int64)
    while True:
        held = np.bincount(slots[prefixes >> (most - depth)], n, slots.max() + 1)
        over = [b for b in np.flatnonzero(held > capacity).tolist() if depth < most or np.count_nonzero(slots == b) > 1]
        if not over:
            return depth, slots, parents
        if any(np.count_nonzero(slots == b) == 1 for b in over):
            slots, depth = np.repeat(slots, 2), depth + 1
        for b in over:
            own = np.flatnonzero(slots == b)
            new = int(slots.max()) + 1
            slots[own[len(own) // 2 :]] = new
            parents[new] = parents.get(b, b)


@dataclass
class Index:
    """An index on shared files: pages/page=N and directory=V, under path."""

    path: str
    depth: int  # of the directory, in bits
    buckets: int
    pages: int  # numbers that were given to pages
    kind: str  # of the ids
    capacity: int = CAPACITY
    page_keys: int = CAPACITY  # keys of a page when the index was built
    version: int = 0

    def directory(self, spark: SparkSession) -> DataFrame:
        """(slot, bucket, page): 2 ** depth rows."""
        return spark.read.schema("slot long, bucket int, page int").parquet(f"{self.path}/directory={self.version}")

    def live(self, spark: SparkSession) -> list[int]:
        """The pages that the directory names."""
        return sorted(r.page for r in self.directory(spark).select("page").distinct().collect())  # 2 ** MAX_DEPTH at most

    def read(self, spark: SparkSession, only: list[int] | None = None) -> DataFrame:
        """The entries of all pages, or of some."""
        if only is None and self.version:  # pages that an insert replaced are still there
            only = self.live(spark)
        paths = [f"{self.path}/pages"] if only is None else [f"{self.path}/pages/page={p}" for p in only]
        entries = spark.read.schema(f"bucket int, key long, slot int, text_sha256 string, keep_id {self.kind}, group_size long, n_bytes long, page int")
        return entries.option("basePath", f"{self.path}/pages").parquet(*paths)


def paged(keys: np.ndarray, pages: int) -> np.ndarray:
    """The page of each bucket, from its number of keys: runs of buckets, in about so many pages of about equal size."""
    ends = np.cumsum(keys)
    return np.unique((ends - keys) * pages // max(1, int(ends[-1])), return_inverse=True)[1]


def build_index(df: DataFrame, facts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of df's texts, whose facts are given."""
    spark = df.sparkSession
    prefix = F.shiftrightunsigned("key", 64 - MAX_DEPTH)
    counts = facts.select("key").distinct().groupBy(prefix.alias("p")).count().toArrow()  # at most 2 ** MAX_DEPTH rows
    counts = dict(zip(*(c.to_pylist() for c in counts.columns), strict=True))
    capacity = max(CAPACITY, 4 * sum(counts.values()) >> MAX_DEPTH)
    g, slots = directory(counts, MAX_DEPTH, capacity)
    in_bucket = np.zeros(int(slots.max()) + 1, np.int64)
    np.add.at(in_bucket, slots[np.array([*counts], np.int64) >> (MAX_DEPTH - g)], np.array([*counts.values()], np.int64))
    page_of = paged(in_bucket, PAGES * partitions(spark))
    kind = df.schema[id_col].dataType.simpleString()
    pages = int(page_of.max()) + 1
    index = Index(scratch_path(spark, "exact-index"), g, len(in_bucket), pages, kind, capacity, max(capacity, -(-int(in_bucket.sum()) // pages)))
    _write_directory(spark, index, slots, page_of[slots])
    shared = spark.sparkContext.broadcast((slots, page_of))  # at most 2 ** MAX_DEPTH entries each

    def combine(batches):
        held, size = {}, 0

        def flush():
            slots, page_of = shared.value
            at = [int(slots[(k & (2**64 - 1)) >> (64 - g)] if g else 0) for k, _, _ in held.values()]
            rows = [(int(page_of[b]), b, k, i, n, t) for b, (t, (k, i, n)) in zip(at, held.items(), strict=True)]
            for at in range(0, len(rows), 256):
                cols = list(zip(*rows[at : at + 256], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], id_type), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.binary())], names=["page", "bucket", "key", "first_id", "n", "norm"])

        for b in batches:
            id_type = b.schema.field(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                t = normalised(t)
                old = held.get(t)
                if old:
                    held[t] = (old[0], i if old[1] is None else old[1] if i is None else min(i, old[1]), old[2] + 1)
                    continue
                held[t] = (_key(hashlib.sha256(t).digest()), i, 1)
                size += len(t)
                if size > _HELD:
                    yield from flush()
                    held, size = {}, 0
        if held:
            yield from flush()

    def own(batches):
        """Entries come in order of key: the chain of one key is all that is held."""
        key, chain, out, at = None, [], [], None

        def close():
            for slot, (t, i, n) in enumerate(chain):
                out.append((*at, key, slot, hashlib.sha256(t).hexdigest(), i, n, len(t)))

        def rows():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string()), pa.array(cols[5], id_type), pa.array(cols[6], pa.int64()), pa.array(cols[7], pa.int64())], names=["page", "bucket", "key", "slot", "text_sha256", "keep_id", "group_size", "n_bytes"])

        for b in batches:
            id_type = b.schema.field(3).type
            for page, bucket, k, i, n, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    if chain:
                        close()
                    key, chain, at = k, [], (page, bucket)
                for slot, (have, first, count) in enumerate(chain):
                    if have == t:
                        chain[slot] = (have, i if first is None else first if i is None else min(i, first), count + n)
                        break
                else:
                    chain.append((t, i, n))
            if len(out) > 5000:
                yield rows()
                out.clear()
        if chain:
            close()
        if out:
            yield rows()

    entries = df.select(id_col, text_col).mapInArrow(combine, f"page int, bucket int, key long, first_id {kind}, n long, norm binary")
    owners = min(index.pages, partitions(spark))
    owned = entries.repartitionById(owners, F.expr(f"int(page * {owners}L div {index.pages})")).sortWithinPartitions("page", "bucket", "key")
    pages = owned.mapInArrow(own, f"page int, bucket int, key long, slot int, text_sha256 string, keep_id {kind}, group_size long, n_bytes long")
    pages.write.partitionBy("page").parquet(f"{index.path}/pages")
    return index


def _write_directory(spark: SparkSession, index: Index, slots: np.ndarray, pages: np.ndarray) -> None:
    rows = pa.table({"slot": pa.array(range(len(slots)), pa.int64()), "bucket": pa.array(slots, pa.int32()), "page": pa.array(pages, pa.int32())})
    spark.createDataFrame(rows).coalesce(1).write.parquet(f"{index.path}/directory={index.version}")


def _slot(depth: int):
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def insert(index: Index, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index with df's texts as well; only pages of buckets that get an entry are written again.

    The batch's texts are combined, chained and compared byte by byte among themselves, as in a build; against entries of
    the index, which hold no texts, by key and SHA-256.
    """
    spark = df.sparkSession
    batch = build_index(df, saved(text_facts(df, id_col, text_col), "exact-facts"), id_col, text_col)
    names = ("key", "text_sha256", "keep_id", "group_size", "n_bytes")
    table = F.broadcast(index.directory(spark).withColumnRenamed("slot", "_slot"))  # 2 ** MAX_DEPTH rows at most
    new = batch.read(spark).select(*names, F.lit(2**31 - 1).alias("old_slot"), _slot(index.depth).alias("_at")).join(table, F.col("_at") == F.col("_slot"))
    new = saved(new.select(*names, "old_slot", "page"), "exact-batch")
    touched = sorted(r.page for r in new.select("page").distinct().collect())
    if not touched:
        return index
    old = index.read(spark, touched).select(*names, F.col("slot").alias("old_slot"), "page")
    first = F.min(F.struct(F.col("keep_id").isNull().alias("none"), "keep_id"))["keep_id"]
    merged = old.unionByName(new).groupBy("key", "text_sha256").agg(first.alias("keep_id"), F.sum("group_size").alias("group_size"), F.max("n_bytes").alias("n_bytes"), F.min("old_slot").alias("old_slot"))
    merged = saved(merged, "exact-merged")
    prefix = F.shiftrightunsigned("key", 64 - MAX_DEPTH)
    counts = {r.p: r.n for r in merged.groupBy(prefix.alias("p")).agg(F.countDistinct("key").alias("n")).collect()}  # 2 ** MAX_DEPTH at most
    was = index.directory(spark).orderBy("slot").toArrow()
    slots, page_at = was.column(1).to_numpy(), was.column(2).to_numpy()
    page_of = dict(zip(slots.tolist(), page_at.tolist(), strict=True))
    depth, slots, parents = split(index.depth, slots, counts, index.capacity)
    in_bucket: dict[int, int] = {}
    for p, n in counts.items():
        b = int(slots[p >> (MAX_DEPTH - depth)])
        in_bucket[b] = in_bucket.get(b, 0) + n
    # buckets of a touched page go to new pages, in order of key, page_keys or so in each
    pages, last, held, next_page = {}, None, 0, index.pages - 1
    for b in dict.fromkeys(slots.tolist()):
        before = page_of[parents.get(b, b)]
        if before in touched:
            n = in_bucket.get(b, 0)
            if before != last or held + n > 2 * index.page_keys:
                next_page, last, held = next_page + 1, before, 0
            pages[b], held = next_page, held + n
        else:
            pages[b], last = before, None
    out = Index(index.path, depth, int(slots.max()) + 1, next_page + 1, index.kind, index.capacity, index.page_keys, index.version + 1)
    _write_directory(spark, out, slots, np.array([pages[b] for b in slots.tolist()]))
    table = F.broadcast(out.directory(spark).withColumnRenamed("slot", "_slot"))
    rows = merged.withColumn("_at", _slot(depth)).join(table, F.col("_at") == F.col("_slot"))
    chain = F.row_number().over(W.partitionBy("page", "bucket", "key").orderBy("old_slot", "text_sha256")) - 1
    rows = rows.select("bucket", "key", chain.alias("slot"), "text_sha256", "keep_id", "group_size", "n_bytes", "page")
    rows.repartition("page").sortWithinPartitions("page", "bucket", "key", "slot").write.mode("append").partitionBy("page").parquet(f"{index.path}/pages")
    return out


def probe(index: Index, facts: DataFrame, few: bool = False) -> DataFrame:
    """facts with keep_id and group_size of the index's entry of their text; rows without an entry go.

    few: read only the pages that the directory names for these facts (their numbers are collected).
    """
    spark = facts.sparkSession
    table = index.directory(spark).withColumnRenamed("slot", "_slot")
    placed = facts.withColumn("_at", _slot(index.depth)).join(F.broadcast(table), F.col("_at") == F.col("_slot")).drop("_at", "_slot")  # 2 ** MAX_DEPTH rows at most
    only = sorted(r.page for r in placed.select("page").distinct().collect()) if few else None
    pages = index.read(spark, only).select(F.col("page").alias("_p"), F.col("bucket").alias("_b"), F.col("key").alias("_k"), F.col("text_sha256").alias("_sha"), "keep_id", "group_size")
    found = (F.col("page") == F.col("_p")) & (F.col("bucket") == F.col("_b")) & (F.col("key") == F.col("_k")) & (F.col("text_sha256") == F.col("_sha"))
    return placed.join(pages, found).drop("_p", "_b", "_k", "_sha")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256, key, _raw."""
    facts = saved(text_facts(df, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "exact-facts")
    index = build_index(df, facts, id_col, text_col)
    out = probe(index, facts)
    # rows that repeat an id and a text: the first of them by text and place stays
    again = facts.groupBy("text_sha256", "doc_id").agg(F.min(F.struct("_raw", "_row")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    again = again.select(F.col("text_sha256").alias("_sha"), F.col("doc_id").alias("_id"), F.col("_first._row").alias("_first"))
    out = out.join(again, (F.col("text_sha256") == F.col("_sha")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.coalesce("_first", "_row") == F.col("_row"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "key", "_raw")


def survivors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay; of rows that repeat an id and a text the first by their other columns' hash."""
    stay = dedup(df, id_col, text_col).filter("kept").select(F.col("doc_id").alias("id"), F.col("_raw").alias("text_hash"))
    rows = packed(df).withColumn("own_hash", F.xxhash64(F.col("row").getField(text_col)))
    rows = rows.join(stay, F.col("row").getField(id_col).eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash")))
    nth = F.row_number().over(W.partitionBy("id", "text_hash").orderBy(hashed_columns(df, text_col)))
    return unpacked(rows.withColumn("nth", nth).filter("nth = 1"), df.columns)
