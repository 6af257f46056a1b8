"""Certificates over contents: digests, canonical form, keyed signatures, chains, revocation, audit."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: order of the canonical form's fields.
CANONICAL = ("id", "file_hash", "passed", "errors", "warnings", "ts", "agent")


def canonical(*cols: str | Column) -> Column:
    """Fields joined by colons; nulls are empty."""
    return F.concat_ws(":", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols))


def issue(files: DataFrame, key: str, text_col: str, verdict: DataFrame, agent: str, ts: int) -> DataFrame:
    """Unsigned certificates of files (key, text) and verdicts (key, passed, errors, warnings)."""
    rows = files.select(key, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("file_hash")).join(verdict, key)
    return rows.select(F.sha2(F.concat_ws(":", F.col(key).cast("string"), "file_hash", F.lit(str(ts))), 256).alias("id"), key, "file_hash", "passed", F.col("errors").cast("int").alias("errors"), F.col("warnings").cast("int").alias("warnings"), F.lit(ts).cast("bigint").alias("ts"), F.lit(agent).alias("agent"))


def signed(certificates: DataFrame, secret: bytes) -> DataFrame:
    """Certificates with an HMAC-SHA256 of their canonical form (the platform has no asymmetric signatures)."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, canonical(*CANONICAL).cast("binary")), 256))
    return certificates.withColumn("signature", F.sha2(F.concat(outer, first), 256))


def verified(certificates: DataFrame, secret: bytes, revoked: DataFrame) -> DataFrame:
    """certificates with valid: the signature is right and the id is not revoked."""
    again = signed(certificates.withColumnRenamed("signature", "_given"), secret)
    gone = revoked.select(F.col("id")).distinct().withColumn("_revoked", F.lit(True))
    return again.join(gone, "id", "left").withColumn("valid", (F.col("signature") == F.col("_given")) & F.col("_revoked").isNull()).drop("signature", "_revoked").withColumnRenamed("_given", "signature")


def not_revoked(certificates: DataFrame, revoked: DataFrame) -> DataFrame:
    return certificates.join(revoked.select("id"), "id", "left_anti")


def audit_chain(entries: DataFrame, key: str) -> DataFrame:
    """entries (ts, id, action, subject) of each key with own_hash, seq, prev_hash (the link before it) and link.

    Links accumulate: a link is the digest of its number and of four running sums over 48-bit pieces of the digests of all entries up to
    it, each with its number, so an entry that is changed, dropped, added or moved changes every later link. Sums are one
    window, which no key's entries have to be gathered for.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy("ts", "id")
    rows = entries.withColumn("own_hash", F.sha2(canonical("id", "ts", "action", "subject"), 256)).withColumn("seq", F.row_number().over(w))
    rows = rows.withColumn("_d", F.sha2(F.concat_ws(":", F.col("seq").cast("string"), "own_hash"), 256))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    piece = lambda n: F.conv(F.substring("_d", 12 * n + 1, 12), 16, 10).cast("decimal(20,0)")
    sums = [F.sum(piece(n)).over(upto).cast("string") for n in range(4)]
    rows = rows.withColumn("link", F.sha2(F.concat_ws(":", F.col("seq").cast("string"), *sums), 256)).drop("_d")
    return rows.withColumn("prev_hash", F.coalesce(F.lag("link").over(w), F.lit("")))
