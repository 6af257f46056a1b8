"""The thin queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, fill_in_middle, fingerprints, jaccard_join, katz, langid, line_dedup, mixing, perspectives, releases, token_counts, warc
from .common import WORD, crc_mod, scratch_path, table

Query = Callable[[SparkSession, str], DataFrame]


#: Weights of sources in order of name, repeating, and the most copies of a document.
WEIGHTS, CAP = (1.0, 2.0, 3.0), 3.0


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(mixing.word_counts(table(spark, sf_dir, "documents")), WEIGHTS, CAP)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path, min_revisit_bytes=0)
    return warc.digests(warc.read_archive(spark, path))


def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", "lang", (crc_mod("doc_id", 4) == 2).alias("held_out"))
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.load_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = token_counts.load_tokenizer(spark, public_tokenizers.path("word_bpe_49k.json"))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return releases.quarantine(table(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fill_in_middle.restored()).alias("restored_sha256"))


OPERATORS = (
    op1_mixing,
    op2_fingerprints,
    op3_exact_dedup,
    op4_warc,
    op5_perspectives,
    op6_langid,
    op7_byte_bpe,
    op8_token_counts,
    op9_jaccard_join,
    op10_katz,
    op11_line_dedup,
    op12_releases,
    op13_fill_in_middle,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": OP1,
        "op3_exact_dedup": OP3,
        "op4_warc": OP4,
        "op5_perspectives": perspectives.ORACLE,
        "op11_line_dedup": line_dedup.ORACLE,
        "op12_releases": releases.ORACLE,
        "op13_fill_in_middle": fill_in_middle.ORACLE,
    }


OP1 = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3.0::DOUBLE * sum(size) AS cap FROM d GROUP BY source),
w AS (SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 AS w FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER a, 0) AS c, coalesce(sum(w) OVER a, 0) AS v FROM w
      WINDOW a AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - c) / ((SELECT sum(w) FROM w) - v) AS x FROM o),
l AS (SELECT coalesce(arg_min(x, v) FILTER (x <= cap / w), 0) AS level FROM e),
t AS (SELECT source, source_size, least(w * level, cap) AS target,
        CASE WHEN source_size > 0 THEN least(w * level, cap) / source_size ELSE 0 END AS rate,
        ('0x' || left(md5('0:' || coalesce(source, chr(0))), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM w, l),
n AS (SELECT d.doc_id, d.size, t.*, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS n
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, floor(n * rate + u) AS upto, floor(u) AS none FROM n)
SELECT doc_id, size, source_size, target,
  CAST(upto - coalesce(lag(upto) OVER (PARTITION BY source ORDER BY n), none) AS BIGINT) * size AS taken FROM p
"""

OP3 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (t)
"""

#: DuckDB's sha1() is hexadecimal; five of its digits are four of base 32.
OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html),
b AS (SELECT page_id, html, list_reduce(list_transform(range(32), lambda i: 
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS BIGINT) + 1, 1)),
        lambda a, c: a || c) AS payload_digest FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b JOIN f USING (html)
"""
