"""A corpus pipeline of the text operators: documents in, token ids out.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of
documents, whatever else those are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import byte_bpe, exact_dedup, jaccard_join, langid, mixing
from siltstone.llm.common import crc_mod, free, saved, table
from siltstone.llm.queries import CAP, WEIGHTS
from siltstone.session import ready


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows; what it rejects goes.

    It learns from the labelled documents whose crc32 of the id, modulo 4, is not 2.
    """
    ready(spark)
    model = langid.fit(docs.select("doc_id", "text", "lang").filter(crc_mod("doc_id", 4) != 2))
    prefix = free(docs, "langid_")
    rows = langid.identify(docs, model, prefix=prefix)
    return rows.filter(~F.col(f"{prefix}rejected")).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of equal texts."""
    ready(spark)
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by 5-word shingles at 0.75 or more."""
    ready(spark)
    return jaccard_join.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ready(spark)
    return mixing.mix(docs, WEIGHTS, CAP)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of what they decode to, and the ids, of every document."""
    ready(spark)
    ranks = byte_bpe.load_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL expresses neither the classifier nor the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
