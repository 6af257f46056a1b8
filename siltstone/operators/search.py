"""Retrieval: TF-IDF, vectors, hybrid fusion, Jaccard recall, keyword relevance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import jaccard, word_set
from ..session import exists, saved
from .prefixes import frequent, hashed, prefixes
from .term_weights import QUERIED, SENT, lengths, products
from .terms import hashed_terms, postings, stem_vectors, stemmed


def idf_table(terms: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf): ln(N / df)."""
    return weighed(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n_docs)


def weighed(frequencies: DataFrame, n_docs: int) -> DataFrame:
    """frequencies (term, df) with idf."""
    return frequencies.withColumn("idf", F.log(F.lit(float(max(1, n_docs))) / F.col("df")))


#: Terms that are weighed without moving their postings: as many at most, so their table may be broadcast.
HOT_TERMS = 10_000


@dataclass
class TermIndex:
    """A saved inverted index: postings (id, term, tf, w) and documents (id, norm), with their number."""

    terms: DataFrame
    postings: DataFrame
    norms: DataFrame
    documents: int

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> TermIndex:
        return cls.of(saved(hashed_terms(docs, id_col, text_col), "index-terms"), docs.count())

    @classmethod
    def of(cls, terms: DataFrame, documents: int) -> TermIndex:
        """An index of saved terms (id, term, tf)."""
        idf = saved(idf_table(terms, documents), "index-idf")
        # the postings of a frequent term meet its weight where they are; as the dfs add up to the postings, few terms are frequent
        least = max(1000, terms.count() // HOT_TERMS + 1)
        hot, rest = idf.filter(F.col("df") >= least).select("term", "idf"), idf.filter(F.col("df") < least).select("term", "idf")
        both = terms.join(F.broadcast(hot), "term").unionByName(terms.join(F.broadcast(hot), "term", "left_anti").join(rest, "term"))
        postings = saved(both.select("id", "term", "tf", (F.col("tf") * F.col("idf")).alias("w")), "index-postings")
        norms = saved(postings.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "index-norms")
        return cls(terms, postings, norms, documents)

    def exists(self) -> bool:
        return all(exists(df.sparkSession, df._scratch) for df in (self.terms, self.postings, self.norms))

    def replaced(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> TermIndex:
        """The index with documents added, or replaced where their id is known. A document without terms still counts."""
        ids = docs.select(F.col(id_col).alias("id")).distinct()
        old = self.norms.join(ids, "id", "left_semi").count()
        terms = self.terms.join(ids, "id", "left_anti").unionByName(hashed_terms(docs, id_col, text_col))
        return TermIndex.of(saved(terms, "index-terms"), self.documents - old + ids.count())

    def removed(self, ids: DataFrame) -> TermIndex:
        """The index without documents (id)."""
        gone = self.norms.join(ids.select("id").distinct(), "id", "left_semi").count()
        return TermIndex.of(saved(self.terms.join(ids.select("id").distinct(), "id", "left_anti"), "index-terms"), self.documents - gone)

    def search(self, queries: DataFrame, k: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """The k best documents of every query by the cosine of its TF with their TF-IDF; ties go to the smaller id.

        Terms of the queries select the postings before anything else.
        """
        q = hashed_terms(queries, id_col, text_col).withColumnRenamed("id", "query")
        q_norms = q.groupBy("query").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("q_norm"))
        hits = self.postings.select("id", "term", "w").join(q, "term")
        dots = hits.groupBy("query", "id").agg(F.sum(F.col("w") * F.col("tf")).alias("dot")).filter("dot > 0")
        scored = dots.join(self.norms, "id").join(q_norms, "query").filter("norm > 0 AND q_norm > 0")
        return top_k(scored.select("query", "id", (F.col("dot") / (F.col("norm") * F.col("q_norm"))).alias("score")), k)


def cosine_topk(stems: DataFrame, documents: int, queries: DataFrame, k: int, id_col: str = "item_id", text_col: str = "text", repeats: bool = False) -> DataFrame:
    """The k best of so many documents, of which there are saved stems (terms.stemmed), for every query, without a saved index of their terms.

    Terms are counted where they are used. All postings are dealt by term once, as arrays; their numbers of documents are counted where they are weighed,
    and only lengths leave those tasks. Where queries have few postings, the products with a document are added in its own row. repeats: an id may have several rows.
    """
    q = saved(hashed_terms(queries, id_col, text_col).select(F.col("id").alias("query"), "term", F.col("tf").alias("q_tf")), "index-query")
    q_norms = q.groupBy("query").agg(F.sqrt(F.sum(F.col("q_tf") * F.col("q_tf"))).alias("q_norm"))
    asked = q.select("term").distinct()
    few = q.count() <= QUERIED
    norms, df = lengths(stems, documents, asked if few else None)
    if few:
        idf = F.log(F.lit(float(max(1, documents))) / F.col("df"))
        dots = products(stems, q.join(df, "term").select("query", "term", (F.col("q_tf") * idf).alias("w")))
        if repeats:
            dots = dots.groupBy("query", "id").agg(F.sum("dot").alias("dot"))
    else:
        found = saved(postings(stem_vectors(stems)).join(asked, "term", "left_semi"), "index-found")
        weights = idf_table(found, documents).select("term", "idf")
        dots = found.join(weights.join(q, "term"), "term").groupBy("query", "id").agg(F.sum(F.col("tf") * F.col("idf") * F.col("q_tf")).alias("dot"))
    norms = F.broadcast(norms) if documents <= SENT else norms
    scored = dots.filter("dot > 0").join(norms, "id").join(q_norms, "query").filter("norm > 0 AND q_norm > 0")
    return top_k(scored.select("query", "id", (F.col("dot") / (F.col("norm") * F.col("q_norm"))).alias("score")), k)


def tfidf_search(docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", query_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """The k best documents of every query, by stems that are saved for this search."""
    repeats = not docs.groupBy(doc_id).count().filter("count > 1").isEmpty()
    return cosine_topk(saved(stemmed(docs, doc_id, text_col), "stems"), docs.count(), queries, k, query_id, text_col, repeats)


def top_k(scored: DataFrame, k: int, by: Sequence[str] = ("query",)) -> DataFrame:
    """The k best rows (query, id, score) of each query, numbered. Spark cuts each task's rows to k first."""
    w = W.partitionBy(*by).orderBy(F.round("score", 9).desc(), F.col("id"))  # what differs by the order of a sum is a tie
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", rows: int = 4096, block: int = 512) -> DataFrame:
    """The k nearest vectors of every query vector by cosine over 0; exact, in blocks.

    Vectors are dealt into parts of about `rows` and queries into blocks of about
    `block`; a task multiplies one part with one block and gives each query's k best
    there. What a task holds is bounded whatever the sizes are, and nothing is sent
    to every task.
    """
    parts, blocks = max(1, -(-vectors.count() // rows)), max(1, -(-queries.count() // block))
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("bigint").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    q = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block"))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for width in {len(x) for x in b["v"] if x is not None}:
            x, y = (d[[z is not None and len(z) == width for z in d["v"]]] for d in (a, b))
            if len(x) and len(y) and width:
                m, n = (np.stack(d["v"].to_numpy()).astype(np.float64) for d in (x, y))
                size = np.linalg.norm(n, axis=1)[:, None] * np.linalg.norm(m, axis=1)[None]
                cos = np.divide(n @ m.T, size, out=np.zeros(size.shape), where=size > 0)
                ids, own = x["id"].to_numpy(), y["id"].to_numpy()
                cos[own[:, None] == ids[None]] = -1
                for i, row in enumerate(cos):
                    # a few more than k, so that ties are settled by id later
                    floor = np.partition(row, -k)[-k] - 1e-9 if len(row) > k else -1
                    out += [(own[i], ids[j], row[j]) for j in np.flatnonzero((row > 0) & (row >= floor))]
        return pd.DataFrame(out, columns=["query", "id", "score"])

    kind = vectors.schema[id_col].dataType.simpleString()
    found = v.groupBy("part", "block").cogroup(q.groupBy("part", "block")).applyInPandas(nearest, f"query {kind}, id {kind}, score double")
    return top_k(found, k)


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, k: int = 10, text_weight: float = 0.3, vector_weight: float = 0.7, least: float = 0.1) -> DataFrame:
    """Weighted sums of two top lists (query, id, score); scores under least go."""
    both = text_hits.select("query", "id", (F.col("score") * text_weight).alias("score")).unionByName(vector_hits.select("query", "id", (F.col("score") * vector_weight).alias("score")))
    return top_k(both.groupBy("query", "id").agg(F.sum("score").alias("score")).filter(F.col("score") >= least), k)


def recall(entries: DataFrame, queries: DataFrame, k: int, least: float = 0.3, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """The k entries most like each query by the Jaccard likeness of their word sets, at least `least` (over 0).

    Prefixes of rare words are joined, so a word that is in all entries brings none of them together with a query; what met is compared exactly.
    """
    sets = lambda df: saved(hashed(df.select(F.col(id_col).alias("id"), word_set(F.col(text_col)).alias("words")).filter(F.size("words") > 0)), "word-sets")
    e, q = sets(entries), sets(queries)
    hot = frequent(e)
    met = prefixes(e, least, hot).join(prefixes(q, least, hot).select(F.col("id").alias("query"), F.col("n").alias("q_n"), "word"), "word")
    met = met.filter((F.least("n", "q_n") >= F.greatest("n", "q_n") * least)).select("query", "id").distinct()
    both = met.join(e.select("id", "words"), "id").join(q.select(F.col("id").alias("query"), F.col("words").alias("q_words")), "query")
    common = F.size(F.array_intersect("words", "q_words"))
    scored = both.select("query", "id", (common / (F.size("words") + F.size("q_words") - common)).alias("score"))
    return top_k(scored.filter(F.col("score") >= least), k)


def relevance(row: dict[str, Column], query: Column, tags: Column | None = None) -> Column:
    """0.5 if the id holds the query, 0.3 the message, 0.2 the fix, 0.1 for each tag; at most 1."""
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(query))
    score = F.when(has(row["id"]), 0.5).otherwise(0.0) + F.when(has(row["message"]), 0.3).otherwise(0.0) + F.when(has(row["fix"]), 0.2).otherwise(0.0)
    if tags is not None:
        score = score + F.size(F.filter(tags, has)) * 0.1
    return F.least(F.lit(1.0), score)


def keyword_scores(texts: DataFrame, key: Sequence[str], topics: dict[str, Sequence[str]], text_col: str = "text") -> DataFrame:
    """(key, topic, score): the share of a topic's keywords that a text holds, where any does; narrow."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))

    def share(words: Sequence[str]) -> Column:
        hits = [F.contains(low, F.lit(w)).cast("int") for w in words]
        return sum(hits[1:], hits[0]) / len(words)

    each = F.array(*(F.struct(F.lit(t).alias("topic"), share(w).alias("score")) for t, w in topics.items()))
    return texts.select(*key, F.explode(each).alias("s")).select(*key, "s.topic", "s.score").filter("score > 0")


def best_topic(scored: DataFrame, key: Sequence[str], default: str = "unknown") -> DataFrame:
    """Each key's best topic (ties by name), its score, and its alternatives over 0.1."""
    best = scored.groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("m"), F.col("topic").alias("t"))).alias("b"), F.array_sort(F.collect_list(F.when(F.col("score") > 0.1, F.col("topic")))).alias("_all"))
    return best.select(*key, F.coalesce("b.t", F.lit(default)).alias("topic"), (-F.col("b.m")).alias("score"), F.filter("_all", lambda t: t != F.col("b.t")).alias("alternatives"))


def similarity(a: Column, b: Column) -> Column:
    return jaccard(word_set(a), word_set(b))
