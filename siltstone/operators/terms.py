"""Terms of texts, counted inside their row by arrays over many texts at once; nothing is shuffled, and a row is a document.

Spark lower-cases a text and cuts it into words. A batch's different words are stemmed once each, and a pair of neighbours is a number
made of two, so that Python works on the different words of a batch and arrays on all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, SUFFIXES

#: Bytes of text that are counted at once in a task (one longer text is held whole), and rows of a batch that goes back to Spark.
PIECE, ROWS = 4 << 20, 1 << 16
_STOP = pa.array(STOP_WORDS)


def words(text: Column) -> Column:
    """A lower-case text with one space for all that is neither letter nor digit; null: empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")


def _stems(words: pa.Array) -> pa.DictionaryArray:
    """functions.text.stem of each word; null where it is no term."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False)
    out = words.to_numpy(zero_copy_only=False)
    left = size >= 2
    term = left.copy()
    for s, instead in SUFFIXES:
        at = np.flatnonzero(left & (size > len(s) + 2) & pc.ends_with(words, s).to_numpy(zero_copy_only=False))
        cut = pc.utf8_slice_codeunits(words.take(pa.array(at)), 0, -len(s))
        out[at] = (pc.binary_join_element_wise(cut, instead, "") if instead else cut).to_numpy(zero_copy_only=False)
        left[at] = False
    found = pa.array(out, pa.string(), mask=~term)
    return pc.if_else(pc.is_in(found, _STOP), pa.scalar(None, pa.string()), found).dictionary_encode()


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits, each of which depends on all of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(texts: pa.Array, stemmed: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, number of the stem) of each place of the texts that is a stem, and the stems by number."""
    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    words = flat.dictionary
    stems = pc.if_else(pc.equal(words, ""), pa.scalar(None, pa.string()), words).dictionary_encode() if stemmed else _stems(words)
    code = stems.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    at = code[flat.indices.to_numpy(zero_copy_only=False)]
    return row[at >= 0], at[at >= 0], stems.dictionary


class Counted:
    """The terms of some texts, or of their stems: for each text (row) and different term its number n; terms are stems, or pairs of them by number."""

    def __init__(self, texts: pa.Array, stemmed: bool = False):
        row, at, self.stems = _places(texts, stemmed)
        v = len(self.stems)
        next_to = np.flatnonzero(row[1:] == row[:-1])
        row, key = np.concatenate([row, row[next_to]]), np.concatenate([at, v + at[next_to] * v + at[next_to + 1]])
        self.size = np.bincount(row, minlength=len(texts))  # terms of each text, with repeats
        each = v + v * v
        if len(texts) * each < 1 << 63:
            both = np.sort(row * each + key)
            first = np.flatnonzero(np.diff(both, prepend=-1))
            self.n = np.diff(np.append(first, len(both)))
            self.row, key = np.divmod(both[first], max(1, each))
        else:
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(key, prepend=-1) != 0))
            self.n = np.diff(np.append(first, len(row)))
            self.row, key = row[first], key[first]
        self.key = key

    def _parts(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which keys are pairs, the first stem of each, and the second ones of the pairs."""
        v = len(self.stems)
        pair = key >= v
        return pair, np.where(pair, (key - v) // max(1, v), key), (key[pair] - v) % max(1, v)

    def names(self, key: np.ndarray) -> pa.Array:
        """Terms as strings: stems of a pair are joined by an underscore, which no stem has."""
        pair, a, b = self._parts(key)
        second = np.zeros(len(key), np.int64)
        second[pair] = b
        one = self.stems.take(pa.array(a))
        two = pc.binary_join_element_wise(one, self.stems.take(pa.array(second)), "_") if len(key) else one
        return pc.if_else(pa.array(pair), two, one)

    def extremes(self, start: np.ndarray) -> tuple[list[str], list[str]]:
        """The least and the greatest term of each text, in the order of bytes, where start has the place of its first term."""
        stems, v = self.stems.to_pylist(), len(self.stems)

        def places(of):
            order = np.array(sorted(range(v), key=of))
            rank = np.empty(v, np.int64)
            rank[order] = np.arange(v)
            return order, rank

        # pairs are in the order of their first stems, each followed by its underscore, and then of the second ones
        (own, rank), (head, head_rank) = places(lambda i: stems[i].encode()), places(lambda i: stems[i].encode() + b"_")
        pair, a, b = self._parts(self.key)
        least = np.minimum.reduceat(np.where(pair, v, rank[a]), start)  # a pair comes after its first stem
        most = np.maximum.reduceat(np.where(pair, -1, rank[a]), start)
        place = np.full(len(a), -1)
        place[pair] = head_rank[a[pair]] * v + rank[b]
        pairs = np.maximum.reduceat(place, start)
        two = [stems[head[p // v]] + "_" + stems[own[p % v]] if p >= 0 else "" for p in pairs.tolist()]
        return [stems[own[i]] for i in least], [max(stems[own[i]], t, key=str.encode) for i, t in zip(most, two, strict=True)]

    @cached_property
    def _own_hashes(self) -> np.ndarray:
        return pd.util.hash_array(self.stems.to_numpy(zero_copy_only=False), categorize=False)

    def hashes(self, key: np.ndarray) -> np.ndarray:
        """Terms as 64-bit hashes; that of a pair is made of those of its stems."""
        own = self._own_hashes
        pair, a, b = self._parts(key)
        out = own[a] if len(own) else np.empty(0, np.uint64)
        out[pair] = mixed(out[pair] * np.uint64(0x9E3779B97F4A7C15) + own[b] if len(own) else out[pair])
        return out.view(np.int64)

    def all_hashes(self) -> np.ndarray:
        """hashes() of all keys."""
        return np.concatenate([self.hashes(self.key[at]) for at in _slices(len(self.key))] or [np.empty(0, np.int64)])


def pieces(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows whose last column has words(), in pieces of about so many bytes (PIECE)."""
    for b in batches:
        sizes = np.cumsum(pc.binary_length(b.column(b.num_columns - 1)).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < b.num_rows:
            end = int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + (most or PIECE), side="right"))
            end = max(begin + 1, end)
            yield b.slice(begin, end - begin)
            begin = end


def counted(batches: Iterator[pa.RecordBatch], stemmed: bool = False, most: int | None = None) -> Iterator[tuple[pa.RecordBatch, Counted]]:
    """Rows whose last column has words() or stems, in pieces of bounded size, with their terms."""
    for part in pieces(batches, most):
        yield part, Counted(part.column(part.num_columns - 1), stemmed)


def _slices(n: int) -> Iterator[slice]:
    return (slice(i, i + ROWS) for i in range(0, n, ROWS))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("words")), docs.schema[id_col].dataType.simpleString()


def term_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, n, tf): counts, and counts over all terms of the text."""

    def run(batches):
        for b, c in counted(batches):
            for at in _slices(len(c.n)):
                row, n = c.row[at], c.n[at]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), c.names(c.key[at]), pa.array(n), pa.array(n / c.size[row])], names=["id", "term", "n", "tf"])

    rows, kind = _rows(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {kind}, term string, n long, tf double")


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, terms, different, first_term, last_term) of each text that has terms: their number, that of different ones, the least and the greatest."""

    def run(batches):
        for b, c in counted(batches):
            rows, start = np.unique(c.row, return_index=True)
            if len(rows):
                first, last = c.extremes(start)
                different = np.diff(np.append(start, len(c.row)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(c.size[rows]), pa.array(different), pa.array(first, pa.string()), pa.array(last, pa.string())], names=["id", "terms", "different", "first_term", "last_term"])

    rows, kind = _rows(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {kind}, terms long, different long, first_term string, last_term string")


def frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, df): the number of texts that have a term. Texts of a piece are counted together before anything is shuffled."""

    def run(batches):
        for _, c in counted(batches):
            key, df = np.unique(c.key, return_counts=True)
            for at in _slices(len(key)):
                yield pa.RecordBatch.from_arrays([c.names(key[at]), pa.array(df[at])], names=["term", "df"])

    rows = docs.select(words(F.col(text_col)).alias("words"))
    return rows.mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def term_vectors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, size, terms, tf): each text's different terms as 64-bit hashes, their number, and their share of all its terms."""
    rows, kind = _rows(docs, id_col, text_col)
    return _vectors(rows, kind, False)


def stemmed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words, stems): the stems of each text in their order with a space between them, and their number. All terms of the text can be counted from them."""

    def run(batches):
        for b in pieces(batches):
            row, at, stems = _places(b.column(1), False)
            ends = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), stems.take(pa.array(at))), " ")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends)), joined], names=["id", "words", "stems"])

    rows, kind = _rows(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {kind}, words int, stems string")


def stem_vectors(stems: DataFrame) -> DataFrame:
    """term_vectors() of texts whose stems are given (id, words, stems)."""
    return _vectors(stems.select("id", "stems"), stems.schema["id"].dataType.simpleString(), True)


def _vectors(rows: DataFrame, kind: str, of_stems: bool) -> DataFrame:
    def run(batches):
        for b, c in counted(batches, of_stems):
            ends = np.searchsorted(c.row, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (c.all_hashes(), c.n / c.size[c.row])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends)), *lists], names=["id", "size", "terms", "tf"])

    return rows.mapInArrow(run, f"id {kind}, size int, terms array<long>, tf array<double>")


def postings(vectors: DataFrame) -> DataFrame:
    """(id, term, tf) of term_vectors()."""
    return vectors.select("id", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tf").alias("tf")))).toDF("id", "term", "tf")


def hashed_terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf) with terms as 64-bit hashes."""
    return postings(term_vectors(docs, id_col, text_col))
