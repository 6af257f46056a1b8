"""Katz back-off scoring with Good-Turing discounts, learned from the corpus it scores.

A text is its words and one end; begin marks stand before it. With c the counts in
training texts, C(h) the count of h as a history, and d_n the Good-Turing discounts of
counts up to K of n-grams (larger counts are kept)::

    P(w|h) = d_n(c(h,w)) c(h,w) / C'(h)       if c(h,w) > 0
             a(h) P(w|h')                     otherwise, h' being h without its first word
    P(w)   = d_1(c(w)) c(w) / N'              and all mass that is left for a word never seen
    a(h)   = (1 - sum of P(w|h) over w seen after h) / (1 - sum of P(w|h') over the same w)

so P(.|h) sums to 1 exactly for every h, and a(h) is 1 for a history never seen.
C' is C, but C + 1 for a history none of whose counts is discounted, which would leave no mass
(N' likewise). Where Good-Turing discounts do not exist (too few counts of
counts), absolute discounting takes their place.

How it runs. Words and histories are 64-bit hashes. Rows that move are not n-grams but
compressed arrays of them, one per chunk of documents and bucket; there are as many
buckets as the number of tokens asks for.

1. *Chunks* of whole documents with their own vocabularies are saved.
2. For each order n, a chunk sends its different n-grams to the buckets of their
   histories. The few histories that are frequent enough to be skewed (at most HOT by
   construction) are dealt by n-gram instead. The owner of a bucket adds the counts up
   and saves two things: the table of the bucket's n-grams, with what each history's
   weight depends on, and for each chunk the counts that it asked for.
3. Chunks evaluate every token from order 1 up by the recursion above.

``Model.ngrams(n)`` and ``Model.weights(n)`` read the saved tables: counts and
probabilities of n-grams, and back-off weights of histories.

Defined cases: null text is empty and has the end token alone; null ids count as
training; rows that repeat an id are separate texts; very long texts are one chunk's;
without training texts every token has probability 1 (of the one unknown class); an empty
table gives an empty result; extra columns are ignored, whatever they are called.
The input's sizes are read first, and its texts once. Order 3 moves about twice what order 2 does: nearly every history is then another hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .arrays import pack as _pack
from .arrays import unpack as _unpack
from .common import delete, dropped, finished, partitions, saved, scratch_path

ORDER, K = 2, 5
#: A history is dealt by n-gram if its share of all tokens is over 1 / HOT and it has HOT_LEAST tokens.
HOT, HOT_LEAST = 65_000, 500
CHUNK_TOKENS = 1_500_000
#: Tokens for each bucket: an owner holds the n-grams of one bucket.
BUCKET_TOKENS = 1 << 21
#: Bytes of a word and its blank, to estimate the number of tokens.
WORD_BYTES = 6
END, BEGIN = b"", b" "  # no word is either
_END, _BEGIN = 0, 1  # their places in a chunk's vocabulary
_RARE = 0xFFFF
#: Sums of probabilities of the hot histories are added as whole numbers, so that their order does not matter.
_FIXED = float(1 << 60)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Consecutive rows of equal first column."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[0] != key and rows:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield key, rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def _gram(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of their histories and last words."""
    return _mix(_mix(history) * np.uint64(0x9E3779B97F4A7C15) + _mix(word))


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def discounts(n: list[int]) -> np.ndarray:
    """Factors for counts 1 to K from counts of counts 1 to K + 1."""
    r = np.arange(1, K + 1)
    n = np.array(n, float)
    with np.errstate(all="ignore"):
        tail = (K + 1) * n[K] / n[0]
        d = ((r + 1) * n[1:] / (r * n[:-1]) - tail) / (1 - tail)
    if np.isfinite(d).all() and (d > 0).all() and (d < 1).all():
        return d
    absolute = min(0.9, max(0.1, n[0] / (n[0] + 2 * n[1]))) if n[0] else 0.5
    return (r - absolute) / r


def _kept(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Counts after discounting."""
    return np.where(c > K, 1.0, np.concatenate(([0.0], d))[np.minimum(c, K)]) * c


def _left(d: np.ndarray, kinds) -> np.ndarray:
    """What discounting takes from a distribution with kinds[r - 1] words of count r."""
    return sum((1 - d[r - 1]) * r * n for r, n in enumerate(kinds, 1))


class Unigrams:
    """Probabilities of words by their training count."""

    def __init__(self, total: int, types: int, counts_of_counts: list[int]):
        self.total, self.types = total, types
        self.d = discounts(counts_of_counts)
        short = int(not any(counts_of_counts[:K]))
        self.n = total + short
        self.unseen = (float(_left(self.d, counts_of_counts[:K])) + short) / self.n if total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, _kept(self.d, c) / max(1, self.n), self.unseen)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.total + 1.0 * (self.types + 1)))


@dataclass
class Known:
    """What every task knows; its arrays have at most HOT + 1 places."""

    width: int  # buckets
    uni: Unigrams | None = None
    texts: int = 0  # of training
    d: dict[int, np.ndarray] = field(default_factory=dict)
    hot: dict[int, np.ndarray] = field(default_factory=dict)  # hashes of the hot histories of order n, sorted
    hot_count: dict[int, np.ndarray] = field(default_factory=dict)
    hot_short: dict[int, np.ndarray] = field(default_factory=dict)  # whether C' is C + 1
    hot_weight: dict[int, np.ndarray] = field(default_factory=dict)

    def place(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which are hot histories, their places)."""
        hot = self.hot[n]
        if not len(hot):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
        return hot[at] == hashes, at


class _Words(dict):
    """Word to place; new words get the next."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


_ROW = "chunk long, level int, bucket int, kind string, data binary, stats array<long>"
_CHUNK = "chunk long, level int, bucket int, n long, data binary"


def _row(chunk: int, level: int, bucket: int, kind: str, data: bytes, stats=()) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([level], pa.int32()), pa.array([bucket], pa.int32()), pa.array([kind]), pa.array([data], pa.binary()), pa.array([list(stats)], pa.list_(pa.int64()))], names=["chunk", "level", "bucket", "kind", "data", "stats"])


def _chunks(df: DataFrame, id_col: str, text_col: str, held: Column) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        import xxhash

        task, number = TaskContext.get().partitionId(), 0
        ids, out, parts, size, words, id_type = [], [], [], 0, _Words(), None

        def close():
            if number >= 1 << 32:
                raise ValueError("a task has more chunks than numbers")
            vocab = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            lengths = np.array([len(x) for x in parts], np.int64)
            tokens = np.concatenate(parts)
            train = np.repeat(~np.array(out, bool), lengths)
            counts = np.bincount(tokens[train], minlength=len(words))
            counts[_BEGIN] = len(out) - sum(out)  # as a history
            blob = _pack(lengths, np.array(out, np.uint8), tokens, vocab, counts)
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + number], pa.int64()), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([len(tokens)], pa.int64()), pa.array([blob], pa.binary()), pa.array([ids], pa.list_(id_type))], names=["chunk", "level", "bucket", "n", "data", "ids"])

        for b in batches:
            id_type = b.schema.field(0).type
            for i, t, h in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not parts:
                    words = _Words({END: _END, BEGIN: _BEGIN})
                own = list(map(words.__getitem__, t.lower().split())) if t else []
                own.append(_END)
                parts.append(np.array(own, np.uint32))
                ids.append(i)
                out.append(bool(h))
                size += len(own)
                if size >= CHUNK_TOKENS:
                    yield close()
                    number, ids, out, parts, size = number + 1, [], [], [], 0
        if parts:
            yield close()

    return df.select(F.col(id_col), F.col(text_col), held).mapInArrow(run, f"{_CHUNK}, ids array<{kind}>")


# Order 1


def _word_deal(vocab: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word, words in order of bucket and hash)."""
    to = (_mix(vocab) % np.uint64(width)).astype(np.int64)
    return to, np.lexsort((vocab, to))


def _unigrams(chunks: DataFrame, width: int) -> DataFrame:
    """Rows of each bucket: 'told' (a chunk's words' totals) and 'table' (words and counts)."""

    def send(batches):
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                vocab, counts = _unpack(blob)[3:5]
                vocab = vocab.astype(np.uint64)
                to, order = _word_deal(vocab, width)
                for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                    yield _row(chunk, 1, int(to[part[0]]), "ask", _pack(np.diff(vocab[part], prepend=np.uint64(0)), counts[part]))

    def count(batches):
        begin = np.uint64(word_hash(BEGIN))
        for bucket, rows in _groups(batches):
            parts = [_unpack(r[2]) for r in rows]
            parts = [(np.cumsum(x.astype(np.uint64), dtype=np.uint64), n) for x, n in parts]
            words, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            total = np.zeros(len(words), np.int64)
            np.add.at(total, back, np.concatenate([p[1] for p in parts]))
            at = 0
            for r, p in zip(rows, parts, strict=True):
                yield _row(r[1], 1, bucket, "told", _pack(total[back[at : at + len(p[0])]]))
                at += len(p[0])
            token = (words != begin) & (total > 0)
            texts = int(total[words == begin].sum())
            yield _row(-1, 1, bucket, "table", _pack(words[total > 0], total[total > 0]), [texts, int(total[token].sum()), int(token.sum()), *(int((total[token] == r).sum()) for r in range(1, K + 2))])

    sent = chunks.select("chunk", "data").mapInArrow(send, _ROW).select("bucket", "chunk", "data")
    return sent.repartition(width, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(count, _ROW)


def _hot_words(table: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of the words with at least so many tokens (at most HOT and the begin mark)."""

    def pick(batches):
        for b in batches:
            for blob in b.column(0).to_pylist():
                words, total = _unpack(blob)
                if (total >= least).any():
                    yield pa.RecordBatch.from_arrays([pa.array(words[total >= least].astype(np.uint64).view(np.int64)), pa.array(total[total >= least])], names=["w", "c"])

    return _sorted_hot([(r.w, r.c) for r in table.select("data").mapInArrow(pick, "w long, c long").collect()])


def _sorted_hot(found: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    words = np.array([w for w, _ in found], np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], np.array([c for _, c in found], np.int64)[order]


# Orders from 2


@dataclass
class Grams:
    """The different n-grams of a chunk, in order of their histories' hashes."""

    history: np.ndarray  # of each n-gram, a place among the chunk's (n - 1)-grams
    word: np.ndarray  # its last word
    at: np.ndarray  # which n-gram ends at each token
    hashes: np.ndarray  # of the (n - 1)-grams
    order: np.ndarray  # n-grams in order of bucket
    cuts: np.ndarray  # where a bucket begins in that order
    bucket: np.ndarray  # in that order
    heads: np.ndarray  # where a history begins in that order
    is_hot: np.ndarray  # of the (n - 1)-grams
    place: np.ndarray


class Chunk:
    """A chunk, and what the owners of buckets told it: counts of words, and of n-grams up to some order."""

    def __init__(self, rows: list[tuple], known: Known):
        self.known = known
        lengths, held, tokens, vocab, _ = _unpack(next(r[3] for r in rows if r[1] == 0))
        self.lengths, self.held, self.tokens, self.vocab = lengths, held, tokens, vocab.astype(np.uint64)
        self.starts = np.cumsum(lengths) - lengths
        self.told = {}
        for r in rows:
            if r[1]:
                self.told.setdefault(r[1], []).append((r[2], r[3]))
        self.count = {1: np.zeros(len(vocab), np.int64)}
        self.count[1][_word_deal(self.vocab, known.width)[1]] = np.concatenate([_unpack(x)[0] for _, x in sorted(self.told[1])])
        self.ids, self.hashes, self.pad = self.tokens, self.vocab, _BEGIN
        self.probability = known.uni.p(self.count[1])[self.tokens]
        self.total = None  # of the last order's histories

    def grams(self, n: int) -> Grams:
        """The n-grams of this order; the orders below have been taken before."""
        known, v = self.known, len(self.vocab)
        rank = np.empty(len(self.hashes), np.int64)
        by_hash = np.argsort(self.hashes, kind="stable")
        rank[by_hash] = np.arange(len(by_hash))
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.ids[:-1]
        before[self.starts] = self.pad
        pairs, at = np.unique(rank[before] * v + self.tokens, return_inverse=True)
        history, word = np.divmod(pairs, v)
        history = by_hash[history]
        is_hot, place = known.place(n, self.hashes)
        key = _mix(self.hashes)[history]
        split = is_hot[history]
        key[split] = _mix(self.hashes[history[split]] ^ _mix(self.vocab)[word[split]])
        bucket = (key % np.uint64(known.width)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, first = bucket[order], np.ones(len(order), bool)
        new = bucket[1:] != bucket[:-1]
        first[1:] = new | (history[order][1:] != history[order][:-1])
        return Grams(history, word, at, self.hashes, order, np.append(0, np.flatnonzero(new) + 1), bucket, np.flatnonzero(first), is_hot, place)

    def history_counts(self, n: int) -> np.ndarray:
        """Training counts of the histories of order n: those of the (n - 1)-grams, and the begin marks'."""
        return self.count[1] if n == 2 else np.append(self.count[n - 1], self.known.texts)

    def learn(self, n: int, g: Grams) -> None:
        """Take what the owners told about order n: counts, and probabilities of every token by the recursion."""
        known, d = self.known, self.known.d[n]
        told = [_unpack(x) for _, x in sorted(self.told[n])]
        counts, short, asked, *kinds, lower = (np.concatenate([t[i] for t in told]) for i in range(K + 4))
        c = np.empty(len(g.order), np.int64)
        c[g.order] = counts
        heads = g.history[g.order][g.heads]
        plus = np.zeros(len(g.hashes), np.int64)
        plus[heads] = short
        plus[g.is_hot] = known.hot_short[n][g.place[g.is_hot]]
        held = self.history_counts(n)
        total = held + plus
        weight = np.ones(len(g.hashes))
        at = heads[asked.astype(bool)]
        weight[at] = (_left(d, kinds) + plus[at]) / total[at] / (1 - lower)
        weight[g.is_hot] = known.hot_weight[n][g.place[g.is_hot]]
        weight[held == 0] = 1.0
        seen = _kept(d, c) / np.maximum(1, total[g.history])
        self.probability = np.where(c[g.at] > 0, seen[g.at], weight[g.history][g.at] * self.probability)
        hashes = _gram(g.hashes[g.history], self.vocab[g.word])
        self.total, self.last_word = total, g.word
        self.count[n], self.ids, self.pad = c, g.at, len(c)
        self.hashes = np.append(hashes, _gram(g.hashes[self.pad_of(n) :][:1], self.vocab[[_BEGIN]]))

    def pad_of(self, n: int) -> int:
        """The place of the begin marks among the (n - 1)-grams."""
        return _BEGIN if n == 2 else len(self.count[n - 1])

    def requests(self, n: int, chunk: int) -> Iterator[pa.RecordBatch]:
        """What to ask the owners of buckets about n-grams: a row for each bucket."""
        known, g = self.known, self.grams(n)
        train = np.bincount(g.at, weights=np.repeat(1 - self.held, self.lengths), minlength=len(g.order)).astype(np.int64)[g.order]
        word, history = g.word[g.order], g.history[g.order]
        hot, code = known.place(2, self.vocab)  # the frequent words have short codes
        rare = ~hot[word]
        code = np.where(rare, _RARE, code[word])
        hashes = self.vocab[word]
        if n == 2:
            low, low_total = np.where(rare, self.count[1][word], 0), None
        else:  # the (n - 1)-gram without the first word ends at the same token
            shorter = np.empty(len(g.order), np.int64)
            shorter[g.at] = self.ids
            low = self.count[n - 1][shorter[g.order]]
            low_total = self.total[self.shorter_history(n, g)]
        ends = np.append(g.cuts[1:], len(g.order))
        runs = np.diff(np.append(g.heads, len(g.order)))
        h_ends = np.searchsorted(g.heads, ends)
        h_at = 0
        for at, end, h_end in zip(g.cuts.tolist(), ends.tolist(), h_ends.tolist(), strict=True):
            heads = g.hashes[history[g.heads[h_at:h_end]]]
            r = rare[at:end]
            w = hashes[at:end][r]
            lows = low[at:end][r] if n == 2 else low[at:end]
            totals = low_total[g.heads[h_at:h_end]] if n > 2 else np.empty(0, np.int64)
            blob = _pack(np.diff(heads, prepend=np.uint64(0)), runs[h_at:h_end], code[at:end], w >> np.uint64(32), (w >> np.uint64(16)) & np.uint64(0xFFFF), train[at:end], lows, totals)
            yield _row(chunk, n, int(g.bucket[at]), "ask", blob)
            h_at = h_end

    def shorter_history(self, n: int, g: Grams) -> np.ndarray:
        """Of each n-gram in order of bucket, the place among the (n - 2)-grams of its history without the first word."""
        # a history (.., x) of order 3 goes on as (x) at order 2; the begin marks go on as the begin mark
        if n != 3:
            raise ValueError("orders above 3 are not built")
        last = np.append(self.last_word, _BEGIN)
        return last[g.history[g.order]]


def _own(n: int, order: int, rows: list[tuple], known: Known, least: int) -> Iterator[pa.RecordBatch]:
    """What the owner of a bucket makes of the n-grams that chunks sent."""
    bucket, parts = rows[0][0], [_unpack(r[2]) for r in rows]
    join = lambda i: np.concatenate([p[i] for p in parts])
    heads = np.concatenate([np.cumsum(p[0].astype(np.uint64), dtype=np.uint64) for p in parts])
    runs, code, train = join(1), join(2), join(5)
    H, W = np.repeat(heads, runs), code.astype(np.uint64)
    rare = code == _RARE
    W[rare] |= (join(3).astype(np.uint64) << np.uint64(32)) | (join(4).astype(np.uint64) << np.uint64(16))
    if n == 2:
        low = np.zeros(len(W), np.int64)
        low[rare] = join(6)
        low[~rare] = known.hot_count[2][code[~rare]]
        low_total = None
    else:
        low, low_total = join(6), np.repeat(join(7), runs)
    sizes = [(len(p[1]), len(p[2])) for p in parts]
    del parts
    by = np.lexsort((W, H))
    new = np.ones(len(by), bool)
    new[1:] = (H[by][1:] != H[by][:-1]) | (W[by][1:] != W[by][:-1])
    number = np.empty(len(by), np.int64)
    number[by] = np.cumsum(new) - 1
    one = by[new]  # a row of each different n-gram
    del by, new
    c = np.zeros(len(one), np.int64)
    np.add.at(c, number, train)
    h, first = H[one], np.ones(len(one), bool)
    first[1:] = h[1:] != h[:-1]
    hist = np.cumsum(first) - 1
    h = h[first]
    below = known.uni.p(low[one]) if n == 2 else _kept(known.d[n - 1], low[one]) / np.maximum(1, low_total[one])
    kinds = [np.bincount(hist, weights=c == r).astype(np.int64) for r in range(1, K + 1)]
    lower = np.bincount(hist, weights=below * (c > 0))
    C = np.bincount(hist, weights=c)
    short = (C > 0) & (sum(kinds) == 0)
    is_hot, place = known.place(n, h)
    seen = c > 0
    per = np.bincount(hist, weights=seen).astype(np.int64)
    code_one, W_one = code[one], W[one]
    table = _pack(np.diff(h, prepend=np.uint64(0)), per, code_one[seen], W_one[seen & (code_one == _RARE)] >> np.uint64(16), c[seen], *kinds, lower, is_hot)
    yield _row(-1, n, bucket, "table", table, [int((c == r).sum()) for r in range(1, K + 2)])
    if is_hot.any():
        yield _row(-1, n, bucket, "hot", _pack(place[is_hot], *(k[is_hot] for k in kinds), np.round(lower[is_hot] * _FIXED).astype(np.int64)))
    if n < order and (c >= least).any():
        many = np.flatnonzero(c >= least)  # their words are hot as well
        yield _row(-1, n, bucket, "next", _pack(_gram(h[hist[many]], known.hot[2][code_one[many]]), c[many]))
    at = head = 0
    for r, (n_heads, n_grams) in zip(rows, sizes, strict=True):
        mine = number[at : at + n_grams]
        run = runs[head : head + n_heads]
        of = np.repeat(np.arange(n_heads), run)
        hs = hist[mine[np.cumsum(run) - run]]
        ask = (np.bincount(of, weights=c[mine] == 0, minlength=n_heads) > 0) & (C[hs] > 0) & ~is_hot[hs]
        some = hs[ask]
        yield _row(r[1], n, bucket, "told", _pack(c[mine], short[hs] & ~is_hot[hs], ask, *(k[some] for k in kinds), lower[some]))
        at, head = at + n_grams, head + n_heads


class Model:
    """Tables of counts and weights, saved in buckets, and the score of the texts they come from."""

    def __init__(self, df: DataFrame, held: Column, id_col: str, text_col: str, order: int):
        spark = df.sparkSession
        self.order, self.id_type = order, df.schema[id_col].dataType
        size = df.agg(F.sum(F.octet_length(text_col) / WORD_BYTES + 1)).first()[0] or 0
        self.width = max(partitions(spark), int(size // BUCKET_TOKENS) + 1)
        self.known = Known(self.width)
        # in buckets by chunk, so that what a chunk is told comes to it and the chunk does not move
        self.path, self.table = scratch_path(spark, "katz-chunks"), f"siltstone_{uuid.uuid4().hex}"
        chunks = _chunks(df, id_col, text_col, held)
        try:
            chunks.write.bucketBy(self.width, "chunk").option("path", self.path).saveAsTable(self.table)
            self.chunks = spark.read.schema(chunks.schema).parquet(self.path)
            self._learn()
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {self.table}")  # its entry in the catalog; the files stay

    def _learn(self) -> None:
        spark, known, order = self.chunks.sparkSession, self.known, self.order
        self.rows = {1: saved(_unigrams(self.chunks, self.width), "katz-1")}
        finished(spark)
        sums = self._stats(1, K + 4)
        known.texts, known.uni = sums[0], Unigrams(sums[1], sums[2], sums[3:])
        least = max(HOT_LEAST, sums[1] // HOT + 1)
        known.hot[2], known.hot_count[2] = _hot_words(self.rows[1].filter("kind = 'table'"), least)
        for n in range(2, order + 1):
            self._count(n, least)
            finished(spark)

    def _stats(self, n: int, k: int) -> list[int]:
        return list(self.rows[n].filter("kind = 'table'").agg(*(F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(k))).first())

    def _told(self, n: int) -> list[DataFrame]:
        """What chunks were told about orders up to n."""
        return [self.rows[k].filter("kind = 'told'").select("chunk", "level", "bucket", "data") for k in range(1, n + 1)]

    def _with_answers(self, n: int) -> DataFrame:
        """(chunk, data, told) of every chunk: a row has one chunk's answers, as many as buckets."""
        told = reduce(DataFrame.unionByName, self._told(n)).groupBy("chunk").agg(F.collect_list(F.struct("chunk", "level", "bucket", "data")).alias("told"))
        return self.chunks.sparkSession.table(self.table).join(told.hint("merge"), "chunk").select("chunk", "data", "told")

    def _count(self, n: int, least: int) -> None:
        known, order = self.known, self.order

        def ask(batches):
            for b in batches:
                for chunk, data, told in zip(*(b.column(i) for i in range(3)), strict=True):
                    chunk = chunk.as_py()
                    c = Chunk([(chunk, 0, 0, data.as_py()), *(tuple(t.values()) for t in told.as_py())], known)
                    for k in range(2, n):
                        c.learn(k, c.grams(k))
                    yield from c.requests(n, chunk)

        def own(batches):
            for _, rows in _groups(batches):
                yield from _own(n, order, rows, known, least)

        asked = self._with_answers(n - 1).mapInArrow(ask, _ROW).select("bucket", "chunk", "data")
        asked = asked.repartition(self.width, "bucket").sortWithinPartitions("bucket", "chunk")
        self.rows[n] = saved(asked.mapInArrow(own, _ROW), f"katz-{n}")
        known.d[n] = discounts(self._stats(n, K + 1))
        known.hot_short[n], known.hot_weight[n] = self._hot_weights(n)
        if n < order:

            def more(batches):
                for b in batches:
                    for blob in b.column(0).to_pylist():
                        h, c = _unpack(blob)
                        yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.uint64).view(np.int64)), pa.array(c)], names=["h", "c"])

            found = self.rows[n].filter("kind = 'next'").select("data").mapInArrow(more, "h long, c long").collect()  # at most HOT rows
            begin = np.array([word_hash(BEGIN)], np.uint64)
            pad = begin
            for _ in range(n - 1):
                pad = _gram(pad, begin)
            known.hot[n + 1], known.hot_count[n + 1] = _sorted_hot([*((r.h, r.c) for r in found), (int(pad.view(np.int64)[0]), known.texts)])

    def _hot_weights(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the hot histories, from the parts that their buckets hold: whether C' is C + 1, and the weight."""
        known, size = self.known, len(self.known.hot[n])

        def add(batches):
            total = np.zeros((K + 1, size), np.int64)
            for b in batches:
                for blob in b.column(0).to_pylist():
                    place, *stats = _unpack(blob)
                    total[:, place] += np.stack([x.astype(np.int64) for x in stats])  # a high plane makes them unsigned
            for j in np.flatnonzero(total.any(0)):
                yield pa.RecordBatch.from_arrays([pa.array([int(j)], pa.int64()), pa.array([total[:, j].tolist()], pa.list_(pa.int64()))], names=["i", "s"])

        parts = self.rows[n].filter("kind = 'hot'").select("data").mapInArrow(add, "i long, s array<long>")
        total = np.zeros((K + 1, size), np.int64)
        for r in parts.groupBy("i").agg(*(F.sum(F.col("s")[i]) for i in range(K + 1))).collect():  # at most HOT + 1 rows
            total[:, r[0]] = r[1:]
        c = known.hot_count[n]
        short = ((total[:K].sum(0) == 0) & (c > 0)).astype(np.int64)
        weight = (_left(known.d[n], total[:K]) + short) / np.maximum(1, c + short) / (1 - total[K] / _FIXED)
        return short, np.where(c > 0, weight, 1.0)

    def score(self) -> DataFrame:
        """One row per text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
        known, order, id_type = self.known, self.order, to_arrow_type(self.id_type)

        def finish(batches):
            for _, rows in _groups(batches):
                c = Chunk(rows, known)
                for n in range(2, order + 1):
                    c.learn(n, c.grams(n))
                ids = next(r[4] for r in rows if r[1] == 0)
                doc = np.repeat(np.arange(len(ids)), c.lengths)
                of = lambda x, doc=doc, ids=ids: np.bincount(doc, weights=x, minlength=len(ids))
                c1 = c.count[1][c.tokens]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, id_type), pa.array(c.held.astype(bool)), pa.array(c.lengths), pa.array(of(c1 > 0).astype(np.int64)), pa.array(np.full(len(ids), known.uni.total, np.int64)), pa.array(of(known.uni.base(c1))), pa.array(of(np.log10(c.probability)))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self._told(order), self.chunks.select("chunk", "level", "bucket", "data", "ids"))
        rows = rows.repartition(self.width, "chunk").sortWithinPartitions("chunk", "level", "bucket")
        return rows.mapInArrow(finish, f"doc_id {self.id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

    def ngrams(self, n: int) -> DataFrame:
        """(history, word, n): hashes and training counts of the n-grams of order n; the lowest 16 bits of a rare word's hash are 0."""
        known = self.known

        def rows(batches):
            for b in batches:
                for blob in b.column(0).to_pylist():
                    h, per, code, rare, c, *_ = _unpack(blob)
                    h = np.cumsum(h.astype(np.uint64), dtype=np.uint64)
                    w = known.hot[2][np.minimum(code, len(known.hot[2]) - 1)] if len(known.hot[2]) else np.zeros(len(code), np.uint64)
                    w[code == _RARE] = rare.astype(np.uint64) << np.uint64(16)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(h, per).view(np.int64)), pa.array(w.view(np.int64)), pa.array(c)], names=["history", "word", "n"])

        return self.rows[n].filter("kind = 'table'").select("data").mapInArrow(rows, "history long, word long, n long")

    def weights(self, n: int) -> DataFrame:
        """(history, weight): back-off weights of the histories of order n that training texts have."""
        known, d = self.known, self.known.d[n]

        def rows(batches):
            for b in batches:
                for blob in b.column(0).to_pylist():
                    h, per, _, _, c, *kinds, lower, hot = _unpack(blob)
                    h = np.cumsum(h.astype(np.uint64), dtype=np.uint64)
                    C = np.bincount(np.repeat(np.arange(len(h)), per), weights=c, minlength=len(h))
                    short = sum(kinds) == 0
                    with np.errstate(all="ignore"):
                        a = (_left(d, kinds) + short) / (C + short) / (1 - lower)
                    a = np.where(hot == 1, known.hot_weight[n][known.place(n, h)[1]] if hot.any() else 0.0, a)
                    keep = C > 0
                    yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(a[keep])], names=["history", "weight"])

        # the parts of a hot history are in several buckets
        return self.rows[n].filter("kind = 'table'").select("data").mapInArrow(rows, "history long, weight double").distinct()

    def drop(self) -> None:
        """Delete the saved tables, when nothing reads them any more."""
        delete(self.chunks.sparkSession, self.path)
        dropped(*self.rows.values())


def train(df: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> Model:
    """A model of order 2 or 3 of the rows of df for which held is false."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    return Model(df, held, id_col, text_col, order)


def score(df: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per row of df: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return train(df, held, id_col, text_col, order).score()
