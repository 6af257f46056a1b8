"""Language identification by the nearest of several centroids per language.

A text is lower-cased, everything but letters becomes one space, and its 1-, 2-
and 3-grams of characters are hashed into DIM places. Vectors are damped counts
times inverse document frequency, of length 1. Per language, spherical k-means
finds a few centroids; a text has the language of the centroid with the largest
cosine. A text is rejected when its cosine is below REJECT times the QUANTILE of
the cosines of the training rows of that language and of about its length.

Document frequencies and those quantiles come from all training rows. The centroids of a
language are fitted, in a task of its own, to at most SAMPLE different texts: those with
the smallest hashes, so copies of a text count once and every label with a text of
letters is learned. What reaches the driver is CENTROIDS vectors of DIM numbers for each
of at most MAX_LANGUAGES labels; with more labels fit() raises.

A row's cosines are computed from that row alone and rounded, so they do not depend on
the rows beside it.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and
is rejected; rows with a null label are not learned from; without any training
row, as of an empty table, all texts are ``und``; of equal cosines the first language by name
wins; very long texts are used whole; repeated rows are each identified; the
result's names replace columns of those names.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import dropped, saved

DIM = 1 << 13
SAMPLE = 600
CENTROIDS = 4
MAX_LANGUAGES = 500
#: Part of the low quantile of a language's and length class's training cosines below which a text is rejected.
REJECT = 0.7
QUANTILE = 0.01
_CELLS = 256  # of the histograms of cosines
UND = "und"
_BINS = 24  # length classes: powers of two of the number of n-grams
_DIGITS = 6  # of cosines
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        table = np.zeros(0x110000, bool)
        for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
            table[lo:hi] = [chr(i).isalpha() for i in range(lo, hi)]
        _letters.append(table)
    return _letters[0]


def features(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams; None if there is no letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of each run of others one stays
    c = np.concatenate(([np.uint32(32)], c[keep], [np.uint32(32)] if letter[-1] else [])).astype(np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[1:] >> np.uint32(7))) * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (one[2:] >> np.uint32(5))) * np.uint32(0xC2B2AE35)
    shift = np.uint32(32 - DIM.bit_length() + 1)
    counts = np.bincount(three >> shift, minlength=DIM)
    counts += np.bincount(two * np.uint32(0x27D4EB2F) >> shift, minlength=DIM)
    return counts + np.bincount(one * np.uint32(0x165667B1) >> shift, minlength=DIM)


def _bin(total: float) -> int:
    return min(_BINS - 1, int(math.log2(max(1.0, total))))


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # the language of each centroid
    centroids: np.ndarray  # a column each
    idf: np.ndarray
    floor: np.ndarray  # least cosine by language and length class

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)

    def predict(self, counts: np.ndarray) -> tuple[int, float]:
        """The number of the language, and the cosine, of one text's counts."""
        at = np.flatnonzero(counts)
        x = np.log1p(counts[at]) * self.idf[at]
        cos = np.round(x @ self.centroids[at] / max(float(np.sqrt(x @ x)), 1e-12), _DIGITS)
        best = int(cos.argmax())
        return int(self.owner[best]), min(1.0, max(0.0, float(cos[best])))

    def rejects(self, language: int, cosine: float, counts: np.ndarray) -> bool:
        return cosine < self.floor[language, _bin(counts.sum())]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    k = min(k, len(x))
    c = x[[int(rng.integers(len(x)))]]
    for _ in range(k - 1):  # k-means++
        d = np.maximum(0.0, 1.0 - (x @ c.T).max(1))
        c = np.vstack([c, x[int(rng.choice(len(x), p=d / d.sum())) if d.sum() > 1e-9 else int(rng.integers(len(x)))]])
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for j in range(k):
            if (own == j).any():
                m = x[own == j].mean(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS, seed: int = 0) -> Model | None:
    """A model of the labelled rows of train; None if no labelled row has a letter."""
    rows = train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    hashes = saved(rows.select("lang", "h").distinct(), "langid-hashes")  # copies of a text are one
    counts = {r.lang: r["count"] for r in hashes.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    if not counts:
        return None
    # about 4 * sample hashes of a language are below its bound: these alone are ranked
    bounds = [(a, min(2**63 - 1, int(4 * sample / n * 2**64) - 2**63)) for a, n in counts.items()]
    bounds = hashes.sparkSession.createDataFrame(bounds, "_lang string, bound long")
    near = hashes.join(F.broadcast(bounds), F.col("lang") == F.col("_lang")).filter("h <= bound")  # MAX_LANGUAGES rows at most
    nth = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    chosen = near.withColumn("nth", nth).filter(F.col("nth") <= sample)
    last = {r.lang: r.last for r in chosen.groupBy("lang").agg(F.max("h").alias("last")).collect()}

    def pick(batches):
        """Document frequencies of a task's rows, and the counts of chosen texts, once for each."""
        df, seen, had = np.zeros(DIM, np.int64), 0, set()

        def row(lang, h, n, x):
            at = np.flatnonzero(x)
            return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([h], pa.int64()), pa.array([n], pa.int64()), pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([x[at].tolist()], pa.list_(pa.int64()))], names=["lang", "h", "n", "at", "k"])

        for b in batches:
            for t, a, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = features(t)
                if x is None:
                    continue
                df += x > 0
                seen += 1
                if h <= last.get(a, -(2**63)) and (a, h) not in had:
                    had.add((a, h))  # at most sample a language
                    yield row(a, h, 0, x)
        if seen:
            yield row(None, None, seen, df)

    found = saved(rows.mapInArrow(pick, "lang string, h long, n long, at array<int>, k array<long>"), "langid-fit")
    tasks = found.filter("lang IS NULL")
    seen = tasks.agg(F.sum("n")).first()[0]
    if not seen:
        return None
    df = np.zeros(DIM)
    pairs = tasks.select(F.explode(F.arrays_zip("at", "k")).alias("x")).groupBy("x.at").agg(F.sum("x.k").alias("k"))
    for r in pairs.collect():  # at most DIM rows
        df[r["at"]] = r["k"]
    model = Model([], np.zeros(0, int), np.zeros((DIM, 0)), np.log((1.0 + seen) / (1.0 + df)) + 1.0, np.zeros((0, _BINS)))

    def learn(table: pa.Table) -> pa.Table:
        """The centroids of one language, from its chosen texts in order of hash."""
        table = table.combine_chunks().sort_by("h")
        lang, seen_h, x = table.column("lang")[0].as_py(), set(), []
        for h, at, k in zip(*(table.column(c).to_pylist() for c in ("h", "at", "k")), strict=True):
            if h not in seen_h:  # several tasks may have sent it
                seen_h.add(h)
                x.append(np.zeros(DIM))
                x[-1][at] = k
        c = _kmeans(model.vectors(np.stack(x)), centroids, np.random.default_rng([seed, zlib.crc32(lang.encode())]))
        return pa.table({"lang": pa.array([lang] * len(c)), "place": pa.array(range(len(c)), pa.int32()), "at": pa.array(c.tolist(), pa.list_(pa.float64()))})

    # copies that several tasks sent go before the group is gathered: a group has at most sample rows
    texts = found.filter("lang IS NOT NULL").dropDuplicates(["lang", "h"]).select("lang", "h", "at", "k")
    learned = texts.groupBy("lang").applyInArrow(learn, "lang string, place int, at array<double>")
    learned = sorted(learned.collect(), key=lambda r: (r.lang, r.place))  # at most CENTROIDS * MAX_LANGUAGES rows
    model.languages = sorted({r.lang for r in learned})
    model.owner = np.array([model.languages.index(r.lang) for r in learned])
    model.centroids = np.array([r["at"] for r in learned]).T.copy()
    model.floor = REJECT * _quantiles(rows.select("text", "lang"), model)
    dropped(found, hashes)
    return model


def _quantiles(rows: DataFrame, model: Model) -> np.ndarray:
    """The QUANTILE of the cosines of rows (text, label) by language and length class."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        m, held = shared.value, {}
        number = {a: j for j, a in enumerate(m.languages)}
        for b in batches:
            for t, a in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = features(t)
                if x is not None and a in number:
                    key = (number[a], _bin(x.sum()), min(_CELLS - 1, int(m.predict(x)[1] * _CELLS)))
                    held[key] = held.get(key, 0) + 1
        if held:
            a, k, c = zip(*held, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(k, pa.int32()), pa.array(c, pa.int32()), pa.array(held.values(), pa.int64())], names=["a", "k", "c", "n"])

    counts = np.zeros((len(model.languages), _BINS, _CELLS), np.int64)
    cells = rows.mapInArrow(measure, "a int, k int, c int, n long").groupBy("a", "k", "c").agg(F.sum("n").alias("n"))
    cells = cells.toArrow()  # at most MAX_LANGUAGES * _BINS * _CELLS rows
    counts[tuple(cells.column(c).to_numpy() for c in ("a", "k", "c"))] = cells.column("n").to_numpy()
    out = np.zeros((len(model.languages), _BINS))
    for a in range(len(out)):
        low = 0.0  # a class without training texts has the quantile of the next shorter one; the shortest have none
        for k in range(_BINS):
            up = counts[a, k].cumsum()
            if up[-1]:
                low = int(np.searchsorted(up, max(1.0, QUANTILE * up[-1]))) / _CELLS
            out[a, k] = low
    return out


def identify(df: DataFrame, model: Model | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """df with lang_pred, score and rejected (after prefix); columns of these names are replaced."""
    names = tuple(prefix + x for x in ("lang_pred", "score", "rejected"))
    keep = [c for c in df.columns if c not in names]
    shared = df.sparkSession.sparkContext.broadcast(model)  # CENTROIDS * MAX_LANGUAGES * DIM numbers at most

    def run(batches):
        m = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                found = [features(t) if m else None for t in part.column(text_col).to_pylist()]
                lang, score, far = [UND] * len(found), [0.0] * len(found), [True] * len(found)
                for j, x in enumerate(found):
                    if x is not None:
                        a, score[j] = m.predict(x)
                        lang[j], far[j] = m.languages[a], bool(m.rejects(a, score[j], x))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(lang), pa.array(score, pa.float64()), pa.array(far)], names=[*keep, *names])

    slim = df.select(*keep)
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    return slim.mapInArrow(run, f"{schema}, {names[0]} string, {names[1]} double, {names[2]} boolean")
