"""One-permutation MinHash fingerprints with optimal densification, in SQL functions alone.

The 64-bit hashes of a text's five-word shingles are sorted once; the high bits of
a hash are its bin and the least hash of a bin is its value. An empty bin takes
the value of the non-empty bin that comes first in a random order of all bins
which belongs to the empty one: the choice depends on nothing but which bins are
empty, as optimal densification asks. The lowest BITS bits of the values, packed
in hexadecimal digits, are the fingerprint. Values agree by chance with
probability r = 2 ** -BITS, so a share m of agreeing bins is read as
(m - r) / (1 - r), from 0 to 1.

Defined cases: null text is empty; a text without words has the empty
fingerprint, whose likeness is 1 to itself and 0 to others; a text of fewer words
than a shingle is one shingle; equal texts have equal fingerprints; rows without an id come
after all others, by a hash of their texts; rows that repeat an id are ordered by text; an empty
table gives an empty result; texts of any length are used whole; extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import partitions

BINS, BITS, WORDS = 256, 8, 5
#: Bins that are tried along an empty bin's order before the earliest non-empty one is computed.
_TRIES = 10
#: Ranges of ids for each shuffle partition, and at most (their ends are literals of the plan).
_RANGES, _MAX_RANGES = 4, 1 << 14
_COARSE = 64


def _let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of the shingles of lower-cased text, repeats included; words are hashed first."""
    hashed = F.transform(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda x: x != ""), lambda x: F.xxhash64(x))

    def each(h: Column) -> Column:
        n = F.size(h)
        full = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(words))))
        return F.when(n >= words, full).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    return _let(hashed, each)


def _probes(bins: int) -> tuple[list[int], list[int], list[int]]:
    """Each bin's start and odd stride, which make an order of all bins, and the stride's inverse."""
    rng = random.Random(bins)
    starts, strides = [rng.randrange(bins) for _ in range(bins)], [rng.randrange(1, bins, 2) for _ in range(bins)]
    return starts, strides, [pow(x, -1, bins) for x in strides]


def fingerprint(hashes: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """The array of low-order bits of all bins; null for no hashes. bins is a power of two from 4."""
    shift, low = 64 - (bins.bit_length() - 1), (1 << bits) - 1
    # every bin gets its largest hash as well, so that the firsts of the bins are one for each bin, in order
    last = [(b << shift) + (1 << shift) - 1 for b in range(-bins // 2, bins // 2)]
    ends = F.array(*(F.lit(x).cast("long") for x in last))
    starts, strides, inverses = (F.array(*(F.lit(x) for x in xs)) for xs in _probes(bins))

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(s, i - 1), shift)))

    def values(f: Column) -> Column:
        return F.transform(f, lambda x, i: F.when(x != F.get(ends, i), x.bitwiseAND(F.lit(low).cast("long")).cast("int")))

    def fill(v: Column) -> Column:
        full = F.filter(F.transform(v, lambda x, i: F.shiftleft(i, bits).bitwiseOR(x)), lambda x: x.isNotNull())

        def filled(full: Column) -> Column:
            def one(x: Column, b: Column) -> Column:
                at = [F.get(v, (F.get(starts, b) + F.get(strides, b) * j).bitwiseAND(bins - 1)) for j in range(_TRIES)]
                turn = lambda y: ((F.shiftright(y, bits) - F.get(starts, b)) * F.get(inverses, b)).bitwiseAND(bins - 1)
                earliest = F.array_min(F.transform(full, lambda y: F.shiftleft(turn(y), bits).bitwiseOR(y.bitwiseAND(low))))
                return F.coalesce(x, *at, earliest.bitwiseAND(low))

            return F.transform(v, one)

        return _let(full, filled)

    dense = _let(F.sort_array(F.concat(hashes, ends)), lambda s: _let(firsts(s), lambda f: _let(values(f), fill)))
    return F.when(F.size(hashes) > 0, dense)


def packed(values: Column, bits: int = BITS) -> Column:
    """Hexadecimal digits of a fingerprint; empty for null."""
    digits = (bits + 3) // 4
    return F.coalesce(F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x), digits, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """The estimated Jaccard likeness of two fingerprints, corrected for values that agree by chance."""
    share = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / F.size(a)
    chance = 2.0**-bits
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), (share - chance) / (1 - chance)))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, own, next_text, next_own): each row with the row after it, by descending id.

    own is the fingerprint. The last row is followed by the first; rows without an
    id come after all others, by descending hash of their texts, and ties are in order of their texts. Ids (and those hashes) are dealt
    in ranges that end at an id, and that id's rows also go, as ghosts, to the next
    range, of which they are the followers: texts move once and no range is large.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    no_id = F.col("doc_id").isNull()
    rows = rows.withColumn("_h", F.when(no_id, F.xxhash64("text")))
    ranges = min(_RANGES * n, _MAX_RANGES)
    cuts = [i / ranges for i in range(1, ranges)]
    kind = docs.schema[id_col].dataType.simpleString()

    def placed(value: Column, ends: list, kind: str) -> tuple[Column, Column]:
        """(number of a value's range, whether the value ends it)."""
        lit = lambda xs: F.array(*(F.lit(x) for x in xs)).cast(f"array<{kind}>")
        below = lambda xs: F.size(F.filter(xs, lambda e: e < value))
        coarse = below(lit(ends[_COARSE - 1 :: _COARSE])) * _COARSE
        at = coarse + below(F.slice(lit(ends), coarse + 1, F.lit(_COARSE)))
        return at, F.get(lit(ends), at) == value

    cuts = [i / ranges for i in range(1, ranges)]
    found = rows.agg(*(F.percentile_approx(c, cuts, 20 * ranges) for c in ("doc_id", "_h"))).first()
    near = [sorted({*(x or [])}) for x in found]
    # percentiles are approximate: the ends are the largest values that there are in each range
    rough = F.when(no_id, placed(F.col("_h"), near[1], "long")[0]).otherwise(placed(F.col("doc_id"), near[0], kind)[0])
    found = rows.groupBy(no_id, rough).agg(F.max("doc_id"), F.max("_h")).collect()  # a row for each range
    ends, null_ends = (sorted({r[i] for r in found} - {None}) for i in (2, 3))
    all_ranges = len(null_ends) + len(ends)
    null_at, null_end = placed(F.col("_h"), null_ends, "long")
    at, end = placed(F.col("doc_id"), ends, kind)
    rows = rows.withColumn("_range", F.when(no_id, null_at).otherwise(at + len(null_ends)))
    follows = F.pmod(F.col("_range") + 1, F.lit(max(1, all_ranges)))
    both = F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("ghost")), F.when(F.when(no_id, null_end).otherwise(end), F.struct(follows.alias("r"), F.lit(1).alias("ghost"))))
    rows = rows.withColumn("_at", F.explode(F.filter(both, lambda x: x.isNotNull())))
    rows = rows.select("doc_id", "text", "_h", F.col("_at.r").alias("_range"), F.col("_at.ghost").alias("_ghost"))
    order = (F.col("_ghost"), F.col("doc_id").desc_nulls_last(), F.col("_h").desc(), F.col("text"))
    rows = rows.repartition(n, "_range").sortWithinPartitions("_range", *order)
    rows = rows.withColumn("own", fingerprint(shingle_hashes(F.col("text"))))
    w = W.partitionBy("_range").orderBy(*order)
    rows = rows.select("doc_id", "text", "own", "_ghost", F.coalesce(F.lead("text").over(w), F.lit("")).alias("next_text"), F.lead("own").over(w).alias("next_own"))
    return rows.filter("_ghost = 0").drop("_ghost")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit: its last third gives way to the next text's beginning."""
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    k = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - k), F.left("next_text", k))
    rows = rows.select("doc_id", "n_chars", edited.alias("edited"), "own", "next_own")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "next_own", fingerprint(shingle_hashes(F.col("edited"))).alias("new"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        packed(F.col("own")).alias("fingerprint"),
        packed(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
