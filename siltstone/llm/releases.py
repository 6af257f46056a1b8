"""Quarantine and cascading release of the turns of conversations.

A turn arrives, may be faulty, and is tried again with growing pauses until it is delivered or dead; it waits
for its parent, an earlier turn of its conversation, and is blocked if the parent is dead or blocked. What
is delivered is released in order of delivery, and each release adds to the conversation's state.

Grouped pandas: turns in order, each turn's attempts and delivery from its parent's through the array of parents; then a
stable sort by delivery and running sums for the releases. Whole conversations are dealt into bundles of about BUNDLE
turns, so that the cost of a group is shared by many short ones; inside a bundle each conversation is replayed by itself.

A conversation of more than BLOCK turns is never gathered. Its turns are numbered over range partitions and
replayed in blocks of BLOCK, each with the HALO turns before it: a turn's fate needs only its ancestors, and
chains of parents end at turns without one. Turns whose chain leaves the halo are replayed with a larger one until none is left.
Releases are numbered in spans of time, and spans get the sums of those before them by prefix sums in levels of FAN.

Defined cases: a null conv_id is a conversation, and in hashes null ids and turns are empty; a null turn comes first;
rows that repeat a turn are turns of their own, in order of the text's checksum; null text is empty; an empty table
gives an empty result; texts of any length are one checksum; the state is kept modulo 2 ** 64; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import partitions, saved

#: Seconds between arrivals, before the first repetition, and attempts before a turn is dead.
EVERY, PAUSE, ATTEMPTS = 7, 20, 4
#: Turns of a conversation that one task replays, turns before them that it gets as well, spans whose sums one task adds up.
BLOCK, HALO, FAN = 8192, 1024, 1024
#: Turns that are replayed in one call.
BUNDLE = 65_536
_POS_BITS = 33  # of monotonically_increasing_id()
STATUS = np.array(["delivered", "dead", "blocked", None], object)
DELIVERED, DEAD, BLOCKED, UNKNOWN = range(4)
#: A conversation: ids are never null inside groups, where pandas would turn whole numbers into others.
KEY = ("no_conv", "conv")
TURN = ("no_turn", "turn")


def facts(turns: DataFrame) -> DataFrame:
    """no_conv, conv, no_turn, turn, crc (of the text), back (turns to the parent, 0: none), faulty, repair (seconds), flaky (bit a: attempt a + 1 fails).

    All that decides a turn's fate comes from the checksums h(k) of k:conv_id:turn.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("conv_id", "turn")))
    h = [F.crc32(F.concat(F.lit(f"{k}:"), name).cast("binary")) for k in range(ATTEMPTS + 3)]
    flaky = sum((F.when(h[a + 3] % 3 == 0, 1 << a).otherwise(0) for a in range(ATTEMPTS)), F.lit(0))
    never_null = lambda c: F.coalesce(F.col(c), F.lit("0").cast(turns.schema[c].dataType))
    return turns.select(
        F.col("conv_id").isNull().alias("no_conv"),
        never_null("conv_id").alias("conv"),
        F.col("turn").isNull().alias("no_turn"),
        never_null("turn").alias("turn"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"),
        (h[0] % 7).alias("back"),
        (h[1] % 101 < 20).alias("faulty"),
        (h[2] % 101).alias("repair"),
        flaky.cast("int").alias("flaky"),
    )


def replay(place: list[int], back: list[int], faulty: list[bool], repair: list[int], flaky: list[int]) -> tuple[list, list, list, list]:
    """status, attempts, first and last second of turns in order; place: their numbers in their conversation, one after the other.

    The status is UNKNOWN where the chain of parents leaves the list before it ends.
    """
    status, attempts, first, last = [], [], [], []
    for i, p in enumerate(place):
        begin, fate, a, t = EVERY * p, DELIVERED, 1, 0
        if 0 < back[i] <= p:
            j = i - back[i]
            fate = UNKNOWN if j < 0 else status[j]
            if fate == DELIVERED:
                begin = max(begin, last[j])
            elif fate == DEAD:
                fate = BLOCKED
        if fate == DELIVERED:
            t, good = begin, EVERY * p + repair[i]
            while faulty[i] and (t < good or flaky[i] >> (a - 1) & 1):
                if a == ATTEMPTS:
                    fate = DEAD
                    break
                t, a = t + PAUSE * 2 ** (a - 1), a + 1
        else:
            begin = a = 0
        status.append(fate)
        attempts.append(a)
        first.append(begin)
        last.append(t)
    return status, attempts, first, last


def released(of: np.ndarray, last: np.ndarray, crc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows in order of turn, of conversations `of`: numbers from 1 in order of last, ties as they come, and running sums of number * crc and of crc, modulo 2 ** 64."""
    order = np.lexsort((last, of))
    begins = np.flatnonzero(np.diff(of[order], prepend=-1)) if len(of) else np.empty(0, int)
    lengths = np.diff(np.append(begins, len(of)))
    number, state, plain = (np.empty(len(of), np.int64) for _ in range(3))
    number[order] = np.arange(1, len(of) + 1) - np.repeat(begins, lengths)
    with np.errstate(over="ignore"):
        for out, x in ((state, number[order] * crc[order]), (plain, crc[order])):
            sums = np.cumsum(x)
            out[order] = sums - np.repeat(sums[begins] - x[begins], lengths)
    return number, state, plain


def _replayed(pdf: pd.DataFrame, place: np.ndarray) -> pd.DataFrame:
    out = replay(place.tolist(), *(pdf[c].tolist() for c in ("back", "faulty", "repair", "flaky")))
    return pdf.assign(**dict(zip(("status", "attempts", "first_at", "last_at"), map(np.array, out), strict=True)))


def _bundle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Conversations of at most BLOCK turns each."""
    of = pdf.groupby(list(KEY), sort=False).ngroup().to_numpy()
    order = np.lexsort((pdf["crc"], pdf["turn"], ~pdf["no_turn"], of))
    pdf, of = pdf.iloc[order].reset_index(drop=True), of[order]
    begins = np.flatnonzero(np.diff(of, prepend=-1))
    pdf = _replayed(pdf, np.arange(len(of)) - np.repeat(begins, np.diff(np.append(begins, len(of)))))
    good = (pdf["status"] == DELIVERED).to_numpy()
    number, state, _ = released(of[good], pdf["last_at"].to_numpy()[good], pdf["crc"].to_numpy()[good])
    for name, values in (("release_no", number), ("state", state)):
        column = pd.array(np.zeros(len(pdf), np.int64), dtype="Int64")
        column[good], column[~good] = values, pd.NA
        pdf[name] = column
    return pdf.assign(status=STATUS[pdf["status"].to_numpy()])[[*KEY, *TURN, *(n for n, _ in _OUT)]]


def _fields(df: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*(df.schema[c] for c in (*KEY, *TURN)), *(T.StructField(n, t) for n, t in more)])


_L = T.LongType()
_OUT = (("status", T.StringType()), ("attempts", T.IntegerType()), ("first_at", _L), ("last_at", _L), ("release_no", _L), ("state", _L))
_FATE = _OUT[:4]


def numbered(rows: DataFrame) -> DataFrame:
    """rows with p, their place in their conversation, from 0: over range partitions, none of which a conversation fills alone."""
    n = partitions(rows.sparkSession)
    order = (*KEY, F.col("no_turn").desc(), "turn", "crc")
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = placed.select(*rows.columns, F.shiftrightunsigned("_id", _POS_BITS).alias("_pid"), F.col("_id").bitwiseAND(F.lit((1 << _POS_BITS) - 1)).alias("_pos"))
    placed = saved(placed, "placed")
    runs = placed.groupBy("_pid", *KEY).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))  # a row per partition for a long conversation
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*KEY).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = saved(runs.select("_pid", *KEY, (before - F.col("_first")).alias("_shift")), "runs")
    return placed.join(runs, ["_pid", *KEY]).select(*rows.columns, (F.col("_pos") + F.col("_shift")).alias("p"))


def _blocks(rows: DataFrame, block: int, halo: int) -> DataFrame:
    """One row for each row and block that needs it: its own, and those that begin within halo turns after it."""
    own = F.floor(F.col("p") / block)
    return rows.withColumn("block", F.explode(F.sequence(own, F.floor((F.col("p") + halo) / block))))


def fates(rows: DataFrame, block: int, halo: int) -> DataFrame:
    """KEY, TURN, p, crc and what replay() gives, for numbered rows of long conversations."""
    schema = _fields(rows, ("p", _L), ("crc", _L), ("status", T.IntegerType()), *_FATE[1:], ("block", _L))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p", ignore_index=True)
        pdf = _replayed(pdf, pdf["p"].to_numpy())
        return pdf[pdf["p"] // block == pdf["block"]][schema.names]

    out, todo, size = None, _blocks(rows, block, halo), halo
    while True:
        got = saved(todo.groupBy(*KEY, "block").applyInPandas(run, schema), "fates")
        again = got.filter(F.col("status") == UNKNOWN).select(*KEY, "block").distinct()
        done = got.join(again, [*KEY, "block"], "left_anti")
        out = done if out is None else out.unionByName(done)
        if again.isEmpty():
            return out.drop("block")
        size = max(1, size) * 8  # at last the whole conversation before the block
        todo = _blocks(rows, block, size).join(again, [*KEY, "block"], "left_semi")


def _wrapped(x: Column) -> Column:
    """A decimal modulo 2 ** 64, as a long."""
    two = lambda n: F.lit(str(1 << n)).cast("decimal(38,0)")
    x = F.pmod(x.cast("decimal(38,0)"), two(64))
    return F.when(x >= two(63), x - two(64)).otherwise(x).cast("long")


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def sums_before(spans: DataFrame) -> DataFrame:
    """spans (KEY, i, n, plain, state) with the same of all earlier spans of the conversation: n0, plain0, state0.

    A span adds n rows; its state is what its rows add if they are numbered from 1, and earlier rows add
    plain to it each. At most FAN spans are added up in one place, then runs of FAN spans in the same way.
    """
    spans = spans.withColumn("_run", F.floor(F.col("i") / FAN))
    over = W.partitionBy(*KEY, "_run").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(over), F.lit(0))
    spans = spans.withColumn("n0", before(F.col("n")))
    term = _wide("state") + _wide("n0") * _wide("plain")
    spans = spans.withColumn("_term", _wrapped(term)).withColumn("plain0", _wrapped(before(_wide("plain")))).withColumn("state0", _wrapped(before(_wide("_term"))))
    spans = saved(spans, "spans")
    if (spans.agg(F.max("i")).first()[0] or 0) < FAN:
        return spans.drop("_run", "_term")
    runs = spans.groupBy(*KEY, F.col("_run").alias("i")).agg(F.sum("n").alias("n"), _wrapped(F.sum(_wide("plain"))).alias("plain"), _wrapped(F.sum(_wide("_term"))).alias("state"))
    runs = sums_before(runs).select(*KEY, F.col("i").alias("_run"), F.col("n0").alias("_n0"), F.col("plain0").alias("_plain0"), F.col("state0").alias("_state0"))
    rows = spans.join(runs, [*KEY, "_run"])
    state0 = _wrapped(_wide("_state0") + _wide("state0") + _wide("_n0") * _wide("plain0"))
    return rows.select(*KEY, "i", "n", "plain", "state", (F.col("n0") + F.col("_n0")).alias("n0"), _wrapped(_wide("plain0") + _wide("_plain0")).alias("plain0"), state0.alias("state0"))


def releases(fated: DataFrame, block: int) -> DataFrame:
    """The releases of long conversations: what is delivered, by spans of time in which about block turns arrive."""
    good = fated.filter(F.col("status") == DELIVERED).withColumn("i", F.floor(F.col("last_at") / (EVERY * block)))
    names = [*KEY, *TURN, "status", *(n for n, _ in _FATE[1:]), "i", "number", "own", "crcs"]
    schema = _fields(fated, ("status", T.IntegerType()), *_FATE[1:], ("i", _L), ("number", _L), ("own", _L), ("crcs", _L))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p", ignore_index=True)
        number, own, crcs = released(np.zeros(len(pdf), int), pdf["last_at"].to_numpy(), pdf["crc"].to_numpy())
        return pdf.assign(number=number, own=own, crcs=crcs)[names]

    local = saved(good.groupBy(*KEY, "i").applyInPandas(run, schema), "released")
    spans = local.groupBy(*KEY, "i").agg(F.count(F.lit(1)).alias("n"), F.max_by("crcs", "number").alias("plain"), F.max_by("own", "number").alias("state"))
    rows = local.join(sums_before(spans).select(*KEY, "i", "n0", "state0"), [*KEY, "i"])
    state = _wrapped(_wide("state0") + _wide("own") + _wide("n0") * _wide("crcs"))
    return rows.select(*KEY, *TURN, "status", "attempts", "first_at", "last_at", (F.col("n0") + F.col("number")).alias("release_no"), state.alias("state"))


def in_blocks(rows: DataFrame, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """The result for facts() of conversations of any length."""
    fated = fates(saved(numbered(rows), "numbered"), block, halo)
    rest = fated.filter(F.col("status") != DELIVERED).select(*KEY, *TURN, *(n for n, _ in _FATE), *(F.lit(None).cast("long").alias(c) for c in ("release_no", "state")))
    out = releases(fated, block).unionByName(rest)
    return out.withColumn("status", F.element_at(F.array(*map(F.lit, STATUS[:3])), F.col("status") + 1))


def quarantine(turns: DataFrame, block: int = BLOCK, halo: int = HALO, salts: int = 64) -> DataFrame:
    """conv_id, turn, status, attempts, first_at, last_at, release_no, state: one row per row of turns.

    block: the most turns of a conversation that are replayed in one call.
    """
    rows = facts(turns)
    bundles = max(partitions(turns.sparkSession), -(-turns.count() // BUNDLE))
    bundle = F.pmod(F.xxhash64(*KEY), F.lit(bundles)).alias("bundle")
    whole = lambda some: some.groupBy(bundle).applyInPandas(_bundle, _fields(rows, *_OUT))
    long = saved(rows.groupBy(*KEY).count().filter(F.col("count") > block).select(*KEY), "long")
    if long.isEmpty():
        out = whole(rows)
    else:
        # rows meet the long ones by id and salt, so that a conversation with very many turns is dealt over the tasks
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("turn", "crc"), F.lit(salts)))
        long = long.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
        short, many = (salted.join(long, [*KEY, "_salt"], how).select(*rows.columns) for how in ("left_anti", "left_semi"))
        out = whole(short).unionByName(in_blocks(many, block, halo))
    tried = F.col("attempts") > 0
    ids = (F.when(~F.col(f"no_{c}"), F.col(c)).alias(n) for c, n in (("conv", "conv_id"), ("turn", "turn")))
    return out.select(*ids, "status", "attempts", *(F.when(tried, F.col(c)).alias(c) for c in ("first_at", "last_at")), "release_no", "state")


def _crc(text: str) -> str:
    """CRC-32 of a string in DuckDB, by the table of bytes in crcs."""
    digits = f"hex(encode({text}))"
    numbers = f"list_transform(range(len({digits}) // 2), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {numbers}), lambda c, b: xor(c >> 8, bytes[(xor(c, b) & 255) + 1])), 4294967295)"


_H = [_crc(f"'{k}:' || coalesce(conv_id::VARCHAR, '') || ':' || coalesce(turn::VARCHAR, '')") for k in range(ATTEMPTS + 3)]
_AT = [0, 20, 60, 140]
_WORKS = "\n          ".join(f"WHEN NOT faulty OR (begin + {t} >= good AND flaky[{a}] <> 0) THEN {a}" for a, t in enumerate(_AT, 1))
_TRY = f"CASE {_WORKS} ELSE 5 END"
#: The same rows in DuckDB.
ORACLE = f"""
WITH RECURSIVE crcs AS (SELECT list(list_reduce(list_prepend(range, range(8)), lambda v, _: xor(v >> 1, (v & 1) * 3988292384)) ORDER BY range) AS bytes FROM range(256)),
c AS (SELECT conv_id, turn, {_crc("coalesce(text, '')")} AS crc, {_H[0]} % 7 AS d, {_H[1]} % 101 < 20 AS faulty, {_H[2]} % 101 AS repair,
        [{", ".join(f"{h} % 3" for h in _H[3:])}] AS flaky FROM conversations, crcs),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, crc) - 1 AS p FROM c),
r AS (SELECT *, {EVERY} * p AS arrival, {EVERY} * p + repair AS good, CASE WHEN d > 0 AND d <= p THEN p - d END AS parent FROM n),
f AS (SELECT *, arrival AS begin, {_TRY.replace("begin", "arrival")} AS k FROM r WHERE parent IS NULL
  UNION ALL
  SELECT *, {_TRY} AS k FROM (SELECT r.*, CASE WHEN f.k < 5 THEN greatest(r.arrival, f.begin + {_AT}[f.k]) END AS begin
    FROM r JOIN f ON r.parent = f.p AND r.conv_id IS NOT DISTINCT FROM f.conv_id) WHERE begin IS NOT NULL),
g AS (SELECT *, begin + {_AT}[least(k, 4)] AS last_at FROM f),
s AS (SELECT conv_id, p, crc, row_number() OVER (PARTITION BY conv_id ORDER BY last_at, p) AS release_no FROM g WHERE k < 5),
x AS (SELECT *, sum(release_no * crc) OVER (PARTITION BY conv_id ORDER BY release_no) AS state FROM s)
SELECT r.conv_id, r.turn, CASE WHEN k IS NULL THEN 'blocked' WHEN k < 5 THEN 'delivered' ELSE 'dead' END AS status,
  CAST(CASE WHEN k IS NULL THEN 0 ELSE least(k, 4) END AS INTEGER) AS attempts, begin AS first_at, last_at, release_no, CAST(state AS BIGINT) AS state
FROM r LEFT JOIN g ON g.p = r.p AND g.conv_id IS NOT DISTINCT FROM r.conv_id
LEFT JOIN x ON x.p = r.p AND x.conv_id IS NOT DISTINCT FROM r.conv_id
"""
