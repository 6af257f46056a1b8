"""Memory tiers with state variables: a bounded short tier, a medium one with a life time, a long one, and promotion on use."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Entries of an owner's short tier, and milliseconds without a use after which entries leave the short and the medium tier.
SHORT_SIZE, SHORT_MS, MEDIUM_MS = 1000, 300_000, 3_600_000
_NAMES = ("owner", "id", "entry", "found", "uses", "short_size")
#: Owners are dealt into so many bundles, and a bundle is one key of the stream: a key costs calls to the state store and frames of pandas,
#: an owner in a bundle only the states that its uses change. A checkpoint keeps the number that it began with.
BUNDLES = 4096
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NEVER = 1 << 62


class Tiers(StatefulProcessor):
    """For each owner of a bundle `short` has the number of uses and the short tier: (entry, last use), least recently used first and
    of at most size entries; `later` maps the owner's other entries to their last use. `due` is the moment of the bundle's timer, when the oldest
    entry of one of its short tiers has been idle for long enough: the timer moves on all that are. What a use finds is what it reads through:
    short, medium, long or new; it is in the short tier then. States are read when a use needs them and written once for all rows of a call.
    """

    def __init__(self, size: int, short_ms: int, medium_ms: int):
        self.size, self.short_ms, self.medium_ms = size, short_ms, medium_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.short = handle.getMapState("short", "owner string", "uses long, entries array<string>, last array<long>")
        self.later = handle.getMapState("later", "owner string, entry string", "last long")
        self.due = handle.getValueState("due", "at long")

    def _demote(self, ring: dict[str, int], now: int) -> dict[str, int]:
        """What has been idle for short_ms before now, or is too much, is taken from the ring and returned."""
        out: dict[str, int] = {}
        for entry, last in ring.items():
            if now - last <= self.short_ms and len(ring) - len(out) <= self.size:
                break
            out[entry] = last
        for entry in out:
            del ring[entry]
        return out

    def _used(self, owner: str, rows: Iterator[tuple], known: bool) -> Iterator[tuple]:
        """The results of an owner's uses in their order; its states are brought up to date."""
        state = self.short.getValue((owner,)) if known else None
        n, ring = (state[0], dict(zip(state[1], state[2], strict=True))) if state else (0, {})
        had: dict[str, int | None] = {}  # entries of `later` as they are stored
        later: dict[str, int] = {}  # and those outside the ring that are known by now
        for _, us, id_, entry in rows:
            now = us // 1000
            later |= self._demote(ring, now)
            if entry not in ring and entry not in later and entry not in had and state:
                found = self.later.getValue((owner, entry))
                had[entry] = found[0] if found else None
                if found:
                    later[entry] = found[0]
            if entry in ring:
                found = "short"
                del ring[entry]
            elif entry in later:
                found = "medium" if now - later.pop(entry) <= self.medium_ms else "long"
            else:
                found = "new"
            ring[entry] = now
            later |= self._demote(ring, now)
            n += 1
            yield owner, id_, entry, found, n, len(ring)
        for entry, last in later.items():
            if had.get(entry) != last:
                self.later.updateValue((owner, entry), (last,))
        for entry, last in had.items():
            if last is not None and entry not in later:
                self.later.removeKey((owner, entry))
        self._save(owner, n, ring)

    def _save(self, owner: str, n: int, ring: dict[str, int]) -> None:
        self.short.updateValue((owner,), (n, list(ring), list(ring.values())))
        if ring:
            self.next = min(self.next, next(iter(ring.values())) + self.short_ms + 1)

    def _timed(self, due: int | None) -> None:
        """One timer for a bundle, at the moment when the first of its entries is due."""
        if self.next < (due if due is not None else _NEVER):
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(self.next)
            self.due.update((self.next,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = next(iter(self.short.keys()), None) is not None
        due = self.due.get()[0] if known and self.due.exists() else None
        self.next = _NEVER
        # sorting is stable and by one column at a time, as owners and entries can be null
        x = pd.concat(rows).sort_values(["owner", "us", "id"])
        uses = zip(*(x[c].tolist() for c in ("owner", "us", "id", "entry")), strict=True)
        out = [r for owner, own in groupby(uses, itemgetter(0)) for r in self._used(owner, own, known)]
        self._timed(due)
        yield pd.DataFrame({c: pd.Series(v, dtype=object if c in ("owner", "entry", "found") else "int64") for c, v in zip(_NAMES, zip(*out, strict=True), strict=True)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, self.next = int(expiredTimerInfo.getExpiryTimeInMs()), _NEVER
        now = max(now, int(timerValues.getCurrentWatermarkInMs()))  # what became due since then needs no timer of its own
        for (owner,), (n, entries, last) in list(self.short.iterator()):
            ring = dict(zip(entries, last, strict=True))
            out = self._demote(ring, now)
            for entry, at in out.items():
                self.later.updateValue((owner, entry), (at,))
            if out:
                self._save(owner, n, ring)
            elif ring:
                self.next = min(self.next, last[0] + self.short_ms + 1)
        self.due.clear()
        self._timed(None)
        return iter([])

    def close(self) -> None:
        pass


def read_through(uses: DataFrame, size: int = SHORT_SIZE, short_ms: int = SHORT_MS, medium_ms: int = MEDIUM_MS) -> DataFrame:
    """(owner, id, entry, found, uses, short_size) for each use (owner, id, entry, ts) of a stream, in order of ts inside an owner.

    Owners are strings or numbers. Needs a session with the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    owner = uses.schema["owner"].dataType
    rows = uses.withWatermark("ts", "0 seconds").select(
        F.pmod(F.xxhash64("owner"), F.lit(BUNDLES)).alias("bundle"), F.col("owner").cast("string"), "id", "entry", "ts", F.unix_micros("ts").alias("us")
    )
    schema = "owner string, id long, entry string, found string, uses long, short_size int"
    out = rows.groupBy("bundle").transformWithStateInPandas(Tiers(size, short_ms, medium_ms), schema, "Append", "EventTime")
    return out.withColumn("owner", F.col("owner").cast(owner))
