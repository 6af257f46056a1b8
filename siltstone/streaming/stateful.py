"""Stateful streams: occurrence learning, bounded rings with alerts, watched paths, tiers with a life time.

Each is a function of the new rows and the state of one key, or of a bundle of keys, for applyInPandasWithState,
so state is partitioned by key, checkpointed, and bounded per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: A group costs milliseconds of pandas whatever its size: keys with few rows share a group. A batch rewrites the
#: states of the bundles that it meets, so more of them rewrite less. A checkpoint keeps the number that it began with.
BUNDLES = 2048


def learn(violations: DataFrame, at: int = 3) -> DataFrame:
    """(rule_id, path, ts, occurrence, action): the at-th hit of a rule in a path is learned, later ones accepted.

    A group of the stream is a bundle of (rule_id, path); its state is the hits of each so far, as columns.
    """

    def step(bundle: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hits = {(rule, path): n for rule, path, n in zip(*state.get, strict=True)} if state.exists else {}
        rows = pd.concat(batches).sort_values(["ts", "id"])
        occurrence = []
        for k in zip(rows["rule_id"].tolist(), rows["path"].tolist(), strict=True):
            hits[k] = n = hits.get(k, 0) + 1
            occurrence.append(n)
        rows["occurrence"] = occurrence
        rows["action"] = ["warn" if i < at else "learn" if i == at else "accept" for i in occurrence]
        state.update(([k[0] for k in hits], [k[1] for k in hits], list(hits.values())))
        yield rows[["rule_id", "path", "ts", "id", "occurrence", "action"]]

    rows = violations.withColumn("bundle", F.pmod(F.xxhash64("rule_id", "path"), F.lit(BUNDLES)))
    schema = "rule_id string, path string, ts timestamp, id long, occurrence long, action string"
    return rows.groupBy("bundle").applyInPandasWithState(step, schema, "rules array<string>, paths array<string>, hits array<long>", "append", GroupStateTimeout.NoTimeout)


def ring_alerts(snapshots: DataFrame, size: int = 100, fall: float = 0.15, least: int = 3) -> DataFrame:
    """(file, ts, value, drift) of snapshots whose value fell by more than fall from the oldest that the ring still has."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring = list(state.get[0]) if state.exists else []
        out = []
        for r in pd.concat(batches).sort_values("ts").itertuples(index=False):
            ring = [*ring, float(r.value)][-size:]
            drift = ring[0] - ring[-1]
            if len(ring) >= least and drift > fall:
                out.append((r.file, r.ts, float(r.value), drift))
        state.update((ring,))
        if out:
            yield pd.DataFrame(out, columns=["file", "ts", "value", "drift"])

    return snapshots.groupBy("file").applyInPandasWithState(step, "file string, ts timestamp, value double, drift double", "ring array<double>", "append", GroupStateTimeout.NoTimeout)


def watched(listings: DataFrame, extensions: list[str], max_bytes: int) -> DataFrame:
    """The listings (path, size) of files that may be watched: of some extensions, up to a size."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return listings.filter(kind.isin(*extensions) & (F.coalesce("size", F.lit(0)) <= max_bytes))


def watch(listings: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(path, ts, change) of listings (path, ts, mtime, or null when gone): added, changed, deleted.

    With idle_ms a path of which nothing is heard for so long, in event time, is given up (expired), and its state goes.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms"), "expired")], columns=["path", "ts", "change"])
            return
        last = state.get[0] if state.exists else None
        seen = 0
        out = []
        for r in pd.concat(batches).sort_values("ts").itertuples(index=False):
            now, seen = None if pd.isna(r.mtime) else int(r.mtime), int(r.ts.timestamp() * 1000)
            if now is None and last is not None:
                out.append((r.path, r.ts, "deleted"))
            elif now is not None and last is None:
                out.append((r.path, r.ts, "added"))
            elif now is not None and now > last:
                out.append((r.path, r.ts, "changed"))
            last = now
        if last is None:
            state.remove()
        else:
            state.update((last,))
            if idle_ms is not None:
                state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["path", "ts", "change"])

    rows = listings if idle_ms is None else listings.withWatermark("ts", "0 seconds")
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("path").applyInPandasWithState(step, "path string, ts timestamp, change string", "mtime long", "append", timeout)


def tiers(uses: DataFrame, short_ms: int = 300_000, medium_ms: int = 3_600_000) -> DataFrame:
    """(id, ts, event): first uses are stored, in the short tier; entries idle for short_ms of event time move to the
    medium tier, those idle for medium_ms to the long one, which keeps them without state. A use brings an entry back to the short tier."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, tier = state.get
            if tier == 0:
                state.update((last, 1))
                state.setTimeoutTimestamp(max(last + medium_ms, state.getCurrentWatermarkMs() + 1))
            else:
                state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(last, unit="ms"), "medium" if tier == 0 else "long")], columns=["id", "ts", "event"])
            return
        rows = pd.concat(batches).sort_values("ts")
        last = int(rows["ts"].max().timestamp() * 1000)
        new = not state.exists
        state.update((max(last, 0 if new else state.get[0]), 0))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + short_ms)
        yield pd.DataFrame([(key[0], rows["ts"].iloc[0], "stored" if new else "used")], columns=["id", "ts", "event"])

    return uses.withWatermark("ts", "0 seconds").groupBy("id").applyInPandasWithState(step, "id long, ts timestamp, event string", "last long, tier int", "append", GroupStateTimeout.EventTimeTimeout)
