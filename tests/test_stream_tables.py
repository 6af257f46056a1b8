"""Upserts that survive replays, watched folders, progress of batches, tiers with state variables."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.session import scratch_path
from siltstone.streaming import tiers
from siltstone.streaming.folders import FolderWatch
from siltstone.streaming.progress import Progress
from siltstone.streaming.upserts import KeyedTable

SCHEMA = "k long, at long, v string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_batches_are_applied_once(spark):
    table = KeyedTable(spark, scratch_path(spark, "keyed"), SCHEMA, ["k"], "at", buckets=4)
    df = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert rows(table.read()) == []
    assert table.apply(df((1, 1, "a"), (2, 1, "b"), (1, 2, "c")), 0)
    assert not table.apply(df((1, 9, "replayed"), (5, 9, "replayed")), 0)
    assert rows(table.read()) == [(1, 2, "c"), (2, 1, "b")]
    assert table.apply(df((2, 0, "late"), (3, 1, "d")), 1) and table.apply(df((3, 2, "e")), 0, "another source")
    assert rows(table.read()) == [(1, 2, "c"), (2, 1, "b"), (3, 2, "e")]
    assert table.apply(df(), 2) and rows(table.read()) == [(1, 2, "c"), (2, 1, "b"), (3, 2, "e")]


def test_a_batch_rewrites_the_buckets_that_it_touches(spark):
    table = KeyedTable(spark, scratch_path(spark, "keyed"), SCHEMA, ["k"], "at", buckets=16)
    table.apply(spark.range(100).selectExpr("id AS k", "1L AS at", "'x' AS v"), 0)
    before = table._last()[1]
    table.apply(spark.createDataFrame([(7, 2, "y")], SCHEMA), 1)
    after = table._last()[1]
    assert len(before) > 10 and sum(after[b] != v for b, v in before.items()) == 1
    assert table.read().count() == 100 and table.read().filter("v = 'y'").count() == 1


def test_a_batch_that_failed_is_written_again(spark, monkeypatch):
    table = KeyedTable(spark, scratch_path(spark, "keyed"), SCHEMA, ["k"], "at", buckets=4)
    table.apply(spark.createDataFrame([(1, 1, "a")], SCHEMA), 0)
    # files of the next version without a manifest, as a lost driver leaves them
    spark.createDataFrame([(1, 9, "half", 0)], "k long, at long, v string, bucket int").write.partitionBy("bucket").parquet(f"{table.path}/rows/version=2")
    assert rows(table.read()) == [(1, 1, "a")]
    table.apply(spark.createDataFrame([(1, 2, "b")], SCHEMA), 1)
    assert rows(table.read()) == [(1, 2, "b")]


def test_each_change_of_a_folder_is_reported_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def write(name, text, at):
        (folder / name).write_text(text)
        os.utime(folder / name, (at, at))

    def check():
        watch = FolderWatch(spark, f"file://{folder}", f"file://{tmp_path}/state", ["py", "rs"], max_bytes=100, max_files=1)
        watch.check()
        return sorted((os.path.basename(r.path), r.change) for r in watch.changes().collect())

    write("a.py", "1", 1_000_000)
    write("b.rs", "1", 1_000_000)
    write("c.txt", "no", 1_000_000)
    write("big.py", "x" * 200, 1_000_000)
    first = [("a.py", "added"), ("b.rs", "added")]
    assert check() == first
    assert check() == first
    write("a.py", "2", 2_000_000)
    (folder / "b.rs").unlink()
    write("d.py", "new", 1_500_000)
    second = sorted([*first, ("a.py", "changed"), ("b.rs", "deleted"), ("d.py", "added")])
    assert check() == second
    assert check() == second
    write("b.rs", "back", 1_000_000)
    third = sorted([*second, ("b.rs", "added")])
    assert check() == third
    assert check() == third


def test_progress_adds_up(spark):
    path = scratch_path(spark, "progress")
    spark.range(1000).repartition(10).write.parquet(f"{path}/in")
    with Progress(spark, "adds up", f"{path}/progress", every=3):
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        out = stream.writeStream.queryName("adds up").format("parquet").option("checkpointLocation", f"{path}/state")
        out.option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(Progress.SCHEMA).parquet(f"{path}/progress").filter("rows > 0")
    assert got.agg(F.sum("rows"), F.count_distinct("batch")).first() == (1000, 10)
    assert len(got.inputFiles()) >= 3


@pytest.mark.parametrize("batches", [1, 4])
def test_tiers_read_through(spark, batches):
    """The same finds in one batch and over several, with timers between them."""
    start, minute = datetime(2024, 1, 1), 60
    uses = [(0, "a"), (1, "a"), (2, "b"), (3, "c"), (4, "a"), (5, "c"), (20, "c"), (200, "c"), (201, "a"), (202, "b"), (203, "c")]
    want = ["new", "short", "new", "new", "medium", "short", "medium", "long", "long", "long", "medium"]
    path = scratch_path(spark, "uses")
    all_rows = [(7, i, e, start + timedelta(seconds=minute * m)) for i, (m, e) in enumerate(uses)]
    size = -(-len(all_rows) // batches)
    for b in range(batches):
        part = spark.createDataFrame(all_rows[b * size : (b + 1) * size], "owner long, id long, entry string, ts timestamp")
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", tiers.ROCKS)
    try:
        stream = spark.readStream.schema("owner long, id long, entry string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        out = tiers.read_through(stream, size=2, short_ms=5 * minute * 1000, medium_ms=60 * minute * 1000)
        out.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.schema(out.schema).parquet(f"{path}/out").orderBy("id").collect()
    assert [r.found for r in got] == want
    assert [r.uses for r in got] == list(range(1, len(uses) + 1)) and max(r.short_size for r in got) == 2


def test_owners_share_a_bundle(spark, monkeypatch):
    """A key of the stream is a bundle of owners: each has its own tiers, in one batch and over several, with timers between them."""
    monkeypatch.setattr(tiers, "BUNDLES", 2)
    start, size, short, medium = datetime(2024, 1, 1), 2, 300_000, 3_600_000
    uses, want, seen = [], {}, {}
    for i in range(600):
        owner, entry = (i * 7919 % 23) or None, "abcd"[i * 31 % 97 % 4] if i % 11 else None
        uses.append((owner, i, entry, start + timedelta(seconds=i * i * 37 // 1000)))
        at = int((uses[-1][3] - start).total_seconds() * 1000)
        past = seen.setdefault(owner, [])
        last = max((t for t, e in past if e == entry), default=None)
        between = {e for t, e in past[max((k for k, x in enumerate(past) if x[1] == entry), default=-1) + 1 :]}
        if last is None:
            want[i] = "new"
        else:
            want[i] = "short" if at - last <= short and len(between) < size else "medium" if at - last <= medium else "long"
        past.append((at, entry))
    assert set(want.values()) == {"new", "short", "medium", "long"}
    schema = "owner long, id long, entry string, ts timestamp"
    path = scratch_path(spark, "uses")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", tiers.ROCKS)
    try:
        for b in range(3):
            spark.createDataFrame(uses[b * 200 : (b + 1) * 200], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
            stream = spark.readStream.schema(schema).parquet(f"{path}/in")
            out = tiers.read_through(stream, size, short, medium)
            q = out.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.schema(out.schema).parquet(f"{path}/out").collect()
    assert out.schema["owner"].dataType.typeName() == "long" and {(r.owner, r.id, r.entry) for r in got} == {u[:3] for u in uses}
    assert {r.id: r.found for r in got} == want and max(r.short_size for r in got) == size
    last = {owner: sum(u[0] == owner for u in uses) for owner in seen}
    assert {owner: max(r.uses for r in got if r.owner == owner) for owner in seen} == last
