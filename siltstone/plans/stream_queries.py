"""Streams over the events table, replayed to their end; SQL says what the batch gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import stateful, tiers, windows
from ..streaming.progress import Progress
from ..streaming.upserts import KeyedTable

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ended(spark, stream, mode="append"):
    """The rows of a stream that has run to its end, from files in the shared folder."""
    path = scratch_path(spark, "stream")
    windows.to_table(stream, f"{path}/rows", f"{path}/state", mode)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def events(spark, d):
    return windows.replay(spark, d, "events")


def _iso(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# append mode gives a window when the watermark has passed its end: the last one stays open
@query("WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2), m AS (SELECT max(ts) AS m FROM events) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, n, round(total, 4) AS total FROM w, m WHERE s + INTERVAL 1 HOUR <= m - INTERVAL 10 MINUTE")
def stream_tumbling(spark, d):
    out = _ended(spark, windows.tumbling(events(spark, d), "ts", "1 hour", "10 minutes", ["event_type"], "value"))
    return out.select(_iso("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH x AS (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s, value FROM events), m AS (SELECT max(ts) AS m FROM events) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(avg(value), 4) AS mean FROM x, m WHERE s + INTERVAL 12 HOUR <= m - INTERVAL 10 MINUTE GROUP BY s")
def stream_sliding(spark, d):
    out = _ended(spark, windows.sliding(events(spark, d), "ts", "12 hours", "6 hours", "10 minutes", [], "value"))
    return out.select(_iso("start"), "n", F.round("mean", 4).alias("mean"))


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS f FROM events), g AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM o), s AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 4 HOUR AS b, count(*) AS n FROM g GROUP BY user_id, g), m AS (SELECT max(ts) AS m FROM events) SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, n FROM s, m WHERE b <= m - INTERVAL 10 MINUTE")
def stream_sessions(spark, d):
    out = _ended(spark, windows.sessions(events(spark, d), "ts", "4 hours", "10 minutes", ["user_id"]))
    return out.select("user_id", _iso("start"), "n")


@query("SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def stream_unique(spark, d):
    return _ended(spark, windows.unique(events(spark, d), "ts", "60 days", ["user_id", "event_type"])).agg(F.count(F.lit(1)).alias("n"))


@query("WITH o AS (SELECT event_id AS id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS occurrence FROM events) SELECT id, occurrence, CASE WHEN occurrence < 3 THEN 'warn' WHEN occurrence = 3 THEN 'learn' ELSE 'accept' END AS action FROM o")
def stream_learn(spark, d):
    e = events(spark, d).select(F.col("event_type").alias("rule_id"), F.col("user_id").cast("string").alias("path"), "ts", F.col("event_id").alias("id"))
    return _ended(spark, stateful.learn(e)).select("id", "occurrence", "action")


@query("WITH o AS (SELECT user_id, ts, value, first_value(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events) SELECT user_id::VARCHAR AS file, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value, round(f - value, 4) AS drift FROM o WHERE n >= 3 AND f - value > 100")
def stream_ring_alerts(spark, d):
    e = events(spark, d).select(F.col("user_id").cast("string").alias("file"), "ts", "value")
    out = _ended(spark, stateful.ring_alerts(e, 10, 100.0))
    return out.select("file", _iso("ts"), "value", F.round("drift", 4).alias("drift"))


@query("WITH o AS (SELECT user_id::VARCHAR AS path, ts, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS m, lag(CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS BIGINT) END) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) SELECT path, CASE WHEN m IS NULL THEN 'deleted' WHEN p IS NULL THEN 'added' ELSE 'changed' END AS change, count(*) AS n FROM o WHERE (m IS NULL AND p IS NOT NULL) OR (m IS NOT NULL AND p IS NULL) OR m > p GROUP BY ALL")
def stream_watch(spark, d):
    e = events(spark, d).select(F.col("user_id").cast("string").alias("path"), "ts", F.when(F.col("event_type") != "error", F.floor("value")).alias("mtime"))
    return _ended(spark, stateful.watch(e)).groupBy("path", "change").agg(F.count(F.lit(1)).alias("n"))


@query()
def stream_tiers(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("id"), "ts")
    return _ended(spark, stateful.tiers(e)).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def _in_files(spark, d, files=6):
    """The events as a stream of several files in order of time, some at a time."""
    path = scratch_path(spark, "events")
    e = spark.read.parquet(f"{d}/events.parquet")
    e.repartitionByRange(files, "ts", "event_id").sortWithinPartitions("ts", "event_id").write.parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS id, epoch_us(max(ts)) AS us, max_by(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def stream_upserts(spark, d):
    """The newest event of each user and kind, from batches that are all delivered twice."""
    path = scratch_path(spark, "keyed")
    table = KeyedTable(spark, path, "user_id long, event_type string, at struct<ts:timestamp,id:long>, value double", ["user_id", "event_type"], "at")
    e = _in_files(spark, d).select("user_id", "event_type", F.struct("ts", F.col("event_id").alias("id")).alias("at"), "value")
    table.feed(e, f"{path}/first")
    table.feed(e, f"{path}/again")  # another checkpoint: the same batches once more
    return table.read().select("user_id", "event_type", F.col("at.id").alias("id"), F.unix_micros("at.ts").alias("us"), "value")


@query("SELECT count(*) AS rows, 3 AS batches FROM events")
def stream_progress(spark, d):
    """What the listener wrote of a stream's batches adds up to the table."""
    path = scratch_path(spark, "progress")
    with Progress(spark, f"import {path}", f"{path}/progress", every=2):
        out = _in_files(spark, d).select("event_id").writeStream.queryName(f"import {path}").format("parquet")
        out.option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(Progress.SCHEMA).parquet(f"{path}/progress").filter("rows > 0")
    return rows.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).cast("int").alias("batches"))


_SIZE, _SHORT, _MEDIUM = 2, 6 * 3_600_000, 24 * 3_600_000


@query(f"""WITH u AS (SELECT event_id AS id, user_id AS owner, event_type AS entry, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
l AS (SELECT *, lag(t) OVER e AS before, lag(n) OVER e AS last_n FROM u WINDOW e AS (PARTITION BY owner, entry ORDER BY n)),
c AS (SELECT l.*, (SELECT count(DISTINCT o.entry) FROM u o WHERE o.owner = l.owner AND o.n > l.last_n AND o.n < l.n) AS others FROM l)
SELECT owner, id, entry, n AS uses, CASE WHEN before IS NULL THEN 'new' WHEN t - before <= {_SHORT} AND others < {_SIZE} THEN 'short'
  WHEN t - before <= {_MEDIUM} THEN 'medium' ELSE 'long' END AS found FROM c""")
def stream_read_through(spark, d):
    """What each use of an entry finds: the least recently used of a user's entries leave the short tier first."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", tiers.ROCKS)
    try:
        e = events(spark, d).select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), F.col("event_type").alias("entry"), "ts")
        out = _ended(spark, tiers.read_through(e, _SIZE, _SHORT, _MEDIUM))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return out.select("owner", "id", "entry", "uses", "found")
