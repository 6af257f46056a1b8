"""Queries of snapshots, drift, decisions, compliance, memory and certificates over events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import certify, code, drift, insight, rules, state
from ..sources import files
from ..sources.tables import merged_rules, table
from .pack import PROSE, findings_sql, totals_sql

QUERIES, SQL = {}, {}
AS_OF = "2024-01-31 00:00:00"
METRICS = list(drift.WEIGHTS)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def snapshots(spark, d):
    """A snapshot per user and week: shares of kinds of events, and their number."""
    e = table(spark, d, "events")
    share = lambda t: F.avg((F.col("event_type") == t).cast("double"))
    rows = e.groupBy(F.col("user_id").alias("file_path"), F.date_trunc("week", "ts").alias("ts")).agg(share("purchase").alias("type_strictness"), share("click").alias("naming_consistency"), (1 - share("error")).alias("error_handling"), F.least(F.lit(1.0), F.count(F.lit(1)) / 50).alias("complexity"), share("view").alias("dead_code"))
    return rows


def _sh(t):
    return f"avg((event_type = '{t}')::INT::DOUBLE)"


_SNAP = f"WITH n AS (SELECT user_id AS file_path, date_trunc('week', ts)::TIMESTAMP AS ts, {_sh('purchase')} AS type_strictness, {_sh('click')} AS naming_consistency, 1 - {_sh('error')} AS error_handling, least(1, count(*) / 50) AS complexity, {_sh('view')} AS dead_code FROM events GROUP BY 1, 2)"
_TREND = _SNAP + ", u AS (" + " UNION ALL ".join(f"SELECT file_path, ts, '{m}' AS metric, {m} AS value FROM n" for m in METRICS) + f"), t0 AS (SELECT file_path, metric, arg_min(value, ts) AS first, arg_max(value, ts) AS last, count(*) AS n FROM u GROUP BY 1, 2), t AS (SELECT *, last - first AS delta, CASE WHEN abs(last - first) < 0.02 THEN 'stable' WHEN (last - first) * (CASE WHEN metric IN ('complexity', 'dead_code') THEN -1 ELSE 1 END) > 0 THEN 'improving' ELSE 'declining' END AS direction, CASE WHEN abs(last - first) > 0.1 THEN 'high' WHEN abs(last - first) > 0.05 THEN 'medium' ELSE 'low' END AS severity FROM t0)"
_W = "CASE metric " + " ".join(f"WHEN '{m}' THEN {w}::DOUBLE" for m, w in drift.WEIGHTS.items()) + " END"
_SCORE = _TREND + f", s AS (SELECT file_path, least(1, sum(CASE WHEN direction = 'declining' THEN abs(delta) * {_W} * CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1.5 ELSE 1 END ELSE 0 END)::DOUBLE) AS score, max(n) AS snapshots FROM t GROUP BY file_path)"


@query(f"{_TREND} SELECT file_path, metric, round(first, 6) AS first, round(last, 6) AS last, round(delta, 6) AS delta, n, direction, severity FROM t")
def snapshot_trend(spark, d):
    t = drift.trends(snapshots(spark, d), ["file_path"])
    return t.select("file_path", "metric", *(F.round(c, 6).alias(c) for c in ("first", "last", "delta")), "n", "direction", "severity")


@query(f"{_SCORE} SELECT file_path, round(score, 6) AS score, snapshots FROM s")
def drift_score(spark, d):
    return drift.drift_score(drift.trends(snapshots(spark, d), ["file_path"]), ["file_path"]).withColumn("score", F.round("score", 6))


@query(f"{_SCORE} SELECT file_path, CASE WHEN score >= 0.3 THEN 'critical' ELSE 'warning' END AS level, snapshots FROM s WHERE score >= 0.15 AND snapshots >= 3")
def drift_alerts(spark, d):
    s = drift.drift_score(drift.trends(snapshots(spark, d), ["file_path"]), ["file_path"])
    return drift.alerts(s).select("file_path", "level", "snapshots")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 100")
def ring_100(spark, d):
    return drift.last_n(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], 100).select("user_id", "event_id")


@query(f"SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS AND ts <= TIMESTAMP '{AS_OF}' GROUP BY 1")
def look_back(spark, d):
    return drift.look_back(table(spark, d, "events"), as_of(), 7).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS age FROM events) SELECT user_id, round(sum(0.9::DOUBLE ** age * 0.1::DOUBLE * value), 6) AS ema FROM r GROUP BY user_id")
def ema_rate(spark, d):
    return drift.ema(table(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("id"), "value"), ["user_id"], "value").withColumn("ema", F.round("ema", 6))


_FEAT = "SELECT page_id, 1 + len(regexp_extract_all(html, '\\b(if|for|while|case|catch|except|elif|match)\\b')) + len(regexp_extract_all(html, '&&|\\|\\||\\?')) AS cyclomatic, len(string_split(html, '<div')) - 1 AS nesting, len(string_split(html, 'href')) - 1 AS unwraps FROM pages"


@query(f"WITH f AS ({_FEAT}) SELECT page_id, 'cyclomatic' AS kind, 3 AS severity, cyclomatic AS value FROM f WHERE cyclomatic > 15 UNION ALL SELECT page_id, 'nesting', 2, nesting FROM f WHERE nesting > 4 UNION ALL SELECT page_id, 'unwraps', 4, unwraps FROM f WHERE unwraps > 5")
def anomalies(spark, d):
    pages = table(spark, d, "pages")
    f = code.features(pages.select("page_id", "html"), ["page_id"], "html").drop("unwraps")
    n = lambda s: F.size(F.split("html", s)) - 1
    return drift.anomalies(f.join(pages.select("page_id", n("<div").alias("nesting"), n("href").alias("unwraps")), "page_id"), ["page_id"])


_OLD, _NEW = "ts < TIMESTAMP '2024-01-16'", "ts >= TIMESTAMP '2024-01-16'"


def _half(spark, d, sql):
    return table(spark, d, "events").filter(sql)


@query(f"WITH o AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE {_OLD} GROUP BY ALL), n AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE {_NEW} GROUP BY ALL) SELECT user_id, event_type, CASE WHEN o.n IS NULL THEN 'added' WHEN n.n IS NULL THEN 'removed' WHEN o.n <> n.n THEN 'modified' ELSE 'unchanged' END AS change FROM o FULL JOIN n USING (user_id, event_type)")
def file_delta(spark, d):
    half = lambda w: _half(spark, d, w).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("hash")).withColumn("path", F.struct("user_id", "event_type"))
    return state.file_delta(half(_OLD), half(_NEW)).select("path.user_id", "path.event_type", "change")


@query(f"WITH o AS (SELECT DISTINCT user_id, event_type, CAST(floor(value / 20) AS BIGINT) AS line FROM events WHERE {_OLD}), n AS (SELECT DISTINCT user_id, event_type, CAST(floor(value / 20) AS BIGINT) AS line FROM events WHERE {_NEW}) SELECT user_id, event_type, line, CASE WHEN o.x IS NULL THEN 'new' WHEN n.x IS NULL THEN 'fixed' ELSE 'persistent' END AS status FROM (SELECT *, 1 AS x FROM o) o FULL JOIN (SELECT *, 1 AS x FROM n) n USING (user_id, event_type, line)")
def violation_delta(spark, d):
    keyed = lambda w: _half(spark, d, w).withColumn("line", F.floor(F.col("value") / 20))
    return state.violation_delta(keyed(_OLD), keyed(_NEW), ["user_id", "event_type", "line"])


@query(f"SELECT e.event_id, coalesce(a.ok, false) AS accepted FROM events e LEFT JOIN (SELECT DISTINCT user_id, event_type, true AS ok FROM events WHERE event_type = 'error' AND value > 100 AND ts + INTERVAL 90 DAYS > TIMESTAMP '2024-04-15') a USING (user_id, event_type)")
def accepted_violations(spark, d):
    e = table(spark, d, "events")
    acc = e.filter("event_type = 'error' AND value > 100").select("user_id", "event_type", (F.col("ts") + F.expr("INTERVAL 90 DAYS")).alias("expires_at"))
    return state.accepted(e, acc, ["user_id", "event_type"], F.lit("2024-04-15").cast("timestamp")).select("event_id", "accepted")


RULE_OF = {"error": "SEC001", "signup": "LOGIC001", "click": "STYLE001", "view": "STYLE002", "purchase": "DOC001"}
_RULE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RULE_OF.items()) + " END"


def violations(spark, d):
    e = table(spark, d, "events")
    rule = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in RULE_OF.items()))
    return e.select(F.col("event_id").alias("id"), rule.alias("rule_id"), F.col("event_type").alias("domain"), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"), F.lit("/f"), F.col("user_id").cast("string")).alias("path"), "ts", (F.col("value") / 500).alias("confidence"))


_VIOL = f"WITH v AS (SELECT event_id AS id, {_RULE} AS rule_id, 'u' || (user_id % 10) || '/f' || user_id AS path, ts, value / 500 AS confidence FROM events), x AS (SELECT *, CASE WHEN rule_id = 'DOC001' AND path LIKE 'u3/%' THEN 'e1' WHEN rule_id = 'STYLE001' AND path = 'u1/f1' THEN 'e2' WHEN rule_id = 'STYLE002' AND regexp_matches(path, '^u[^/]*/f7[^/]*$') THEN 'e3' WHEN rule_id = 'LOGIC001' THEN 'e4' END AS exemption FROM v)"


def exempted(spark, d):
    ex = spark.createDataFrame([("e1", "DOC001", "dir", "u3", 1), ("e2", "STYLE001", "file", "u1/f1", 2), ("e3", "STYLE002", "glob", "u*/f7*", 3), ("e4", "LOGIC001", "project", "", 4), ("e5", "DOC001", "dir", "u3", 5)], "id string, rule_id string, scope_kind string, scope_value string, ordinal int")
    return state.exempted(violations(spark, d), ex)


@query(f"{_VIOL} SELECT id, rule_id, exemption FROM x")
def exemptions(spark, d):
    return exempted(spark, d).select("id", "rule_id", "exemption")


@query(f"{_VIOL}, o AS (SELECT *, row_number() OVER (PARTITION BY rule_id, path ORDER BY ts, id) AS occurrence, CASE rule_id WHEN 'SEC001' THEN 'inviolable' WHEN 'LOGIC001' THEN 'strict' ELSE 'flexible' END AS tier FROM x) SELECT id, tier, CAST(occurrence AS INT) AS occurrence, CASE WHEN tier = 'inviolable' THEN 'block' WHEN exemption IS NOT NULL THEN 'accept' WHEN tier = 'flexible' AND occurrence = 3 THEN 'learn' WHEN tier = 'flexible' AND occurrence > 3 THEN 'accept' WHEN confidence < 0.6 THEN 'ask' ELSE 'warn' END AS action FROM o")
def compliance_eval(spark, d):
    return state.compliance(exempted(spark, d)).select("id", "tier", "occurrence", "action")


@query("WITH v AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'accept' ELSE 'reject' END AS verdict FROM events), g AS (SELECT user_id, count_if(verdict = 'accept') AS accepts, count_if(verdict <> 'accept') AS rejects, arg_max(verdict, (ts, event_id)) AS last_verdict FROM v GROUP BY user_id) SELECT *, round(CASE WHEN last_verdict = 'accept' THEN 0.3 * accepts / (accepts + rejects) ELSE -0.3 * rejects / (accepts + rejects) END, 6) AS adjustment, greatest(accepts, rejects) >= 5 AS permanent FROM g")
def feedback_adjust(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("id"), F.when(F.col("event_type").isin("click", "view", "purchase"), "accept").otherwise("reject").alias("verdict"))
    return state.feedback(e, ["user_id"]).withColumn("adjustment", F.round("adjustment", 6))


@query("SELECT event_id, round(least(greatest(0.5 + CASE WHEN event_type = 'click' THEN 0.2 ELSE 0 END - CASE WHEN value > 100 THEN 0.3 ELSE 0 END, 0), 1), 6) AS confidence, CASE WHEN value > 100 OR event_type <> 'click' THEN 'ask' ELSE 'warn' END AS level FROM events")
def confidence_levels(spark, d):
    c = state.confidence(F.lit(0.5), [F.when(F.col("event_type") == "click", 0.2).otherwise(0.0)], [F.when(F.col("value") > 100, 0.3).otherwise(0.0)])
    return table(spark, d, "events").select("event_id", F.round(c, 6).alias("confidence"), state.level(c).alias("level"))


@query(f"SELECT event_id, epoch(date_trunc('second', TIMESTAMP '2024-01-30 23:59:59')) - epoch(date_trunc('second', ts)) AS age_s, CASE WHEN epoch(TIMESTAMP '2024-01-30 23:59:59') - epoch(date_trunc('second', ts)) <= 300 THEN 'short' WHEN epoch(TIMESTAMP '2024-01-30 23:59:59') - epoch(date_trunc('second', ts)) <= 3600 THEN 'medium' ELSE 'long' END AS tier FROM events")
def memory_tiers(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").alias("created_at"), F.lit(None).cast("timestamp").alias("last_used"))
    return state.memory_tiers(e, F.lit("2024-01-30 23:59:59").cast("timestamp")).select("event_id", "age_s", "tier")


@query("SELECT event_id FROM events WHERE date_diff('day', ts::DATE, DATE '2024-02-20') < 30 OR value > 150 OR event_type = 'purchase'")
def memory_prune(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").alias("created_at"), (F.col("value") / 25).alias("recall_count"), (F.col("event_type") == "purchase").alias("helpful"))
    return state.pruned(e, F.lit("2024-02-20").cast("timestamp"), 30, 6).select("event_id")


@query("SELECT user_id, event_type, max(ts)::VARCHAR[:19] AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type".replace("max(ts)::VARCHAR[:19]", "strftime(max(ts), '%Y-%m-%d %H:%M:%S')"))
def state_upsert(spark, d):
    cols = ["user_id", "event_type", "ts", "event_id", "value"]
    both = [table(spark, d, "events").filter(w).select(*cols) for w in (_OLD, _NEW)]
    return state.upserted(both[0], both[1], ["user_id", "event_type"], "ts").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "value")


@query(f"WITH a AS (SELECT conv_id, turn, date_diff('day', DATE '2024-01-01', DATE '2024-02-01') + turn AS age, len(text) % 10 / 10 AS rel FROM conversations) SELECT conv_id, turn, round(least(greatest(0.4 * rel + 0.3 * 0.5::DOUBLE ** (age / 30) + 0.3 * 0.5, 0), 1), 6) AS score FROM a")
def decision_ranked(spark, d):
    c = table(spark, d, "conversations")
    s = scores.multi_signal((F.length("text") % 10) / 10, F.col("turn") + 31, F.lit(0.5))
    return c.select("conv_id", "turn", F.round(s, 6).alias("score"))


_PIECE = "('0x' || substr(d, {}, 12))::BIGINT"
_AUDIT = f"""WITH o AS (SELECT conv_id, turn, sha256(conv_id::VARCHAR || '/' || turn || ':' || turn || ':' || role || ':' || coalesce(text, '')) AS own_hash FROM conversations),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS seq FROM o),
d AS (SELECT *, sha256(seq || ':' || own_hash) AS d FROM n),
w AS (SELECT *, sha256(concat_ws(':', seq, {", ".join(f"sum({_PIECE.format(12 * n + 1)}) OVER u" for n in range(4))})) AS link FROM d WINDOW u AS (PARTITION BY conv_id ORDER BY seq))"""


@query(f"{_AUDIT} SELECT conv_id, seq, own_hash, coalesce(lag(link) OVER (PARTITION BY conv_id ORDER BY seq), '') AS prev_hash, link FROM w")
def audit_trail(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("id"), F.col("turn").alias("ts"), F.col("role").alias("action"), F.col("text").alias("subject"))
    return certify.audit_chain(c, "conv_id").select("conv_id", "seq", "own_hash", "prev_hash", "link")


_CERT = f"{findings_sql(PROSE, 'documents', 'doc_id', 'text')}, s AS ({totals_sql('doc_id')})"


def certificates(spark, d):
    docs = table(spark, d, "documents")
    v = rules.verdicts(docs, rules.findings(docs, PROSE, ["doc_id"]), ["doc_id"])
    v = v.select("doc_id", "passed", (F.col("n_critical") + F.col("n_error")).alias("errors"), F.col("n_warning").alias("warnings"))
    return certify.issue(docs, "doc_id", "text", v, "siltstone", 1700000000)


@query(f"{_CERT} SELECT doc_id, sha256(text) AS file_hash, sha256(doc_id || ':' || sha256(text) || ':1700000000') AS id, coalesce(n_critical + n_error, 0) = 0 AS passed, CAST(coalesce(n_critical + n_error, 0) AS INT) AS errors FROM documents LEFT JOIN s USING (doc_id)")
def cert_hash(spark, d):
    return certificates(spark, d).select("doc_id", "file_hash", "id", "passed", "errors")


@query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 5 = 0)")
def revocation(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("id"))
    return certify.not_revoked(docs, docs.filter("doc_id % 5 = 0")).select("doc_id")


SECRET = b"a key for tests"
_PAD = lambda x: "".join(f"{b ^ x:02x}" for b in SECRET.ljust(64, b"\0"))


@query(f"{_CERT}, c AS (SELECT doc_id, concat_ws(':', sha256(doc_id || ':' || sha256(text) || ':1700000000'), sha256(text), (coalesce(n_critical + n_error, 0) = 0)::VARCHAR, coalesce(n_critical + n_error, 0)::INT::VARCHAR, coalesce(n_warning, 0)::INT::VARCHAR, '1700000000', 'siltstone') AS m FROM documents LEFT JOIN s USING (doc_id)) SELECT doc_id, sha256(unhex('{_PAD(0x5C)}') || unhex(sha256(unhex('{_PAD(0x36)}') || encode(m)))) AS signature, doc_id % 7 <> 0 AS valid FROM c")
def cert_signed(spark, d):
    certs = certify.signed(certificates(spark, d), SECRET)
    return certify.verified(certs, SECRET, certs.filter("doc_id % 7 = 0").select("id")).select("doc_id", "signature", "valid")


@query("WITH v(e, pk, lo, hi, advisory) AS (VALUES ('b', 'ECONOMY', '10.0', '20.5', 'A1'), ('b', 'SMALL', '9', '9.99', 'A2'), ('b', 'ECONOMY', '40', '100', 'A3')) SELECT p_partkey, advisory FROM part JOIN v ON p_type = pk WHERE (advisory = 'A1' AND p_size BETWEEN 10 AND 20) OR (advisory = 'A2' AND p_size = 9) OR (advisory = 'A3' AND p_size >= 40)")
def vuln_range_join(spark, d):
    deps = table(spark, d, "part").select("p_partkey", F.lit("b").alias("ecosystem"), F.col("p_type").alias("package"), F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("version"))
    v = spark.createDataFrame([("b", "ECONOMY", "10.0", "20.5", "A1", "high"), ("b", "SMALL", "9", "9.99", "A2", "low"), ("b", "ECONOMY", "40", "100", "A3", "low")], "ecosystem string, package string, min_version string, max_version string, advisory string, severity string")
    return files.vulnerable(deps, v).select("p_partkey", "advisory")


@query("SELECT p_brand AS pattern, p_type AS domain, min(CASE WHEN p_size > 40 THEN 0 WHEN p_size > 20 THEN 1 ELSE 2 END) AS rank, to_json(list_sort(list(DISTINCT p_name)))::VARCHAR AS refs FROM part GROUP BY p_brand, p_type")
def rule_merge(spark, d):
    r = table(spark, d, "part").select(F.col("p_brand").alias("pattern"), F.col("p_type").alias("domain"), F.when(F.col("p_size") > 40, "critical").when(F.col("p_size") > 20, "error").otherwise("warning").alias("severity"), F.col("p_partkey").cast("string").alias("rule_id"), F.array("p_name").alias("refs"))
    return merged_rules(r).select("pattern", "domain", scores.severity_rank(F.col("severity")).alias("rank"), F.to_json("refs").alias("refs"))


@query("SELECT lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS key, count(*) AS n, count(DISTINCT p_name) AS spellings FROM part GROUP BY 1 HAVING count(*) > 1")
def fuzzy_rule_groups(spark, d):
    key = F.lower(F.regexp_replace("p_name", "[^A-Za-z0-9]", ""))
    return table(spark, d, "part").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_name").alias("spellings")).filter("n > 1")


@query("WITH c AS (SELECT doc_id, n_chars, len(string_split(text, ' ')) AS w, len(string_split(text, chr(10))) AS l FROM documents) SELECT doc_id, round(least(greatest((171 - 5.2 * ln(greatest(n_chars, 1)) - 0.23 * w - 16.2 * ln(greatest(l, 1)))::DOUBLE * 100 / 171, 0), 100), 6) AS maintainability FROM c")
def maintainability(spark, d):
    docs = table(spark, d, "documents")
    m = scores.maintainability(F.col("n_chars").cast("double"), F.size(F.split("text", " ")).cast("double"), F.size(F.split("text", "\n")).cast("double"))
    return docs.select("doc_id", F.round(m, 6).alias("maintainability"))


# every part is a package's release with advisories of its own for a narrow range, and some are pre-releases
@query("""WITH d AS (SELECT p_partkey, p_brand AS package, p_size AS major, p_partkey % 97 AS minor, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END AS release FROM part)
SELECT d.p_partkey, count(*) AS advisories, min(v.p_partkey) AS first_advisory FROM d JOIN d v ON d.package = v.package
  AND (d.major, d.minor, d.release) >= (v.major, v.minor, 1) AND (d.major, d.minor, d.release) <= (v.major, v.minor + 5, 1) GROUP BY d.p_partkey""")
def vuln_many_ranges(spark, d):
    """Hundreds of ranges a package: a version meets those of its own bins."""
    p = table(spark, d, "part")
    version = lambda minor: F.concat(F.col("p_size").cast("string"), F.lit("."), minor.cast("string"))
    minor = F.col("p_partkey") % 97
    deps = p.select("p_partkey", F.lit("b").alias("ecosystem"), F.col("p_brand").alias("package"), F.concat(version(minor), F.when(F.col("p_partkey") % 7 == 0, F.lit("-rc.1")).otherwise(F.lit(".0"))).alias("version"))
    v = p.select(F.lit("b").alias("ecosystem"), F.col("p_brand").alias("package"), version(minor).alias("min_version"), version(minor + 5).alias("max_version"), F.col("p_partkey").alias("advisory"), F.lit("high").alias("severity"))
    return files.advised(deps, v).groupBy("p_partkey").agg(F.sum("advisories").alias("advisories"), F.min("first_advisory").alias("first_advisory"))


# an exemption for each customer of the users' numbers: its folder, one of its files, or a glob in it
@query(f"""{_VIOL}, e AS (SELECT c_custkey AS id, 'u' || (c_custkey % 10) || '/f' || c_custkey AS path, c_custkey % 3 AS kind FROM customer),
p AS (SELECT DISTINCT path FROM v),
m AS (SELECT DISTINCT v.path, e.id FROM p v JOIN e ON e.kind = 0 AND v.path = e.path OR e.kind = 1 AND e.id < 10 AND starts_with(v.path, 'u' || e.id || '/') OR e.kind = 2 AND regexp_matches(v.path, '^u' || (e.id % 10) || '/f' || e.id || '[^/]*$'))
SELECT v.id, v.path, min(m.id) AS exemption FROM v LEFT JOIN m ON v.path = m.path GROUP BY v.id, v.path""")
def many_exemptions(spark, d):
    """As many exemptions of each rule as there are customers."""
    v = violations(spark, d)
    kind = F.col("c_custkey") % 3
    path = F.concat(F.lit("u"), (F.col("c_custkey") % 10).cast("string"), F.lit("/f"), F.col("c_custkey").cast("string"))
    dirs = F.when(F.col("c_custkey") < 10, F.concat(F.lit("u"), F.col("c_custkey").cast("string")))
    ex = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(kind == 0, "file").when(kind == 1, "dir").otherwise("glob").alias("scope_kind"),
        F.when(kind == 0, path).when(kind == 1, dirs).otherwise(F.concat(path, F.lit("*"))).alias("scope_value"),
        F.col("c_custkey").alias("ordinal"),
        F.explode(F.array(*(F.lit(r) for r in RULE_OF.values()))).alias("rule_id"),
    )
    return state.exempted(v, ex.filter("scope_value IS NOT NULL")).select("id", "path", "exemption")


@query("SELECT p_partkey, greatest(0, least(1, 1 - (p_size % 13) / 10)) AS error_handling, least(1, p_size / 20) AS complexity, CASE WHEN p_partkey % 3 = 0 THEN 0.5::DOUBLE ELSE 0 END AS documentation FROM part")
def feature_metrics(spark, d):
    """Snapshot metrics of feature counts."""
    f = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 13).alias("unwraps"), F.col("p_size").alias("cyclomatic"), (F.col("p_partkey") % 3 == 0).alias("documented"))
    return drift.quality_metrics(f, ["p_partkey"])


@query("""WITH v AS (SELECT *, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'accept' ELSE 'reject' END AS verdict FROM events),
g AS (SELECT user_id, count_if(verdict = 'accept') AS a, count_if(verdict <> 'accept') AS r, arg_max(verdict, (ts, event_id)) AS l, max(event_type = 'signup') AS whitelisted FROM v GROUP BY user_id),
f AS (SELECT user_id, whitelisted, CASE WHEN l = 'accept' THEN 0.3::DOUBLE * a / (a + r) ELSE -0.3::DOUBLE * r / (a + r) END AS adjustment, greatest(a, r) >= 110 AS permanent FROM g),
c AS (SELECT event_id, f.*, least(1, greatest(0, value / 500 + adjustment)) AS adjusted FROM events JOIN f USING (user_id))
SELECT event_id, round(adjusted, 6) AS adjusted, CASE WHEN whitelisted THEN 'suppressed' WHEN permanent THEN CASE WHEN adjustment > 0 THEN 'accepted' ELSE 'rejected' END WHEN adjusted < 0.25 THEN 'dropped' ELSE 'reported' END AS verdict FROM c""")
def feedback_validation(spark, d):
    """Whitelisted and permanent patterns first, then the confidence that feedback adjusts."""
    e = table(spark, d, "events")
    learned = state.feedback(e.select("user_id", "ts", F.col("event_id").alias("id"), F.when(F.col("event_type").isin("click", "view", "purchase"), "accept").otherwise("reject").alias("verdict")), ["user_id"], 110)
    white = e.groupBy("user_id").agg(F.max(F.col("event_type") == "signup").alias("whitelisted"))
    out = insight.analysed(e.select("event_id", "user_id", (F.col("value") / 500).alias("confidence")), learned.join(white, "user_id"), ["user_id"])
    return out.select("event_id", F.round("adjusted", 6).alias("adjusted"), "verdict")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey ELSE 50 END AS depth, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'all' END AS pack,
  least(c_nationkey * 4, 60) AS confidence, CASE WHEN c_custkey % 5 = 0 THEN 7 END AS severity FROM customer""")
def settings_merged(spark, d):
    """Defaults, then what a project sets, then what a user sets; of thresholds of two sources the smaller."""
    text = lambda c: F.col(c).cast("string")
    own = lambda when, name, value: F.when(when, F.create_map(F.lit(name), value)).otherwise(F.create_map().cast("map<string,string>"))
    c = table(spark, d, "customer")
    settings = state.layered(F.create_map(F.lit("depth"), F.lit("50"), F.lit("pack"), F.lit("all")), own(F.col("c_custkey") % 3 == 0, "depth", text("c_nationkey")), own(F.col("c_custkey") % 2 == 0, "pack", F.col("c_mktsegment")))
    one = F.create_map(F.lit("confidence"), (F.col("c_nationkey") * 4).cast("int"))
    other = F.map_concat(F.create_map(F.lit("confidence"), F.lit(60)), F.when(F.col("c_custkey") % 5 == 0, F.create_map(F.lit("severity"), F.lit(7))).otherwise(F.create_map().cast("map<string,int>")))
    c = c.select("c_custkey", settings.alias("s"), state.merged_thresholds(one, other).alias("t"))
    return c.select("c_custkey", F.col("s.depth").cast("int").alias("depth"), F.col("s.pack").alias("pack"), F.col("t.confidence").alias("confidence"), F.col("t.severity").alias("severity"))
