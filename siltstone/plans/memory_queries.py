"""Queries of a memory, its statistics and what is learned, over documents, events and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift, memory, rules, state
from ..sources.tables import table
from . import history_queries as h
from .pack import PROSE, findings_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def entries(spark, d):
    d = table(spark, d, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("memory_type"), F.col("source").alias("project"), F.col("n_chars").alias("recall_count"), (F.col("doc_id") % 997).alias("created_at"))


@query("SELECT doc_id AS id FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 20")
def recall_by_type(spark, d):
    return memory.by_type(entries(spark, d), "fr", 20).select("id")


@query("SELECT doc_id AS id FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 20")
def recall_by_project(spark, d):
    return memory.by_project(entries(spark, d), "src3", 20).select("id")


@query("SELECT doc_id AS id, n_chars AS recall_count FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def popular_entries(spark, d):
    return memory.popular(entries(spark, d), 25).select("id", "recall_count")


@query("SELECT doc_id AS id, doc_id % 997 AS created_at FROM documents ORDER BY doc_id % 997 DESC, doc_id LIMIT 25")
def recent_entries(spark, d):
    return memory.recent(entries(spark, d), 25).select("id", "created_at")


@query("SELECT 'total' AS fact, '' AS value, count(*) AS n FROM documents UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def memory_statistics(spark, d):
    return memory.statistics(table(spark, d, "documents"), ["lang", "source"])


@query("SELECT DISTINCT p_name AS name FROM part WHERE p_name LIKE 's%' ORDER BY name LIMIT 10")
def name_completions(spark, d):
    return memory.completions(table(spark, d, "part").select(F.col("p_name").alias("name")), F.lit("s"), 10)


# a user's day is a run, its errors are the violations, those of a high value are accepted
_RUNS = "WITH r AS (SELECT DISTINCT user_id, ts::DATE AS id FROM events), v AS (SELECT user_id, ts::DATE AS run, event_id, value FROM events WHERE event_type = 'error'), n AS (SELECT r.user_id, r.id, count(v.run) AS n FROM r LEFT JOIN v ON v.user_id = r.user_id AND v.run = r.id GROUP BY ALL)"


def _learned(spark, d):
    e = table(spark, d, "events").withColumn("run", F.to_date("ts"))
    runs = e.select("user_id", F.col("run").alias("id"), F.col("run").alias("ts")).distinct()
    bad = e.filter("event_type = 'error'").select("user_id", "run", F.col("event_id").alias("violation"), F.lit("SEC001").alias("rule_id"), F.concat(F.lit("f"), (F.floor("value") % 5).cast("string")).alias("file"))
    accepted = e.filter("event_type = 'error' AND value > 100").select("user_id", F.col("event_id").alias("violation"))
    return memory.learned_config(runs, bad, accepted, ["user_id"])


@query(f"{_RUNS}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) - 1 AS age FROM n) SELECT user_id, count(*) AS samples, round(sum(0.9::DOUBLE ** age * 0.1::DOUBLE * n), 6) AS violation_rate FROM a GROUP BY user_id")
def learned_rates(spark, d):
    return _learned(spark, d)[0].withColumn("violation_rate", F.round("violation_rate", 6))


@query("SELECT DISTINCT user_id, 'SEC001' AS rule_id, 'f' || (CAST(floor(value) AS BIGINT) % 5) AS file FROM events WHERE event_type = 'error' AND value > 100")
def learned_whitelist(spark, d):
    return _learned(spark, d)[1]


@query(f"{h._VIOL}, x2 AS (SELECT exemption AS id, count(*) AS applications, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_used FROM x WHERE exemption IS NOT NULL GROUP BY 1), e(id, rule_id) AS (VALUES ('e1', 'DOC001'), ('e2', 'STYLE001'), ('e3', 'STYLE002'), ('e4', 'LOGIC001'), ('e5', 'DOC001')) SELECT e.id, rule_id, coalesce(applications, 0) AS applications, last_used FROM e LEFT JOIN x2 USING (id)")
def exemption_use(spark, d):
    ex = spark.createDataFrame([("e1", "DOC001"), ("e2", "STYLE001"), ("e3", "STYLE002"), ("e4", "LOGIC001"), ("e5", "DOC001")], "id string, rule_id string")
    out = memory.applied(ex, h.exempted(spark, d))
    return out.select("id", "rule_id", "applications", F.date_format("last_used", "yyyy-MM-dd HH:mm:ss").alias("last_used"))


@query("WITH r AS (SELECT p_partkey, ['clippy', 'eslint', 'pylint', 'cwe', 'owasp'][1 + p_partkey % 5] AS source, CASE p_partkey % 5 WHEN 0 THEN ['correctness', 'style', 'pedantic'][1 + p_size % 3] WHEN 1 THEN ['2', '1', '0'][1 + p_size % 3] WHEN 2 THEN ['F', 'W', 'C'][1 + p_size % 3] WHEN 3 THEN ['High', 'Medium', 'Low'][1 + p_size % 3] ELSE ['critical', 'medium', 'low'][1 + p_size % 3] END AS level, p_name AS pattern, p_brand AS domain FROM part), s AS (SELECT *, CASE WHEN level IN ('F', 'critical') THEN 0 WHEN level IN ('correctness', '2', 'High') THEN 1 WHEN level IN ('1', 'W', 'Medium', 'medium') THEN 2 WHEN level IN ('style', 'C', 'Low', 'low') THEN 3 ELSE 4 END AS rank, upper(source) || '-' || p_partkey AS rule_id FROM r) SELECT pattern, domain, arg_min(rule_id, (rank, rule_id)) AS rule_id, min(rank) AS rank, count(DISTINCT p_partkey) AS refs FROM s WHERE rank <= 3 GROUP BY pattern, domain")
def imported_rules(spark, d):
    from ..functions.scores import severity_rank

    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_size") % 3 + 1).cast("int"))
    n = F.col("p_partkey") % 5
    level = F.when(n == 0, pick("correctness", "style", "pedantic")).when(n == 1, pick("2", "1", "0")).when(n == 2, pick("F", "W", "C")).when(n == 3, pick("High", "Medium", "Low")).otherwise(pick("critical", "medium", "low"))
    source = F.element_at(F.array(*map(F.lit, ("clippy", "eslint", "pylint", "cwe", "owasp"))), (n + 1).cast("int"))
    records = table(spark, d, "part").select(source.alias("source"), F.col("p_partkey").cast("string").alias("code"), level.alias("level"), F.col("p_name").alias("pattern"), F.col("p_brand").alias("domain"), F.lit(None).cast("string").alias("language"), F.col("p_partkey").cast("string").alias("reference"))
    out = memory.imported(records)
    return out.select("pattern", "domain", "rule_id", severity_rank(F.col("severity")).alias("rank"), F.size("refs").cast("long").alias("refs"))


@query("WITH w AS (SELECT 'suffix' AS name, split_part(p_name, ' ', -1) AS value FROM part UNION ALL SELECT 'prefix', split_part(p_name, ' ', 1) FROM part), c AS (SELECT name, value, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS p, sum(n) OVER (PARTITION BY name) AS total FROM c) SELECT 'learned-' || name AS rule_id, string_agg(value, ',' ORDER BY p) AS allowed, round(sum(n) / max(total), 6) AS confidence, CASE WHEN sum(n) / max(total) >= 0.8 THEN 'warning' ELSE 'info' END AS severity FROM r WHERE p <= CASE name WHEN 'suffix' THEN 5 ELSE 8 END GROUP BY name")
def contracts_generated(spark, d):
    words = F.split("p_name", " ")
    both = F.array(F.struct(F.lit("suffix").alias("name"), F.element_at(words, -1).alias("value")), F.struct(F.lit("prefix").alias("name"), F.element_at(words, 1).alias("value")))
    rows = table(spark, d, "part").select(F.explode(both).alias("w")).groupBy("w.name", "w.value").agg(F.count(F.lit(1)).alias("n"))
    out = memory.generated_contracts(rows, {"suffix": 5, "prefix": 8})
    return out.select("rule_id", F.array_join("allowed", ",").alias("allowed"), F.round("confidence", 6).alias("confidence"), "severity")


@query(f"{findings_sql(PROSE, 'documents', 'doc_id', 'text')}, s AS (SELECT doc_id, count_if(severity IN ('critical', 'error')) AS bad FROM f GROUP BY doc_id) SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM documents) - (SELECT count_if(bad > 0) FROM s) AS passed, (SELECT count_if(bad > 0) FROM s) AS failed, CAST(sum(n) AS BIGINT) AS findings, CAST(coalesce(sum(n) FILTER (severity IN ('critical', 'error')), 0) AS BIGINT) AS errors, CAST(coalesce(sum(n) FILTER (severity = 'warning'), 0) AS BIGINT) AS warnings FROM f")
def batch_totals(spark, d):
    docs = table(spark, d, "documents")
    found = rules.findings(docs, PROSE, ["doc_id"])
    return memory.run_totals(rules.verdicts(docs, found, ["doc_id"]), found)


@query(f"{h._TREND}, s AS (SELECT file_path, least(1, sum(CASE WHEN direction = 'declining' THEN CASE severity WHEN 'high' THEN 0.3::DOUBLE WHEN 'medium' THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END ELSE 0 END)) AS score FROM t GROUP BY file_path), r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, file_path) AS place FROM s) SELECT file_path, round(score, 6) AS score, place FROM r WHERE place <= 20")
def drift_report(spark, d):
    out = drift.report(drift.flat_score(drift.trends(h.snapshots(spark, d), ["file_path"]), ["file_path"]), "file_path", 20)
    return out.withColumn("score", F.round("score", 6))


@query(f"{h._VIOL}, o AS (SELECT *, row_number() OVER (PARTITION BY rule_id, path ORDER BY ts, id) AS occurrence, CASE rule_id WHEN 'SEC001' THEN 'inviolable' WHEN 'LOGIC001' THEN 'strict' ELSE 'flexible' END AS tier FROM x), a AS (SELECT *, CASE WHEN tier = 'inviolable' THEN 'block' WHEN exemption IS NOT NULL THEN 'accept' WHEN tier = 'flexible' AND occurrence = 3 THEN 'learn' WHEN tier = 'flexible' AND occurrence > 3 THEN 'accept' WHEN confidence < 0.6 THEN 'ask' ELSE 'warn' END AS action FROM o) SELECT action, CASE action WHEN 'block' THEN 'inviolable rule ' || rule_id WHEN 'accept' THEN 'an exemption or a learned pattern' WHEN 'learn' THEN 'seen often enough to learn' WHEN 'ask' THEN 'not confident enough' ELSE 'reported' END AS reason, tier, action <> 'block' AS overridable, count(*) AS n FROM a GROUP BY ALL")
def decisions_made(spark, d):
    rows = memory.decision(state.compliance(h.exempted(spark, d)))
    return rows.groupBy("decision.action", "decision.reason", "decision.tier", "decision.overridable").agg(F.count(F.lit(1)).alias("n"))
