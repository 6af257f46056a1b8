"""Queries of rules and lines over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import code, lines, rules
from ..sources.tables import table
from .pack import LAYERS, PAGES, PROSE, findings_sql, totals_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


DOCS = findings_sql(PROSE, "documents", "doc_id", "text")
_LINES = "WITH t AS (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS a FROM documents), t2 AS (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM t), l AS (SELECT doc_id, unnest(a) AS content, unnest(range(1, len(a) + 1)) AS line FROM t2)"


def documents(spark, d):
    return table(spark, d, "documents")


def prose(spark, d):
    return rules.findings(documents(spark, d), PROSE, ["doc_id"])


@query(f"{DOCS} SELECT doc_id, rule_id, layer, severity, message, n AS count, line FROM f")
def rule_findings(spark, d):
    return prose(spark, d).drop("lines")


@query(f"{DOCS}, s AS ({totals_sql('doc_id')}) SELECT t.doc_id, {', '.join(f'coalesce(n_{s}, 0) AS n_{s}' for s in ('critical', 'error', 'warning', 'info', 'hint'))}, round(least(greatest(100.0::DOUBLE - 10 * coalesce(n_critical + n_error, 0) - 2 * coalesce(n_warning, 0) - 0.5::DOUBLE * coalesce(n_info, 0), 0), 100), 6) AS quality, round(greatest(0, 1 - coalesce(penalty, 0)), 6) AS score, coalesce(n_critical + n_error, 0) = 0 AS passed FROM t LEFT JOIN s USING (doc_id)")
def rule_scan_verdict(spark, d):
    return rules.verdicts(documents(spark, d), prose(spark, d), ["doc_id"])


def _one(i):
    return lambda spark, d: rules.findings(documents(spark, d), [PROSE[i]], ["doc_id"]).select("doc_id", "count", "line")


for _name, _i in (("rule_regex", 1), ("rule_text", 4), ("rule_and", 5), ("rule_or", 6), ("rule_not", 7)):
    QUERIES[_name] = _one(_i)
    SQL[_name] = f"{findings_sql([PROSE[_i]], 'documents', 'doc_id', 'text')} SELECT doc_id, n AS count, line FROM f"


@query(f"{DOCS} SELECT severity, layer, CAST(sum(n) AS BIGINT) AS findings, count(DISTINCT doc_id) AS texts FROM f GROUP BY ALL")
def severity_rollup(spark, d):
    return prose(spark, d).groupBy("severity", "layer").agg(F.sum("count").alias("findings"), F.countDistinct("doc_id").alias("texts"))


@query(f"{DOCS} SELECT layer, CAST(coalesce(sum(n), 0) AS BIGINT) AS findings, count(n) AS hits FROM (SELECT unnest({LAYERS}) AS layer) LEFT JOIN f USING (layer) GROUP BY layer")
def layer_zero_fill(spark, d):
    return rules.layer_totals(prose(spark, d), LAYERS)


@query(f"{DOCS} SELECT doc_id, {', '.join(f'CAST(coalesce(sum(n) FILTER (severity = {chr(39)}{s}{chr(39)}), 0) AS BIGINT) AS n_{s}' for s in ('critical', 'error', 'warning', 'info', 'hint'))} FROM f GROUP BY doc_id")
def severity_pivot(spark, d):
    return rules.severity_totals(prose(spark, d), ["doc_id"])


@query(f"{_LINES}, v AS (SELECT doc_id, line, CASE WHEN contains(content, '!!') THEN 'shouts' ELSE 'noise' END AS rule_id FROM l WHERE contains(content, '!!') OR contains(content, '###')) SELECT doc_id, rule_id, count(*) AS count, CAST(min(line) AS INT) AS line, to_json(list_sort(list(line)))::VARCHAR AS lines FROM v GROUP BY doc_id, rule_id")
def violation_dedup(spark, d):
    rows = lines.line_table(documents(spark, d), ["doc_id"]).filter(F.contains("content", F.lit("!!")) | F.contains("content", F.lit("###")))
    rows = rows.select("doc_id", "line", F.when(F.contains("content", F.lit("!!")), "shouts").otherwise("noise").alias("rule_id"), F.lit("m").alias("message"), F.lit("hint").alias("severity"))
    return rules.deduplicated(rows, ["doc_id"]).select("doc_id", "rule_id", "count", "line", F.to_json("lines").alias("lines"))


_PAGES = findings_sql(PAGES, "pages", "page_id", "html")


@query(f"{_PAGES}, h AS (SELECT DISTINCT page_id FROM f WHERE layer = 'syntax' AND severity IN ('critical', 'error')) SELECT page_id, rule_id, layer, n AS count FROM f WHERE layer = 'syntax' OR page_id NOT IN (SELECT page_id FROM h)")
def halt_on_syntax(spark, d):
    found = rules.findings(table(spark, d, "pages"), PAGES, ["page_id"], "html")
    return rules.halted(found, LAYERS, ["page_id"]).select("page_id", "rule_id", "layer", "count")


@query(f"{_PAGES} SELECT page_id, rule_id, (rule_id = 'PAGE002' AND regexp_matches(url, '^https?://[^/]*[.]example[.]com/.*$')) OR (rule_id = 'PAGE004') AS suppressed FROM f JOIN pages USING (page_id)")
def whitelist_filter(spark, d):
    pages = table(spark, d, "pages")
    found = rules.findings(pages, PAGES, ["page_id", "url"], "html")
    white = spark.createDataFrame([("PAGE002", "http://*.example.com/**", None), ("PAGE002", "https://*.example.com/**", "2999-01-01"), ("PAGE004", "**", None), ("PAGE003", "**", "2000-01-01")], "rule_id string, glob string, expires_at string").withColumn("expires_at", F.to_timestamp("expires_at"))
    return rules.whitelisted(found, white, "url", F.lit("2024-01-01").cast("timestamp")).select("page_id", "rule_id", "suppressed")


@query("SELECT page_id FROM pages WHERE NOT contains(html, '<table') OR html IS NULL")
def required_pattern(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("page_id").join(pages.filter(F.contains("html", F.lit("<table"))).select("page_id"), "page_id", "left_anti")


@query(f"{_LINES} SELECT doc_id, count(line) AS n_lines, count_if(trim(content) = '') AS blank, count_if(regexp_matches(content, '^\\s*(//|#|--)')) AS comment, count_if(trim(content) <> '' AND NOT regexp_matches(content, '^\\s*(//|#|--)')) AS code, coalesce(max(strlen(content)), 0) AS longest, count_if(strlen(content) > 120) AS long_lines, count_if(regexp_matches(content, '[ \\t]$')) AS trailing FROM documents LEFT JOIN l USING (doc_id) GROUP BY doc_id")
def line_metrics(spark, d):
    return lines.metrics(documents(spark, d), ["doc_id"])


@query(f"{_LINES}, g AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS g FROM l WHERE strlen(content) > 80) SELECT doc_id, min(line) AS first_line, count(*) AS length FROM g GROUP BY doc_id, g HAVING count(*) > 2")
def long_line_runs(spark, d):
    rows = lines.line_table(documents(spark, d), ["doc_id"])
    return lines.islands(rows, ["doc_id"], F.octet_length("content") > 80, 2)


@query(f"{_LINES} SELECT doc_id, content, count(*) AS n, min(line) AS first_line FROM l WHERE trim(content) <> '' GROUP BY doc_id, content HAVING count(*) > 1")
def repeated_lines(spark, d):
    return lines.repeated(lines.line_table(documents(spark, d), ["doc_id"]), ["doc_id"])


@query(f"{_LINES}, s AS (SELECT doc_id, line, sum(length(content) % 7 - 3) OVER (PARTITION BY doc_id ORDER BY line) AS s FROM l) SELECT doc_id, line, CAST(s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY line)) AS BIGINT) AS depth FROM s")
def depth_window(spark, d):
    rows = lines.line_table(documents(spark, d), ["doc_id"])
    return lines.depth(rows, ["doc_id"], F.length("content") % 7 - 3).select("doc_id", "line", F.col("depth").cast("bigint").alias("depth"))


@query(f"{_LINES}, m AS (SELECT doc_id, line, content, max(CASE WHEN contains(content, '###') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) = 1 AS guarded, max(CASE WHEN contains(content, '!!') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1 AS near FROM l) SELECT doc_id, line, guarded, near FROM m")
def line_context(spark, d):
    rows = lines.line_table(documents(spark, d), ["doc_id"])
    has = lambda s: F.contains("content", F.lit(s))
    return rows.select("doc_id", "line", lines.near_lines(rows, ["doc_id"], has("###"), 10, 0).alias("guarded"), lines.near_lines(rows, ["doc_id"], has("!!"), 3, 3).alias("near"))


@query("SELECT page_id, length(replace(html, '(', '((')) - length(replace(html, ')', '))')) + length(replace(html, '[', '[[')) - length(replace(html, ']', ']]')) + length(replace(html, '{', '{{')) - length(replace(html, '}', '}}')) AS unclosed, length(replace(html, '(', '((')) <> length(replace(html, ')', '))')) OR length(replace(html, '[', '[[')) <> length(replace(html, ']', ']]')) OR length(replace(html, '{', '{{')) <> length(replace(html, '}', '}}')) AS unbalanced FROM pages")
def bracket_balance(spark, d):
    return lines.balance(table(spark, d, "pages"), ["page_id"], text_col="html").select("page_id", F.col("unclosed").cast("bigint").alias("unclosed"), "unbalanced")


@query("SELECT page_id, len(string_split(html, chr(10))) AS line_count, len(regexp_extract_all(html, '\\b(fn|def|function|func)\\s+\\w+')) AS functions, 1 + len(regexp_extract_all(html, '\\b(if|for|while|case|catch|except|elif|match)\\b')) + len(regexp_extract_all(html, '&&|\\|\\||\\?')) AS cyclomatic, len(regexp_extract_all(html, '\\.unwrap\\(\\)|\\.expect\\(')) AS unwraps, len(regexp_extract_all(html, 'TODO|FIXME|HACK')) AS smells, regexp_matches(html, '///|/\\*\\*|\"\"\"') AS documented FROM pages")
def code_features(spark, d):
    return code.features(table(spark, d, "pages"), ["page_id"], "html")


@query("WITH h AS (SELECT 'tag' AS name, unnest(regexp_extract_all(html, '<([a-z]+)', 1)) AS value FROM pages UNION ALL SELECT 'scheme', unnest(regexp_extract_all(html, 'href=\"([a-z]+):', 1)) FROM pages) SELECT name, value, count(*) AS n FROM h GROUP BY ALL")
def pattern_histograms(spark, d):
    return code.histograms(table(spark, d, "pages"), "html", {"tag": "<([a-z]+)", "scheme": 'href="([a-z]+):'})


@query("WITH h AS (SELECT regexp_extract(url, '^([a-z]+):', 1) AS scheme, count(*) AS n FROM pages GROUP BY 1) SELECT 'scheme' AS name, max_by(scheme, (n, scheme)) AS value, max(n) AS n, CAST(sum(n) AS BIGINT) AS total, round(max(n) / sum(n), 6) AS confidence FROM h HAVING max(n) >= 3 AND max(n) / sum(n) >= 0.3")
def learned_conventions(spark, d):
    out = code.learned(code.histograms(table(spark, d, "pages"), "url", {"scheme": "^([a-z]+):"}), 3, 0.3)
    return out.withColumn("confidence", F.round("confidence", 6))


@query("WITH w AS (SELECT unnest(regexp_extract_all(p_name || ' ' || p_brand || ' ' || p_type, '[A-Za-z0-9_#]+')) AS name FROM part), c AS (SELECT CASE WHEN regexp_matches(name, '^[a-z][a-z0-9]*(_[a-z0-9]+)*$') THEN 'snake' WHEN regexp_matches(name, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$') THEN 'screaming' WHEN regexp_matches(name, '^([A-Z][a-z0-9]*)+$') THEN 'pascal' WHEN regexp_matches(name, '^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$') THEN 'camel' ELSE 'mixed' END AS style FROM w) SELECT style, count(*) AS n FROM c GROUP BY style")
def naming_styles(spark, d):
    words = table(spark, d, "part").select(F.explode(F.regexp_extract_all(F.concat_ws(" ", "p_name", "p_brand", "p_type"), F.lit("[A-Za-z0-9_#]+"), 0)).alias("name"))
    return words.groupBy(tx.naming_style(F.col("name")).alias("style")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS g, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count_if(NOT json_valid(props)) AS bad FROM events GROUP BY ALL")
def json_props(spark, d):
    rows = table(spark, d, "events").select("event_type", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"), F.expr("try_parse_json(props) IS NULL").alias("bad"))
    return rows.groupBy("event_type", (F.col("k") % 3).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"), F.count_if("bad").alias("bad"))


@query("SELECT event_type, date_trunc('day', ts)::DATE::VARCHAR AS day, count(*) AS n, round(sum(value), 4) AS total, grouping(event_type, date_trunc('day', ts)::DATE::VARCHAR) AS g FROM events GROUP BY CUBE (event_type, date_trunc('day', ts)::DATE::VARCHAR)")
def grouping_sets_stats(spark, d):
    rows = table(spark, d, "events").select("event_type", F.to_date("ts").cast("string").alias("day"), "value")
    return rows.cube("event_type", "day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.grouping_id().alias("g"))


@query("SELECT event_id, ntile(4) OVER (PARTITION BY user_id ORDER BY value, event_id) AS quarter, round(percent_rank() OVER (PARTITION BY user_id ORDER BY value, event_id), 6) AS place, rank() OVER (PARTITION BY user_id ORDER BY floor(value)) AS rank, count(*) OVER (PARTITION BY user_id ORDER BY value RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM events")
def ranked_events(spark, d):
    """Ranks and frames of each user's events by value."""
    from pyspark.sql import Window as W

    kind = W.partitionBy("user_id")
    own = kind.orderBy("value", "event_id")
    return table(spark, d, "events").select("event_id", F.ntile(4).over(own).alias("quarter"), F.round(F.percent_rank().over(own), 6).alias("place"), F.rank().over(kind.orderBy(F.floor("value"))).alias("rank"), F.count(F.lit(1)).over(kind.orderBy("value").rangeBetween(-5, 5)).alias("near"))


@query()
def approx_stats(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", [0.5, 0.9]).alias("quantiles"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, true AS users_near, true AS quantiles_near FROM events GROUP BY event_type")
def approx_bounds(spark, d):
    """Approximate aggregates beside exact ones: a number of users within a tenth, quantiles within a hundredth of the ranks."""
    e = table(spark, d, "events")
    about = e.groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("about"), F.percentile_approx("value", [0.5, 0.9], F.lit(1000)).alias("q"))
    rows = e.join(F.broadcast(about), "event_type")  # a row for each type of event
    share = lambda i: F.avg((F.col("value") <= F.col("q")[i]).cast("double"))
    out = rows.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.first("about").alias("about"), share(0).alias("a"), share(1).alias("b"))
    near = (F.abs(F.col("a") - 0.5) <= 0.01) & (F.abs(F.col("b") - 0.9) <= 0.01)
    return out.select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= 0.1 * F.col("users")).alias("users_near"), near.alias("quantiles_near"))
