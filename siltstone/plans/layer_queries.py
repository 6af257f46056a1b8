"""Queries of line layers, decisions, prompts and rules over documents, pages, conversations and parts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import graph, insight, layers, lines
from ..operators.layers import LineRule
from ..sources.tables import table
from . import graph_queries as g
from .text_queries import _LINES

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def doc_lines(spark, d):
    return lines.line_table(table(spark, d, "documents"), ["doc_id"])


PACK = [LineRule("L1", "!!", "info"), LineRule("L2", "the", "hint", whole_word=True), LineRule("L3", "###", "warning", context="unguarded"), LineRule("L4", "$$$", "warning", context="unexplained")]
_OUT = lambda n: f"(len(string_split(split_part(content, '{n}', 1), '\"')) - 1) % 2 = 0"
_G, _S = "is_some\\(\\)|is_ok\\(\\)|is_none\\(\\)|is_err\\(\\)|if let|match |unwrap_or|assert", "^\\s*(//|#|\\*|--)"


@query(f"{_LINES}, w AS (SELECT *, max(regexp_matches(content, '{_G}')::INT) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) = 1 AS gd, max((regexp_matches(content, '{_S}') AND regexp_matches(content, '(?i)safety'))::INT) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1 AS ex FROM l), c AS (SELECT * FROM w WHERE NOT regexp_matches(content, '{_S}')), f AS (SELECT doc_id, 'L1' AS rule_id FROM c WHERE contains(content, '!!') AND {_OUT('!!')} UNION ALL SELECT doc_id, 'L2' FROM c WHERE regexp_matches(content, '(^|[^A-Za-z0-9_.])the($|[^A-Za-z0-9_])') AND {_OUT('the')} UNION ALL SELECT doc_id, 'L3' FROM c WHERE contains(content, '###') AND {_OUT('###')} AND NOT gd UNION ALL SELECT doc_id, 'L4' FROM c WHERE contains(content, '$$$') AND {_OUT('$$$')} AND NOT ex) SELECT doc_id, rule_id, count(*) AS n FROM f GROUP BY ALL")
def line_rules(spark, d):
    return layers.line_findings(doc_lines(spark, d), ["doc_id"], PACK).groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_LINES} SELECT doc_id, line FROM l WHERE regexp_matches(content, 'AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|sk-[A-Za-z0-9]{{20,}}|xox[baprs]-[A-Za-z0-9-]+|AIza[0-9A-Za-z_-]{{35}}|-----BEGIN [A-Z ]*PRIVATE KEY-----|(token|secret|password) = \"[^\"]+\"')")
def secret_forms(spark, d):
    return layers.secrets(doc_lines(spark, d), ["doc_id"]).select("doc_id", "line")


@query(f"{_LINES} SELECT doc_id, line FROM l WHERE regexp_matches(upper(content), 'SELECT |INSERT |UPDATE |DELETE |DROP | WHERE | FROM |UNION ') AND regexp_matches(content, 'format!\\(|\\.format\\(|f\"|f''|\" ?\\+|'' ?\\+|%s')")
def sql_building(spark, d):
    return layers.sql_built(doc_lines(spark, d), ["doc_id"]).select("doc_id", "line")


@query("SELECT doc_id, unnest(list_filter([CASE WHEN contains(text, '!!') THEN 'NO_SHOUT' END, CASE WHEN NOT contains(text, '.') THEN 'STOP' END, CASE WHEN len(string_split(text, chr(10))) > 20 THEN 'PRIV_LINES' END], lambda x: x IS NOT NULL)) AS rule_id FROM documents")
def private_rules(spark, d):
    return layers.private_rules(table(spark, d, "documents"), ["doc_id"], {"NO_SHOUT": "!!"}, {"STOP": "."}, 20)


@query(f"{_LINES} SELECT doc_id, line, len(regexp_extract_all(content, '(^|[^\\w.])[0-9]{{2,}}(\\.[0-9]+)?($|[^\\w.])')) AS n FROM l WHERE NOT regexp_matches(content, '{_S}') AND NOT regexp_matches(content, '^\\s*(const|static|final|[A-Z_]+ =)') AND regexp_matches(content, '(^|[^\\w.])[0-9]{{2,}}(\\.[0-9]+)?($|[^\\w.])')")
def magic_numbers(spark, d):
    return layers.magic_numbers(doc_lines(spark, d), ["doc_id"]).select("doc_id", "line", "n")


@query("WITH p AS (SELECT page_id, html FROM pages), l0 AS (SELECT page_id, string_split(html, chr(10)) AS a FROM p), l AS (SELECT page_id, unnest(a) AS content, unnest(range(1, len(a) + 1)) AS line FROM l0), s AS (SELECT *, len(string_split(content, '{')) - len(string_split(content, '}')) AS step, len(regexp_extract_all(content, '\\b(if|for|while|case|catch|except|elif|match)\\b')) AS b FROM l), r AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY line) AS s FROM s), e AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY line)) AS dp FROM r) SELECT page_id, CAST(sum(b) + 1 AS BIGINT) AS cyclomatic, CAST(sum(b * (1 + greatest(0, dp - greatest(0, step)))) AS BIGINT) AS cognitive, CAST(max(dp) AS BIGINT) AS max_nesting FROM e WHERE NOT (content = '' AND line > 1 AND line = (SELECT max(line) FROM l x WHERE x.page_id = e.page_id)) GROUP BY page_id")
def code_complexity(spark, d):
    rows = lines.line_table(table(spark, d, "pages"), ["page_id"], "html")
    return layers.complexity(rows, ["page_id"])


@query("SELECT CASE upper(regexp_extract(r, '^[A-Za-z]+')) WHEN 'SEC' THEN 'security' WHEN 'LOGIC' THEN 'logic' WHEN 'STYLE' THEN 'style' WHEN 'NB' THEN 'notebook' ELSE 'general' END AS domain, count(*) AS n FROM (SELECT CASE event_type WHEN 'error' THEN 'SEC' WHEN 'click' THEN 'logic' WHEN 'view' THEN 'Style' WHEN 'signup' THEN 'NB' ELSE 'X' END || lpad((event_id % 100)::VARCHAR, 3, '0') AS r FROM events) GROUP BY 1")
def rule_domains(spark, d):
    letters = F.when(F.col("event_type") == "error", "SEC").when(F.col("event_type") == "click", "logic").when(F.col("event_type") == "view", "Style").when(F.col("event_type") == "signup", "NB").otherwise("X")
    rows = table(spark, d, "events").select(F.concat(letters, F.lpad((F.col("event_id") % 100).cast("string"), 3, "0")).alias("r"))
    return rows.groupBy(layers.domain(F.col("r")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\\b(project|repo|repository|codebase|everywhere)\\b') THEN 'project' WHEN regexp_matches(lower(text), '\\b(file|module|\\w+\\.[a-z]{1,4})\\b') THEN 'file' WHEN regexp_matches(lower(text), '\\b(function|method|fn|def)\\b') THEN 'function' ELSE 'unknown' END AS scope FROM conversations")
def prompt_scope(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", insight.scope_of(F.col("text")).alias("scope"))


@query("WITH t AS (SELECT conv_id, turn, text AS t FROM conversations), f AS (SELECT *, len(list_filter(string_split_regex(lower(t), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 2)) AS words, len(regexp_extract_all(t, '\\?')) AS questions, len(list_distinct(regexp_extract_all(t, '\\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\\b|\\b[a-z]+(?:_[a-z0-9]+)+\\b'))) AS entities, len(regexp_extract_all(t, '[\\w/]+\\.[a-z]{1,4}\\b')) AS files, len(regexp_extract_all(lower(t), '\\b(it|this|that|something|somehow|stuff|thing)\\b')) AS vague FROM t) SELECT conv_id, turn, words, questions, entities, files, vague, round((CASE WHEN words < 5 THEN 0.4 ELSE 0 END + least(0.4, vague * 0.1) + CASE WHEN files = 0 AND entities = 0 THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS ambiguity FROM f")
def prompt_facts(spark, d):
    return insight.prompt_facts(table(spark, d, "conversations"), ["conv_id", "turn"])


@query("SELECT doc_id, round(greatest(0, CASE WHEN n = 0 THEN 0.3 ELSE least(0.95, 0.5 + 0.1 * n) END - 0.1 * b)::DOUBLE, 6) AS score FROM (SELECT doc_id, (contains(lower(text), 'the') AND contains(lower(text), 'and'))::INT + contains(lower(text), 'ou')::INT AS n, contains(lower(text), '!!')::INT AS b FROM documents)")
def context_quality(spark, d):
    s = insight.context_quality(F.col("text"), [["the", "and"], ["ou"]], [["!!"]])
    return table(spark, d, "documents").select("doc_id", F.round(s, 6).alias("score"))


@query("SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the') THEN 1.0 ELSE 0.5 * len(list_filter([role, 'the end'], lambda t: contains(lower(t), 'the'))) END::DOUBLE AS score FROM conversations")
def decision_recall(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", insight.keyword_recall(F.lit("the"), F.col("text"), F.array("role", F.lit("the end"))).alias("score"))


@query("SELECT conv_id, turn FROM conversations QUALIFY lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL")
def decision_active(spark, d):
    """Each turn supersedes the one before it, whatever its number."""
    id_ = F.struct("conv_id", "turn")
    before = F.lag(id_).over(W.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, d, "conversations").select(id_.alias("id"), F.when(before.isNotNull(), F.array(before)).otherwise(F.array().cast("array<struct<conv_id:bigint,turn:bigint>>")).alias("supersedes"))
    return insight.active(c).select("id.conv_id", "id.turn")


@query("WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, arg_min(lang, (-n, lang)) AS lang, max(n) AS n FROM n GROUP BY source")
def commonest_language(spark, d):
    return insight.commonest(table(spark, d, "documents"), ["source"], "lang")


@query("SELECT tag, count(DISTINCT p_partkey) AS rules, min(CASE WHEN p_size > 40 THEN 0 WHEN p_size > 20 THEN 1 ELSE 2 END) AS worst FROM (SELECT p_partkey, p_size, unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY tag")
def rules_by_tag(spark, d):
    r = table(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.when(F.col("p_size") > 40, "critical").when(F.col("p_size") > 20, "error").otherwise("warning").alias("severity"), F.split("p_name", " ").alias("tags"))
    return insight.by_tag(r)


@query("WITH a AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'boost_case' WHEN 'view' THEN 'boost_pattern' WHEN 'purchase' THEN 'whitelist' ELSE 'skip' END AS answer FROM events), s AS (SELECT user_id, sum(CASE answer WHEN 'boost_case' THEN 0.1::DOUBLE WHEN 'boost_pattern' THEN 0.2::DOUBLE WHEN 'whitelist' THEN 0.3::DOUBLE ELSE 0 END) AS boost, max(answer = 'whitelist') AS whitelisted FROM a GROUP BY user_id) SELECT user_id, round(least(1, boost), 6) AS boost, round(boost, 6) AS uncapped, whitelisted FROM s")
def question_effects(spark, d):
    # the uncapped sum tells users at the cap apart
    e = table(spark, d, "events")
    answer = F.when(F.col("event_type") == "click", "boost_case").when(F.col("event_type") == "view", "boost_pattern").when(F.col("event_type") == "purchase", "whitelist").otherwise("skip")
    return insight.effects(e.select("user_id", answer.alias("answer")), ["user_id"]).withColumn("boost", F.round("boost", 6)).withColumn("uncapped", F.round("uncapped", 6))


@query(f"{g._E} SELECT DISTINCT src AS node FROM e WHERE src NOT IN (SELECT dst FROM e)")
def entry_points(spark, d):
    return graph.entry_points(g.edges(spark, d))


@query(f"{g._E}, {g._reach('p_partkey % 50 = 0', 'src', 'dst', 3)}, r2 AS (SELECT p_partkey AS start, p_partkey AS node, 0 AS depth FROM part WHERE p_partkey % 50 = 0 UNION SELECT start, src, depth + 1 FROM r2 JOIN e ON node = dst WHERE depth < 3), m2 AS (SELECT start, node, min(depth) AS depth FROM r2 GROUP BY start, node), u AS (SELECT start, 'calls' AS direction, depth, node FROM m WHERE depth > 0 UNION ALL SELECT start, 'callers', depth, node FROM m2 WHERE depth > 0) SELECT start, direction, depth, array_to_string(list_sort(list(node)), ',') AS nodes FROM u GROUP BY start, direction, depth")
def full_context(spark, d):
    out = graph.full_context(g.edges(spark, d), g.starts(spark, d), 3)
    return out.withColumn("nodes", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ","))


@query("WITH RECURSIVE c AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent, p_size > 2 AS valid FROM part), t AS (SELECT id, valid AS ok FROM c WHERE id = 1 UNION ALL SELECT c.id, ok AND valid FROM c JOIN t ON c.parent = t.id) SELECT c.id, coalesce(max(ok), false) AS trusted FROM c LEFT JOIN t USING (id) GROUP BY c.id")
def chain_trust(spark, d):
    p = table(spark, d, "part")
    c = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 1, F.expr("p_partkey div 2")).alias("parent"), (F.col("p_size") > 2).alias("valid"))
    # an anchor's own certificate has to be valid too
    ok = c.filter("id = 1 AND valid").select("id")
    return insight.chain_trust(c, ok)


@query()
def hashed_embeddings(spark, d):
    return table(spark, d, "benchmark").select("item_id", insight.hashed_embedding(F.col("text"), 64).alias("embedding"))


# links of pages under the element that encloses them, resolved to pages whose title has the word that is linked
@query("""WITH l0 AS (SELECT page_id, string_split(html, '<') AS a FROM pages), l AS (SELECT page_id, '<' || unnest(a) AS content, unnest(range(1, len(a) + 1)) AS line FROM l0),
x AS (SELECT *, nullif(regexp_extract(content, '^<(nav|article|header|footer|section|aside|main|body)\\b', 1), '') AS def, nullif(regexp_extract(content, '^<a [^>]*href="/?([^"]+)"', 1), '') AS ref FROM l),
c AS (SELECT page_id, ref, last_value(def IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS caller FROM x QUALIFY ref IS NOT NULL),
t AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(regexp_extract(html, '<title>([^<]*)', 1), '[^ .,]+')) AS word FROM pages)
SELECT caller, ref, count(DISTINCT t.page_id) AS pages, count(DISTINCT c.page_id) AS linked_from FROM c JOIN t ON ref = word GROUP BY caller, ref""")
def page_links(spark, d):
    pages = table(spark, d, "pages")
    parts = pages.select("page_id", F.posexplode(F.split("html", "<")).alias("_i", "_c")).select("page_id", (F.col("_i") + 1).alias("line"), F.concat(F.lit("<"), "_c").alias("content"))
    calls = layers.calls(parts, ["page_id"], "html")
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_extract("html", "<title>([^<]*)", 1), F.lit("[^ .,]+"), 0)))
    nodes = pages.select("page_id", word.alias("name")).select("page_id", "name", F.concat(F.col("page_id").cast("string"), F.lit("::"), "name").alias("node_id"))
    refs = calls.select(F.col("ref").alias("src"), "ref").distinct()
    found = g.graph.resolve(nodes.select("node_id", "name"), refs).join(nodes.select(F.col("node_id").alias("dst"), F.col("page_id").alias("to")), "dst")
    targets = found.groupBy(F.col("src").alias("ref")).agg(F.countDistinct("to").alias("pages"))
    return calls.groupBy("caller", "ref").agg(F.countDistinct("page_id").alias("linked_from")).join(targets, "ref").select("caller", "ref", "pages", "linked_from")
