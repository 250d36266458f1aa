"""Queries over lines, rules and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import findings as f
from corpusmill.operators import rules as r
from corpusmill.plans.bindings import CATALOG, EV, HITS, LINES, RULES, events, files, hits, lines, load, pages, plan
from corpusmill.sources import files as s

DISABLED = ("LICENSE", "IPV4")
_catalog_sql = ", ".join(f"('{a}', '{b}', '{c}', '{e}', {str(a not in DISABLED).lower()})" for a, b, c, e in CATALOG)
CAT = f"cat(rule_id, title, severity, category, enabled) AS (VALUES {_catalog_sql})"
RANK = "CASE severity WHEN 'ERROR' THEN 3 WHEN 'WARNING' THEN 2 WHEN 'INFO' THEN 1 ELSE 0 END"


def catalog(spark):
    return r.rule_catalog(spark, CATALOG, DISABLED)


@plan("s2_explode_lines", f"WITH {LINES} SELECT repo, path, CAST(line AS INT) AS line, text FROM lines")
def _(spark, d):
    return lines(spark, d)


@plan("s3_parse_property_lines", f"""WITH {LINES}, p AS (SELECT repo, path, line, trim(regexp_extract(text, '^([^=:]*)[=:]', 1)) AS name, trim(regexp_extract(text, '^[^=:]*[=:](.*)$', 1)) AS value FROM lines WHERE NOT regexp_matches(trim(text), '^[#!]') AND regexp_matches(text, '[=:]'))
SELECT repo, path, CAST(line AS INT) AS line, name, value FROM p WHERE name <> ''""")
def _(spark, d):
    return s.parse_property_lines(lines(spark, d))


@plan("s10_within_budget", """WITH w AS (SELECT source AS repo, doc_id AS path, n_chars AS size, count(*) OVER o AS n, sum(n_chars) OVER o AS total FROM documents WINDOW o AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT repo, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, min(CASE WHEN n > 45 OR size > 15000 OR total > 120000 THEN path END) AS first_offender FROM w GROUP BY repo),
x AS (SELECT *, sum(CASE WHEN first_offender IS NULL THEN files ELSE 0 END) OVER (ORDER BY repo) AS rf, sum(CASE WHEN first_offender IS NULL THEN bytes ELSE 0 END) OVER (ORDER BY repo) AS rb FROM g)
SELECT repo, files, bytes, first_offender, first_offender IS NULL AS accepted, first_offender IS NULL AND rf <= 100 AND rb <= 300000 AS accepted_in_run FROM x""")
def _(spark, d):
    docs = load(spark, d, "documents").select(F.col("source").alias("repo"), F.col("doc_id").alias("path"), F.col("n_chars").alias("size"))
    return s.within_budget(docs, 45, 15_000, 120_000, 100, 300_000)


@plan("r1_severity_states", f"WITH {CAT} SELECT c.severity, count(DISTINCT c.rule_id) AS rules, count(DISTINCT CASE WHEN enabled THEN c.rule_id END) AS enabled_rules, count(DISTINCT CASE WHEN enabled THEN c.rule_id END) = 0 AS fully_disabled FROM cat c JOIN (SELECT DISTINCT rule_id FROM ({HITS.replace('lines AS', 'SELECT * FROM (WITH lines AS', 1)} SELECT rule_id FROM hits))) h USING (rule_id) GROUP BY c.severity")
def _(spark, d):
    seen = hits(spark, d).select("rule_id").distinct()
    return r.severity_states(catalog(spark).join(seen, "rule_id", "left_semi"))


@plan("r2_rule_scan", f"WITH {HITS} SELECT repo, path, CAST(line AS INT) AS line, rule_id, severity, category, evidence FROM hits")
def _(spark, d):
    return hits(spark, d)


@plan("r3_missing_guard", f"WITH {EV} SELECT repo, scope, min(CASE WHEN kind = 'error' THEN place END) AS place FROM ev GROUP BY repo, scope HAVING bool_or(kind = 'error') AND NOT bool_or(kind = 'view')")
def _(spark, d):
    return r.rule_missing_guard(events(spark, d), "error", "view")


@plan("r4_missing_enabler", f"WITH {EV}, u AS (SELECT repo || '/' || scope AS repo, kind, place FROM ev) SELECT repo, min(place) AS place FROM u WHERE kind = 'purchase' AND repo NOT IN (SELECT repo FROM u WHERE kind = 'signup') GROUP BY repo")
def _(spark, d):
    return r.rule_missing_enabler(events(spark, d).withColumn("repo", F.concat_ws("/", "repo", "scope")), "purchase", "signup")


@plan("r5_cooccurrence", f"WITH {EV} SELECT repo, scope FROM ev GROUP BY repo, scope HAVING bool_or(kind = 'error') AND bool_or(kind = 'view') AND NOT bool_or(kind = 'signup')")
def _(spark, d):
    return r.rule_cooccurrence(events(spark, d), ["error", "view"], ["signup"])


@plan("r6_duplicate_key", "SELECT p_type AS scope, p_name AS artifact, count(*) AS n, min(p_partkey) AS first_place, max(p_partkey) AS last_place FROM part GROUP BY p_type, p_name HAVING count(*) > 1")
def _(spark, d):
    return r.rule_duplicate_key(load(spark, d, "part").select(F.col("p_type").alias("scope"), F.col("p_name").alias("artifact"), "p_partkey"), ["artifact"], ["scope"], "p_partkey")


@plan("r7_threshold", "SELECT conv_id, count(*) AS n, count(DISTINCT role) AS owners FROM conversations GROUP BY conv_id HAVING count(*) >= 3 AND count(DISTINCT role) >= 2")
def _(spark, d):
    return r.rule_threshold(load(spark, d, "conversations"), 3, ["conv_id"], "role", 2)


@plan("r8_fact_join", "WITH c AS (SELECT concat(p_name, '/', p_type) AS name, min(p_brand) AS owner FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1), u AS (SELECT l_orderkey, l_linenumber, concat(p_name, '/', p_type) AS name FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT l_orderkey, l_linenumber, name, owner FROM u JOIN c USING (name)")
def _(spark, d):
    part = load(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_name", "p_type").alias("name"), F.col("p_brand").alias("owner"))
    uses = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(part.select("p_partkey", "name"), "p_partkey").drop("p_partkey")
    return r.rule_fact_join(uses, part, ["name"], "owner")


@plan("r9_self_call", """WITH m AS (SELECT l_orderkey AS owner, l_partkey % 50 AS name, 1 AS arity, count(*) AS n, bool_or(l_returnflag = 'R') AS marked, bool_or(l_linestatus = 'F' AND l_tax < 0.01) AS excluded FROM lineitem GROUP BY 1, 2)
SELECT owner, name, arity, l_linenumber AS line FROM (SELECT l_orderkey AS owner, (l_suppkey * 7) % 50 AS name, 1 AS arity, l_linenumber FROM lineitem) c JOIN m USING (owner, name, arity) WHERE n = 1 AND marked AND NOT excluded""")
def _(spark, d):
    li = load(spark, d, "lineitem")
    members = li.select(F.col("l_orderkey").alias("owner"), (F.col("l_partkey") % 50).alias("name"), F.lit(1).alias("arity"), (F.col("l_returnflag") == "R").alias("marked"), ((F.col("l_linestatus") == "F") & (F.col("l_tax") < 0.01)).alias("excluded"))
    calls = li.select(F.col("l_orderkey").alias("owner"), (F.col("l_suppkey") * 7 % 50).alias("name"), F.lit(1).alias("arity"), F.col("l_linenumber").alias("line"))
    return r.rule_self_call(calls, members)


@plan("r13_version", """WITH v AS (SELECT p_partkey AS module, coalesce(CASE WHEN p_size % 3 = 0 THEN concat(p_size % 7, '.0') END, concat(p_size % 5, '.1.0')) AS version, p_size AS platform FROM part)
SELECT module, version, TRY_CAST(string_split(version, '.')[1] AS INT) AS major, platform, CASE TRY_CAST(string_split(version, '.')[1] AS INT) WHEN 3 THEN 17 ELSE 21 END AS needed FROM v WHERE major IN (3, 4) AND platform < needed""")
def _(spark, d):
    part = load(spark, d, "part")
    build = part.select(F.col("p_partkey").alias("module"), F.concat((F.col("p_size") % 5).cast("string"), F.lit(".1.0")).alias("declared_version"), F.col("p_size").alias("platform"))
    resolved = part.where("p_size % 3 = 0").select(F.col("p_partkey").alias("module"), F.concat((F.col("p_size") % 7).cast("string"), F.lit(".0")).alias("resolved_version"))
    return r.rule_version(build, resolved, {3: 17, 4: 21})


PAIR_RULES = [
    {"rule_id": "FRAMEWORK_NEEDS_PLATFORM", "component": "framework", "major": 3, "other": "platform", "least": 17},
    {"rule_id": "THREADS_NEED_PLATFORM", "component": "threads", "other": "platform", "least": 21},
    {"rule_id": "MAPPER_TOO_OLD", "component": "framework", "major": 3, "other": "mapper", "least": 6},
]


@plan("r13_version_pairs", """WITH v AS (SELECT l_orderkey AS module, ['framework', 'threads', 'platform', 'mapper'][1 + l_linenumber % 4] AS component, CASE WHEN l_partkey % 13 = 0 THEN 'x' ELSE concat(CASE l_linenumber % 4 WHEN 0 THEN 2 + l_partkey % 2 WHEN 2 THEN 8 + l_partkey % 17 WHEN 3 THEN 5 + l_partkey % 2 ELSE 1 END, '.', l_suppkey % 3) END AS version, l_returnflag = 'R' AS resolved FROM lineitem),
h AS (SELECT module, component, TRY_CAST(nullif(regexp_extract(version, '^([0-9]+)', 1), '') AS INT) AS major FROM (SELECT *, row_number() OVER (PARTITION BY module, component ORDER BY resolved DESC, TRY_CAST(nullif(regexp_extract(version, '^([0-9]+)', 1), '') AS INT) DESC NULLS LAST) AS rn FROM v) WHERE rn = 1),
t(rule_id, component, needs, other, least) AS (VALUES ('FRAMEWORK_NEEDS_PLATFORM', 'framework', 3, 'platform', 17), ('THREADS_NEED_PLATFORM', 'threads', NULL, 'platform', 21), ('MAPPER_TOO_OLD', 'framework', 3, 'mapper', 6))
SELECT a.module, rule_id, a.major, b.major AS other_major, least FROM h a JOIN t ON a.component = t.component AND (needs IS NULL OR a.major = needs) JOIN h b ON b.module = a.module AND b.component = other WHERE b.major < least""")
def _(spark, d):
    n, part = F.col("l_linenumber") % 4, F.col("l_partkey")
    major = F.when(n == 0, 2 + part % 2).when(n == 2, 8 + part % 17).when(n == 3, 5 + part % 2).otherwise(1)
    version = F.when(part % 13 == 0, "x").otherwise(F.concat(major, F.lit("."), F.col("l_suppkey") % 3))
    component = F.element_at(F.array(*map(F.lit, ("framework", "threads", "platform", "mapper"))), (n + 1).cast("int"))
    return r.rule_version_pair(load(spark, d, "lineitem").select(F.col("l_orderkey").alias("module"), component.alias("component"), version.alias("version"), (F.col("l_returnflag") == "R").alias("resolved")), PAIR_RULES)


@plan("r2_owner_guard", "SELECT conv_id AS path, turn AS line, regexp_extract(text, '[A-Z][a-z]+', 0) AS evidence FROM conversations WHERE regexp_matches(text, '[A-Z][a-z]+') AND role IN ('user', 'system')")
def _(spark, d):
    rows = load(spark, d, "conversations").select(F.lit("c").alias("repo"), F.col("conv_id").alias("path"), F.col("turn").alias("line"), "text", F.col("role").alias("owner"))
    rule = {"rule_id": "NAME", "severity": "INFO", "category": "TEXT", "pattern": "[A-Z][a-z]+", "owner": "^(user|system)$"}
    return r.rule_scan(rows, [rule]).select("path", "line", "evidence")


@plan("r14_presence", "SELECT o_custkey AS repo FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey GROUP BY o_custkey HAVING bool_or(l_orderkey IS NULL) AND NOT bool_or(l_orderkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def _(spark, d):
    filled = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("f", F.lit(1))
    facts = load(spark, d, "orders").join(filled, "o_orderkey", "left").select(F.col("o_custkey").alias("repo"), F.when(F.col("f").isNull(), "empty").when(F.col("o_orderpriority") == "1-URGENT", "urgent").otherwise("filled").alias("kind"))
    return r.rule_presence(facts, ["empty"], ["urgent"])


LINE_RULES, PAIRS, DOMINANCE = ["CARD", "DIGEST", "EMAIL", "TOKEN"], {"net": ["IPV4", "EMAIL"], "law": ["LICENSE", "TOKEN"]}, {"CARD": 80, "DIGEST": 60, "TOKEN": 50}
_NUM = "f AS (SELECT *, path * 1000000 + line * 100 + CASE rule_id WHEN 'EMAIL' THEN 1 WHEN 'IPV4' THEN 2 WHEN 'CARD' THEN 3 WHEN 'DIGEST' THEN 4 WHEN 'LICENSE' THEN 5 WHEN 'TOKEN' THEN 6 ELSE 7 END AS finding_id FROM hits)"


def numbered(spark, d):
    code = F.create_map(*[F.lit(x) for i, rule in enumerate(RULES) for x in (rule["rule_id"], i + 1)])
    return hits(spark, d).withColumn("finding_id", F.col("path") * 1_000_000 + F.col("line") * 100 + code[F.col("rule_id")]).withColumn("target", F.col("repo"))


@plan("f1_merge_overlapping", f"""WITH RECURSIVE {HITS}, {_NUM},
k AS (SELECT finding_id, concat('line', '/', path, '/', line) AS key FROM f WHERE rule_id IN ('CARD', 'DIGEST', 'EMAIL', 'TOKEN') UNION ALL SELECT finding_id, concat('net/', path) FROM f WHERE rule_id IN ('IPV4', 'EMAIL') UNION ALL SELECT finding_id, concat('law/', path) FROM f WHERE rule_id IN ('LICENSE', 'TOKEN')),
e AS (SELECT DISTINCT a.finding_id AS a, b.finding_id AS b FROM k a JOIN k b USING (key)),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
lab AS (SELECT a AS finding_id, min(b) AS label FROM reach GROUP BY a),
g AS (SELECT f.*, coalesce(label, f.finding_id) AS label, CASE rule_id WHEN 'CARD' THEN 80 WHEN 'DIGEST' THEN 60 WHEN 'TOKEN' THEN 50 ELSE 30 END AS dominance FROM f LEFT JOIN lab USING (finding_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dominance DESC, finding_id) AS rn, count(*) OVER (PARTITION BY label) - 1 AS n_signals FROM g)
SELECT finding_id, rule_id, label, CAST(n_signals AS INT) AS n_signals FROM o WHERE rn = 1""")
def _(spark, d):
    return f.merge_overlapping(numbered(spark, d), LINE_RULES, PAIRS, DOMINANCE).select("finding_id", "rule_id", "label", "n_signals")


@plan("f2_suppress", f"WITH {HITS} SELECT repo, path, CAST(line AS INT) AS line, rule_id FROM hits h WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT source, 'EMAIL' AS rule_id FROM documents WHERE doc_id % 3 = 0) x WHERE x.source = h.repo AND x.rule_id = h.rule_id)")
def _(spark, d):
    out = load(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("source").alias("repo"), F.lit("EMAIL").alias("rule_id"))
    return f.suppress(hits(spark, d), out).select("repo", "path", "line", "rule_id")


@plan("f3_rule_config", f"WITH {HITS}, {CAT} SELECT h.repo, h.path, CAST(h.line AS INT) AS line, h.rule_id FROM hits h WHERE rule_id NOT IN (SELECT rule_id FROM cat WHERE NOT enabled) AND severity NOT IN (SELECT severity FROM cat GROUP BY severity HAVING NOT bool_or(enabled))")
def _(spark, d):
    return f.apply_rule_config(hits(spark, d), catalog(spark)).select("repo", "path", "line", "rule_id")


@plan("f4_normalize_severity", "SELECT event_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' WHEN 'view' THEN 'INFO' ELSE 'UNKNOWN' END AS severity_norm, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS severity_rank FROM events")
def _(spark, d):
    raw = F.when(F.col("event_type") == "error", " err").when(F.col("event_type") == "purchase", "Warn ").when(F.col("event_type") == "view", "info").otherwise("odd")
    return f.normalize_severity(load(spark, d, "events").select("event_id", raw.alias("severity"))).select("event_id", "severity_norm", "severity_rank")


@plan("f5_sort_findings", f"WITH {HITS} SELECT repo, path, CAST(line AS INT) AS line, rule_id, CAST(row_number() OVER (PARTITION BY repo ORDER BY path, rule_id, evidence, {RANK} DESC, line) AS INT) AS position FROM hits")
def _(spark, d):
    return f.sort_findings(hits(spark, d).withColumn("message", F.col("evidence"))).select("repo", "path", "line", "rule_id", "position")


@plan("f6_summarize", f"WITH {EV}, u AS (SELECT CAST(c_custkey AS VARCHAR) AS repo, c_custkey % 8 = 0 AS bad FROM customer), g AS (SELECT repo, count(*) AS n, count(*) FILTER (WHERE severity = 'ERROR') AS e, count(*) FILTER (WHERE severity = 'WARNING') AS w, count(*) FILTER (WHERE severity = 'INFO') AS i FROM ev GROUP BY repo) SELECT repo, CAST(sum(CASE WHEN bad THEN 0 ELSE 1 END) AS BIGINT) AS completed, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(coalesce(sum(n), 0) AS BIGINT) AS total, CAST(coalesce(sum(e), 0) AS BIGINT) AS error, CAST(coalesce(sum(w), 0) AS BIGINT) AS warning, CAST(coalesce(sum(i), 0) AS BIGINT) AS info, CAST(0 AS BIGINT) AS unknown FROM u LEFT JOIN g USING (repo) GROUP BY ROLLUP (repo)")
def _(spark, d):
    repos = load(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("repo"), F.when(F.col("c_custkey") % 8 == 0, "FAILED").otherwise("COMPLETED").alias("status"))
    return f.summarize(events(spark, d), repos)


@plan("f7_meets_threshold", f"WITH {EV} SELECT repo, count_if({RANK} >= 2) AS n_at_or_above, count_if({RANK} >= 2) > 0 AS met FROM ev GROUP BY repo")
def _(spark, d):
    return f.meets_threshold(events(spark, d), "warning")


@plan("f8_drop_foreign_paths", r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '/+', '/', 'g') AS rest FROM pages), q AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN rest WHEN 1 THEN concat('.\', replace(rest, '/', '\')) WHEN 2 THEN concat('C:\Work\', replace(rest, '/', '\')) WHEN 3 THEN CASE WHEN page_id % 8 = 7 THEN concat('../../', rest) ELSE concat('a/b/c/d/e/f/../../../x/../../../../', rest) END END AS path, rest FROM p)
SELECT page_id, path FROM q WHERE page_id % 8 = 7 OR NOT (CASE WHEN page_id % 4 = 2 THEN lower(rest) ELSE rest END = 'blog' OR starts_with(CASE WHEN page_id % 4 = 2 THEN lower(rest) ELSE rest END, 'blog/') OR (page_id % 4 = 2 AND (lower(rest) = 'docs' OR starts_with(lower(rest), 'docs/'))))""")
def _(spark, d):
    rest, k = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), "/+", "/"), F.col("page_id") % 4
    back = F.translate(rest, "/", "\\")
    path = F.when(k == 0, rest).when(k == 1, F.concat(F.lit(".\\"), back)).when(k == 2, F.concat(F.lit("C:\\Work\\"), back)).when(F.col("page_id") % 8 == 7, F.concat(F.lit("../../"), rest))
    path = path.otherwise(F.concat(F.lit("a/b/c/d/e/f/../../../x/../../../../"), rest))
    return f.drop_foreign_paths(pages(spark, d).select("page_id", path.alias("path")), "blog", "c:/work", "c:/work/docs")


# Hits with the other fields of a finding, made of their place.
RICH = HITS + """, rich AS (SELECT *, CASE WHEN line % 2 = 0 THEN 'RUNTIME' ELSE 'STATIC' END AS runtime, CASE path % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, concat(' Found  ', rule_id) AS title, CASE path % 5 WHEN 0 THEN 'FooController#get' WHEN 1 THEN 'BarService#run' WHEN 2 THEN concat('X', path % 2, '#parseIt') WHEN 3 THEN 'Y#go' ELSE 'plain' END AS target, evidence AS message, CASE WHEN line % 4 = 1 THEN NULL ELSE rule_id END AS some_rule FROM hits)"""


def rich(spark, d):
    k, line = F.col("path"), F.col("line")
    target = F.when(k % 5 == 0, "FooController#get").when(k % 5 == 1, "BarService#run").when(k % 5 == 2, F.concat(F.lit("X"), k % 2, F.lit("#parseIt"))).when(k % 5 == 3, "Y#go").otherwise("plain")
    confidence = F.when(k % 3 == 0, "HIGH").when(k % 3 == 1, "MEDIUM").otherwise("LOW")
    return hits(spark, d).select("*", F.when(line % 2 == 0, "RUNTIME").otherwise("STATIC").alias("runtime"), confidence.alias("confidence"), F.concat(F.lit(" Found  "), "rule_id").alias("title"), target.alias("target"), F.col("evidence").alias("message"))


def partly_ruled(spark, d):
    return rich(spark, d).withColumn("rule_id", F.when(F.col("line") % 4 != 1, F.col("rule_id")))


@plan("f9_filter_findings", f"WITH {RICH} SELECT repo, path, CAST(line AS INT) AS line, rule_id FROM rich WHERE category IN ('SECURITY') AND runtime = 'STATIC' AND confidence IN ('HIGH', 'LOW') AND severity <> 'INFO' AND contains(lower(concat_ws(' ', message, path, rule_id, title, category, runtime, confidence, target, evidence)), '1')")
def _(spark, d):
    return f.filter_findings(rich(spark, d), category=["SECURITY"], runtime=["STATIC"], confidence=["HIGH", "LOW"], hide_info=True, text="1").select("repo", "path", "line", "rule_id")


@plan("f10_facet_counts", f"WITH {EV} SELECT 'severity' AS facet, severity AS value, count(*) AS n FROM ev GROUP BY severity UNION ALL SELECT 'rule_id', rule_id, count(*) FROM ev GROUP BY rule_id")
def _(spark, d):
    return f.facet_counts(events(spark, d), ["severity", "rule_id"])


_STATUS = "CASE WHEN quality = 1 AND toxic = 0 THEN 'FIXED' WHEN quality = 1 THEN 'ACCEPTED_RISK' WHEN toxic = 1 THEN 'FALSE_POSITIVE' ELSE 'odd' END"
_ONE_KEY = "concat_ws(':', 'finding', coalesce(some_rule, lower(trim(regexp_replace(title, '\\s+', ' ', 'g')))), lower(target), CAST(path AS VARCHAR), sha256(coalesce(nullif(message, ''), title)))"
_GROUP_KEY = "concat('group:', coalesce(some_rule, lower(trim(regexp_replace(title, '\\s+', ' ', 'g')))))"


@plan("f11_join_triage", f"""WITH {RICH}, r AS (SELECT *, {_ONE_KEY} AS triage_key FROM rich), t AS (SELECT triage_key, arg_min({_STATUS}, doc_id) AS status FROM r JOIN labels ON path = doc_id GROUP BY triage_key)
SELECT repo, path, CAST(line AS INT) AS line, some_rule AS rule_id, r.triage_key, CASE WHEN status <> 'odd' THEN status ELSE 'OPEN' END AS status FROM r LEFT JOIN t USING (triage_key)""")
def _(spark, d):
    found = partly_ruled(spark, d)
    labelled = found.withColumn("key", f.triage_key(False)).join(load(spark, d, "labels").select(F.col("doc_id").alias("path"), F.expr(_STATUS).alias("status")), "path")
    triage = labelled.groupBy("key").agg(F.min_by("status", "path").alias("status"))
    return f.join_triage(found, triage).select("repo", "path", "line", "rule_id", "triage_key", "status")


@plan("f11_grouped_keys", f"WITH {RICH} SELECT {_GROUP_KEY} AS triage_key, count(*) AS n FROM rich GROUP BY 1")
def _(spark, d):
    return partly_ruled(spark, d).select(f.triage_key(True).alias("triage_key")).groupBy("triage_key").agg(F.count("*").alias("n"))


_CONF = "CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"
_KIND = "CASE path % 5 WHEN 0 THEN 'controller' WHEN 1 THEN 'service' WHEN 2 THEN 'parser-helper' WHEN 3 THEN 'method' ELSE 'general' END"
_FIRST = f"(-({RANK}), -({_CONF}), repo, path, line, title)"
_AGGS = f"count(*) AS occurrences, CASE WHEN count(DISTINCT target) > 1 THEN 'Multiple targets' ELSE min(target) END AS target, arg_min(title, {_FIRST}) AS first_title, arg_min(category, {_FIRST}) AS first_category, arg_min(repo, {_FIRST}) AS first_repo, arg_min(path, {_FIRST}) AS first_path, CAST(arg_min(line, {_FIRST}) AS INT) AS first_line, max({RANK}) AS worst_rank, arg_min({_CONF}, {_FIRST}) AS confidence_rank FROM rich"


@plan("f12_group_findings", f"WITH {RICH} SELECT some_rule AS rule_id, category, runtime, {_KIND} AS target_kind, lower(trim(regexp_replace(rich.title, '\\s+', ' ', 'g'))) AS title, {_AGGS} GROUP BY 1, 2, 3, 4, 5")
def _(spark, d):
    return f.group_findings(partly_ruled(spark, d))


@plan("f13_top_concerns", f"WITH {RICH}, g AS (SELECT coalesce(some_rule, lower(trim(regexp_replace(rich.title, '\\s+', ' ', 'g')))) AS concern, {_AGGS} GROUP BY 1), q AS (SELECT *, CASE concern WHEN 'DIGEST' THEN 1 WHEN 'EMAIL' THEN 2 ELSE CASE first_category WHEN 'CONFIGURATION' THEN 3 ELSE 20 END END AS priority FROM g WHERE worst_rank >= 2) SELECT * FROM q ORDER BY priority, worst_rank DESC, occurrences DESC, confidence_rank DESC, first_title, concern LIMIT 5")
def _(spark, d):
    return f.top_concerns(partly_ruled(spark, d), {"DIGEST": 1, "EMAIL": 2}, 5, {"CONFIGURATION": 3})


@plan("f14_collect_occurrences", f"WITH {HITS}, a AS (SELECT repo, rule_id, count(*) AS occurrences, min(path) AS first_path, CAST(arg_min(line, (path, line)) AS INT) AS first_line FROM hits GROUP BY repo, rule_id) SELECT repo, rule_id, path, string_agg(line, ',' ORDER BY line) AS lines, a.occurrences, a.first_path, a.first_line FROM hits JOIN a USING (repo, rule_id) GROUP BY ALL")
def _(spark, d):
    return f.collect_occurrences(hits(spark, d)).withColumn("lines", F.concat_ws(",", F.col("lines").cast("array<string>")))


@plan("f15_snippets", f"WITH {HITS}, w AS (SELECT h.repo, h.path, h.line AS hit, h.rule_id, unnest(range(greatest(h.line - 2, 1), h.line + 3)) AS line FROM hits h) SELECT w.repo, w.path, CAST(w.line AS INT) AS line, CAST(hit AS INT) AS hit, rule_id, text, w.line = hit AS highlight FROM w JOIN lines USING (repo, path, line)")
def _(spark, d):
    return f.snippets(hits(spark, d), lines(spark, d), 2, 20)


@plan("f15_redacted_snippets", f"WITH {HITS}, w AS (SELECT h.repo, h.path, h.line AS hit, h.rule_id, unnest(range(greatest(h.line - 1, 1), h.line + 2)) AS line FROM hits h), t AS (SELECT w.*, text, regexp_extract(text, '^([^=:]*)[=:]', 1) AS k FROM w JOIN lines USING (repo, path, line)) SELECT repo, concat(path, '.properties') AS path, CAST(line AS INT) AS line, CAST(hit AS INT) AS hit, rule_id, CASE WHEN regexp_matches(lower(k), 'password|secret|credential|(^|[^a-z])pat([^a-z]|$)|[.-]token *$') AND NOT starts_with(trim(text), '#') THEN concat(regexp_extract(text, '^([^=:]*[=:]\\s*)', 1), '[redacted]') ELSE text END AS text FROM t")
def _(spark, d):
    """Hits in the documents as if these were property files, their lines marked with the names of secrets by the rules."""
    name = lambda df: df.withColumn("path", F.concat(F.col("path").cast("string"), F.lit(".properties")))
    return f.snippets(name(hits(spark, d)), name(lines(spark, d)), 1, 20).select("repo", "path", "line", "hit", "rule_id", "text")


@plan("f16_permalinks", f"WITH {HITS} SELECT repo, path, CAST(line AS INT) AS line, rule_id, CASE WHEN repo <> 'src3' THEN concat('https://github.com/org/', repo, '/blob/abc/', path, '#L', line) END AS link FROM hits")
def _(spark, d):
    repos = load(spark, d, "documents").select(F.col("source").alias("repo")).distinct().select("repo", F.when(F.col("repo") == "src3", "https://example.org/x.git").otherwise(F.concat(F.lit("git@github.com:org/"), "repo", F.lit(".git"))).alias("remote"), F.lit("abc").alias("head"))
    h = hits(spark, d).withColumn("path", F.col("path").cast("string")).withColumn("end_line", F.col("line"))
    return f.permalinks(h, repos).select("repo", F.col("path").cast("long").alias("path"), "line", "rule_id", "link")


FIXES = {"EMAIL": "Remove the address", "CARD": "Mask the number", "PASSWORD": "Move it to the vault"}


@plan("f17_review_plan", f"WITH {RICH} SELECT repo, path, CAST(line AS INT) AS line, rule_id, category, target, CASE rule_id WHEN 'EMAIL' THEN 'Remove the address' WHEN 'CARD' THEN 'Mask the number' WHEN 'PASSWORD' THEN 'Move it to the vault' END AS fix, CAST(row_number() OVER (PARTITION BY repo ORDER BY {RANK} DESC, rule_id, path, line) AS INT) AS step FROM rich WHERE severity <> 'INFO' AND path % 4 <> 0")
def _(spark, d):
    catalog = spark.createDataFrame(list(FIXES.items()), "rule_id string, fix string")
    found = f.filter_findings(rich(spark, d), hide_info=True).withColumn("status", F.when(F.col("path") % 4 == 0, "FIXED").otherwise("OPEN"))
    return f.review_plan(found, catalog).select("repo", "path", "line", "rule_id", "category", "target", "fix", "step")


@plan("f18_enrich_findings", f"WITH {HITS}, {CAT} SELECT h.repo, h.path, CAST(h.line AS INT) AS line, h.rule_id, cat.title, CASE WHEN h.line % 2 = 0 THEN 'ERROR' ELSE cat.severity END AS severity, cat.category, concat(lower(cat.severity), ' at run time') AS runtime FROM hits h LEFT JOIN cat USING (rule_id)")
def _(spark, d):
    h = hits(spark, d).select("repo", "path", "line", "rule_id", F.when(F.col("line") % 2 == 0, "ERROR").alias("severity"), F.lit(None).cast("string").alias("category"))
    known = catalog(spark).withColumn("runtime", F.concat(F.lower("severity"), F.lit(" at run time")))
    return f.enrich_findings(h, known).select("repo", "path", "line", "rule_id", "title", "severity", "category", "runtime")


_PLACE = "physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>"
_RESULT = f"struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<{_PLACE}>>,relatedLocations:array<struct<id:int,message:struct<text:string>,{_PLACE}>>>"
_DOC = f"struct<version:string,runs:array<struct<tool:struct<driver:struct<rules:array<struct<id:string,name:string>>>>,results:array<{_RESULT}>>>>"


@plan("s9_sarif_export", f"""WITH {HITS}, o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, rule_id, line, evidence) - 1 AS pos FROM hits), p AS (SELECT *, pos // 20 AS part FROM o), n AS (SELECT repo, part, count(DISTINCT coalesce(CASE WHEN line % 5 <> 0 THEN rule_id END, 'UNKNOWN')) AS n_rules FROM p GROUP BY repo, part)
SELECT p.repo, p.part, CAST(n_rules AS INT) AS n_rules, CASE WHEN line % 5 <> 0 THEN rule_id ELSE 'UNKNOWN' END AS rule_id, CASE severity WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' ELSE 'note' END AS level, evidence AS message, CASE WHEN path % 6 <> 0 THEN CAST(path AS VARCHAR) END AS uri, CASE WHEN path % 6 <> 0 AND line % 7 <> 0 THEN CAST(line AS INT) END AS start, CASE WHEN line % 2 = 0 THEN concat('1:also:', path, ' ') ELSE '' END AS related FROM p JOIN n USING (repo, part)""")
def _(spark, d):
    """The documents read again, one row a result."""
    k, line = F.col("path"), F.col("line")
    related = F.array(F.struct(F.when(line % 2 == 0, k).alias("path"), line.alias("line"), F.lit("also").alias("message")))
    found = hits(spark, d).select("repo", "rule_id", "severity", "category", k, line, F.col("evidence").alias("message"), related.alias("related"))
    order = f.numbered(found, "at", ["repo"], [k, F.col("rule_id"), line, F.col("message")])
    shown = order.select("repo", F.floor((F.col("at") - 1) / 20).alias("_part"), F.when(line % 5 != 0, F.col("rule_id")).alias("rule_id"), "severity", F.when(k % 6 != 0, k).alias("path"), F.when(line % 7 != 0, line).otherwise(0).alias("line"), F.concat_ws("\t", F.lpad(F.col("at").cast("string"), 9, "0"), "message").alias("message"), "related")
    parts = f.sarif_export(shown.withColumn("repo", F.concat_ws("\t", "repo", F.col("_part").cast("string"))), 1 << 30)
    rows = parts.select("repo", "n_rules", F.explode(F.from_json("document", _DOC)["runs"][0]["results"]).alias("x"))
    named = F.split("repo", "\t")
    place = F.col("x.locations")[0]["physicalLocation"]
    sites = F.concat_ws("", F.transform("x.relatedLocations", lambda y: F.concat(y["id"].cast("string"), F.lit(":"), y["message"]["text"], F.lit(":"), y["physicalLocation"]["artifactLocation"]["uri"], F.lit(" "))))
    return rows.select(named[0].alias("repo"), named[1].cast("long").alias("part"), "n_rules", F.col("x.ruleId").alias("rule_id"), F.col("x.level").alias("level"), F.split("x.message.text", "\t")[1].alias("message"), place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("start"), sites.alias("related"))


@plan("s9_sarif_parts", f"WITH {HITS}, o AS (SELECT *, (row_number() OVER (PARTITION BY repo ORDER BY path, rule_id, line, evidence) - 1) // 25 AS part FROM hits) SELECT repo, part, CAST(count(DISTINCT rule_id) AS INT) AS n_rules, CAST(count(*) AS INT) AS n_results, min(path) AS first_path FROM o GROUP BY repo, part")
def _(spark, d):
    found = f.sarif_export(hits(spark, d).withColumn("message", F.col("evidence")), 25)
    first = F.from_json("document", _DOC)["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"]
    return found.select("repo", "part", "n_rules", "n_results", first.cast("long").alias("first_path"))


_FLAG = f"""WITH {HITS}, kept AS (SELECT * FROM hits WHERE NOT (rule_id = 'LICENSE' AND repo IN (SELECT source FROM documents WHERE doc_id % 7 = 0))), s AS (SELECT DISTINCT source AS repo FROM documents), g AS (SELECT repo, count(*) AS n, count(*) FILTER (WHERE severity = 'ERROR') AS e, count(*) FILTER (WHERE severity = 'WARNING') AS w, count(*) FILTER (WHERE severity = 'INFO') AS i FROM kept GROUP BY repo)
SELECT repo, count(*) AS completed, CAST(0 AS BIGINT) AS failed, CAST(coalesce(sum(n), 0) AS BIGINT) AS total, CAST(coalesce(sum(e), 0) AS BIGINT) AS error, CAST(coalesce(sum(w), 0) AS BIGINT) AS warning, CAST(coalesce(sum(i), 0) AS BIGINT) AS info, CAST(0 AS BIGINT) AS unknown FROM s LEFT JOIN g USING (repo) GROUP BY ROLLUP (repo)"""


@plan("audit_by_source", _FLAG)
def audit_by_source(spark, d):
    """Findings per source by severity, after suppression."""
    out = load(spark, d, "documents").where("doc_id % 7 = 0").select(F.col("source").alias("repo"), F.lit("LICENSE").alias("rule_id"))
    found = f.enrich_findings(hits(spark, d), r.rule_catalog(spark, CATALOG).withColumn("runtime", F.lit(None).cast("string")))
    return f.summarize(f.suppress(found, out), files(spark, d).select("repo").distinct())
