"""Queries over facts, JSON, URLs, manifests and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusmill.functions.storage import shared_dir
from corpusmill.operators import facts as e
from corpusmill.operators import incremental as i
from corpusmill.operators import rules as r
from corpusmill.operators import surface as h
from corpusmill.plans.bindings import EV, HITS, LINES, RULES, TAGS, closure_sql, edges, events, files, hits, lines, load, pages, plan
from corpusmill.sources import files as s
from corpusmill.operators.graph import dependency_closure
from corpusmill.streaming.audit import CHANGE, run_available, run_changes, severity_windows, stream_audit


def tags(spark, d):
    rows = pages(spark, d).select(F.lit("web").alias("repo"), F.col("page_id").alias("path"), F.lit(1).alias("line"), F.col("html").alias("text"))
    return e.extract_facts(rows, {"tag": "<([a-z0-9]+)"})


@plan("s4_flatten_json", "WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS u, event_type AS t, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events) SELECT event_id, 'k' AS key, k AS value FROM e WHERE event_id % 9 <> 0 UNION ALL SELECT event_id, 'a.b[0]', u FROM e WHERE event_id % 9 <> 0 UNION ALL SELECT event_id, 'a.b[1].c', t FROM e WHERE event_id % 9 <> 0 UNION ALL SELECT event_id, 'a.d.e.f.g.h.i', 'deep' FROM e WHERE event_id % 9 <> 0 UNION ALL SELECT event_id, 'a.n', '' FROM e WHERE event_id % 9 <> 0 UNION ALL SELECT event_id, NULL, NULL FROM e WHERE event_id % 9 = 0")
def _(spark, d):
    text = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "a": {"b": ['), F.col("user_id"), F.lit(', {"c": "'), "event_type", F.lit('"}], "d": {"e": {"f": {"g": {"h": {"i": "deep"}}}}}, "n": null, "o": {}}}'))
    text = F.when(F.col("event_id") % 9 == 0, "{broken").otherwise(text)
    return e.flatten_json(load(spark, d, "events").select("event_id", text.alias("j")), "j").select("event_id", "key", "value")


@plan("s4_document_profile", "SELECT event_id, 'x' AS key, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'legacy' ELSE concat('file', user_id % 3) END AS profile FROM events")
def _(spark, d):
    k = F.col("event_id") % 4
    guard = F.when(k == 0, F.concat(F.lit(', "spring": {"profiles": "no", "config": {"activate": {"on-profile": " '), "event_type", F.lit(' , other"}}}'))).when(k == 1, F.lit(', "spring": {"profiles": "legacy", "config": {"activate": {"on-profile": " "}}}')).when(k == 2, F.lit(', "spring": {"profiles": ", y"}')).otherwise("")
    rows = load(spark, d, "events").select("event_id", F.concat(F.lit("file"), F.col("user_id") % 3).alias("file_profile"), F.concat(F.lit('{"x": 1'), guard, F.lit("}")).alias("j"))
    flat = e.flatten_json(rows, "j")
    return e.document_profile(flat, ["event_id"], "file_profile").where("key = 'x'").select("event_id", "key", "profile")


@plan("s5_extract_findings", f"WITH {EV} SELECT repo, severity, rule_id, CAST(event_id AS VARCHAR) AS path, scope AS message FROM ev WHERE event_id % 8 <> 7")
def _(spark, d):
    k, n = F.col("event_id") % 3, F.col("event_id")
    rule = F.when(k == 0, F.concat(F.lit('"rule":{"id":"'), "rule_id", F.lit('"}'))).when(k == 1, F.concat(F.lit('"ruleId":"'), "rule_id", F.lit('"'))).otherwise(F.concat(F.lit('"ruleId":"","rule":"'), "rule_id", F.lit('"')))
    path = F.when(n % 2 == 0, F.concat(F.lit('"primaryLocation":{"sourceFile":"'), n, F.lit('"}'))).otherwise(F.concat(F.lit('"location":{"x":1},"path":"'), n, F.lit('"')))
    one = F.concat(F.lit('{"'), F.when(k == 0, "severity").otherwise("level"), F.lit('":"'), "severity", F.lit('",'), rule, F.lit(","), path, F.lit(',"title":"'), "scope", F.lit('"}'))
    text = F.when(k == 0, F.concat(F.lit("[1, "), one, F.lit("]"))).when(k == 1, F.concat(F.lit('{"findings":['), one, F.lit("]}"))).when(n % 2 == 0, F.concat(F.lit('{"result":['), one, F.lit("]}"))).otherwise(F.concat(F.lit('{"result":{"findings":['), one, F.lit("]}}")))
    return e.extract_findings(events(spark, d).select("repo", F.when(n % 8 == 7, "{oops").otherwise(text).alias("result")))


@plan("s5_malformed_results", "SELECT event_id FROM events WHERE event_id % 8 = 7")
def _(spark, d):
    text = F.when(F.col("event_id") % 8 == 7, "{oops").when(F.col("event_id") % 8 == 6, " ").otherwise("{}")
    return e.malformed_results(load(spark, d, "events").select("event_id", text.alias("result"))).select("event_id")


@plan("s6_metadata_catalog", """WITH x AS (SELECT lower(p_type) AS name, p_partkey, 1 AS pos, p_brand AS type, p_size < 10 AS dep, p_name AS reason FROM part UNION ALL SELECT lower(p_brand), p_partkey, 2, 'a', false, NULL FROM part UNION ALL SELECT lower(p_brand), p_partkey, 3, 'b', false, NULL FROM part),
h AS (SELECT lower(p_type) AS name, array_to_string(list_sort(list_distinct(list(CAST(p_size % 7 AS VARCHAR)))), ',') AS hints FROM part WHERE p_size % 2 = 0 GROUP BY 1)
SELECT x.name, arg_max(type, (p_partkey, pos)) AS type, arg_max(dep, (p_partkey, pos)) AS deprecated, CASE WHEN arg_max(dep, (p_partkey, pos)) THEN arg_max(reason, (p_partkey, pos)) END AS reason, any_value(hints) AS hints FROM x LEFT JOIN h USING (name) GROUP BY x.name""")
def _(spark, d):
    dep = F.when(F.col("p_size") < 10, F.concat(F.lit(',"deprecation":{"reason":"'), "p_name", F.lit('"}'))).otherwise("")
    own = F.concat(F.lit('},{"name":"'), "p_brand", F.lit('","type":"a"},{"name":"'), "p_brand", F.lit('","type":"b"}]'))
    hints = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(',"hints":[{"name":"'), "p_type", F.lit('","values":[{"value":"'), F.col("p_size") % 7, F.lit('"}]}]'))).otherwise("")
    text = F.concat(F.lit('{"properties":[{"name":"'), "p_type", F.lit('","type":"'), "p_brand", F.lit('"'), dep, own, hints, F.lit("}"))
    return e.metadata_catalog(load(spark, d, "part").select(F.col("p_partkey").alias("rank"), text.alias("json"))).withColumn("hints", F.array_join("hints", ","))


@plan("s7_build_model_tables", """WITH b AS (SELECT event_id AS e, CAST(user_id AS VARCHAR) AS u, event_type AS t, value FROM events WHERE value IS NOT NULL)
SELECT 'projects' AS tbl, e, concat_ws('|', ':', u, t) AS item FROM b UNION ALL SELECT 'plugins', e, concat_ws('|', ':', t, u) FROM b UNION ALL SELECT 'repositories', e, concat_ws('|', ':', t, 'maven', u) FROM b
UNION ALL SELECT 'configurations', e, concat_ws('|', ':', t, value > 50, value <= 50, e % 9, 'x,y') FROM b UNION ALL SELECT 'declared', e, concat_ws('|', ':', t, 'g', u, '1', 'n') FROM b UNION ALL SELECT 'resolved', e, concat_ws('|', ':', t, 'g', u, '2', value > 50, 'why') FROM b UNION ALL SELECT 'resolved', e, concat_ws('|', ':', t, 'h', u, '3', false) FROM b
UNION ALL SELECT 'results', e, concat_ws('|', ':', t, true, value > 50, false, 'E', 'm', e % 5) FROM b UNION ALL SELECT 'conflicts', e, concat_ws('|', ':', t, 'g', u, '1,2', '2') FROM b UNION ALL SELECT 'source_sets', e, concat_ws('|', ':', t, 'src', u) FROM b UNION ALL SELECT 'tasks', e, concat_ws('|', ':', t, 'build', u) FROM b UNION ALL SELECT 'toolchains', e, concat_ws('|', ':', '17', t, u) FROM b""")
def _(spark, d):
    """Reports with items for every table; all tables' rows, the fields of each in order."""
    t, u, big = F.col("event_type"), F.col("user_id"), F.col("value") > 50
    flag = lambda c: c.cast("string")
    p = '"projectPath":":",'
    parts = [
        '{"projects":[{"path":":","name":"', u, '","projectDir":"', t, '"}],"plugins":[{' + p + '"pluginId":"', t, '","implementationClass":"', u, '"}],"repositories":[{' + p + '"name":"', t, '","type":"maven","url":"', u,
        '"}],"configurations":[{' + p + '"name":"', t, '","resolvable":', flag(big), ',"consumable":', flag(~big), ',"dependencyCount":', F.col("event_id") % 9, ',"extendsFrom":["x","y"]}],"declaredDependencies":[{' + p + '"configuration":"', t, '","group":"g","artifact":"', u,
        '","version":"1","notation":"n"}],"resolvedDependencies":[{' + p + '"configuration":"', t, '","group":"g","artifact":"', u, '","version":"2","direct":', flag(big), ',"selectedReason":"why"},{' + p + '"configuration":"', t, '","group":"h","artifact":"', u,
        '","version":"3","direct":false}],"resolutionResults":[{' + p + '"configuration":"', t, '","attempted":true,"successful":', flag(big), ',"fallbackUsed":false,"errorType":"E","errorMessage":"m","resolvedDependencyCount":', F.col("event_id") % 5,
        '}],"dependencyConflicts":[{' + p + '"configuration":"', t, '","group":"g","artifact":"', u, '","requestedVersions":["1","2"],"selectedVersion":"2"}],"sourceSets":[{' + p + '"name":"', t, '","javaDirs":["src"],"resourceDirs":["', u,
        '"]}],"tasks":[{' + p + '"name":"', t, '","group":"build","description":"', u, '"}],"javaToolchains":[{' + p + '"languageVersion":"17","vendor":"', t, '","implementation":"', u, '"}]}',
    ]
    text = F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    tables = e.build_model_tables(load(spark, d, "events").where("value is not null").select(F.col("event_id").alias("repo"), text.alias("json")))
    out = None
    for name, table in tables.items():
        fields = [F.array_join(c, ",") if k.startswith("array") else F.col(c).cast("string") for c, k in table.dtypes if c != "repo"]
        one = table.select(F.lit(name).alias("tbl"), F.col("repo").alias("e"), F.concat_ws("|", *fields).alias("item"))
        out = one if out is None else out.unionByName(one)
    return out


@plan("e1_extract_facts", """WITH l AS (SELECT conv_id, turn, regexp_extract(text, '^([A-Z][a-z]+)', 1) AS h, regexp_extract_all(text, '([A-Z][a-z]+)', 1) AS w FROM conversations), f AS (SELECT conv_id AS path, turn AS line, unnest(range(len(list_concat(CASE WHEN h <> '' THEN [h] ELSE [] END, w)))) AS seq, unnest(list_concat(CASE WHEN h <> '' THEN [concat('head:', h)] ELSE [] END, w)) AS kn FROM l)
SELECT path, line, seq, CASE WHEN starts_with(kn, 'head:') THEN 'head' ELSE 'name' END AS kind, replace(kn, 'head:', '') AS name, last_value(CASE WHEN starts_with(kn, 'head:') THEN replace(kn, 'head:', '') END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line, seq ROWS UNBOUNDED PRECEDING) AS owner FROM f""")
def _(spark, d):
    """Words with a capital; one that begins a turn owns what follows, up to the next of its kind."""
    conv = load(spark, d, "conversations").select(F.lit("c").alias("repo"), F.col("conv_id").alias("path"), F.col("turn").alias("line"), "text")
    facts = e.extract_facts(conv, {"head": "^([A-Z][a-z]+)", "name": "([A-Z][a-z]+)"}, "head")
    return facts.select("path", "line", F.col("seq").cast("long").alias("seq"), "kind", "name", "owner")


@plan("e2_component_inventory", """WITH t AS (SELECT page_id, unnest(range(len(w))) AS seq, unnest(w) AS name FROM (SELECT page_id, regexp_extract_all(html, '<([a-z0-9]+)', 1) AS w FROM pages)), g AS (SELECT page_id % 3 AS path, page_id // 3 AS owner, name, min((page_id, seq)) AS spot FROM t GROUP BY 1, 2, 3),
a AS (SELECT path, owner, list(name ORDER BY spot) AS l FROM g GROUP BY path, owner) SELECT path, owner, array_to_string(l, ',') AS annotations, CASE WHEN list_contains(l, 'table') THEN 'table' ELSE [x FOR x IN l IF x IN ('nav', 'div', 'p', 'span')][1] END AS type FROM a WHERE type IS NOT NULL""")
def _(spark, d):
    """Tags of a page as its owner's annotations, in order of place."""
    rows = tags(spark, d).select("repo", (F.col("path") % 3).alias("path"), F.floor(F.col("path") / 3).alias("owner"), F.col("path").alias("line"), "seq", "name")
    found = e.component_inventory(rows, ["span", "nav", "div", "p"], "table")
    return found.select("path", "owner", F.array_join("annotations", ",").alias("annotations"), "type")


@plan("e3_endpoint_paths", "WITH c AS (SELECT DISTINCT page_id % 50 AS owner, concat('/api/', page_id % 50, '/') AS cp FROM pages WHERE page_id % 50 < 40), m AS (SELECT page_id AS method, page_id % 50 AS owner, regexp_replace(url, '^[a-z]+://[^/]*', '') AS mp FROM pages) SELECT owner, method, CASE WHEN j = '/' THEN j ELSE regexp_replace(j, '/$', '') END AS endpoint FROM (SELECT m.owner, method, regexp_replace(concat('/', coalesce(cp, ''), '/', coalesce(mp, '')), '/+', '/', 'g') AS j FROM m LEFT JOIN c ON m.owner = c.owner)")
def _(spark, d):
    p = pages(spark, d)
    owner = (F.col("page_id") % 50).alias("owner")
    classes = p.where("page_id % 50 < 40").select(owner, F.concat(F.lit("/api/"), F.col("page_id") % 50, F.lit("/")).alias("class_path")).distinct()
    return e.endpoint_paths(classes, p.select(F.col("page_id").alias("method"), owner, F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("method_path")))


@plan("e4_listener_inventory", "SELECT CAST(user_id AS VARCHAR) AS repo, event_id AS listener, event_type AS broker, CASE WHEN event_id % 3 = 0 THEN concat('g', user_id) END AS group_id, unnest(CASE WHEN event_id % 4 = 0 THEN [NULL] WHEN event_id % 4 = 2 THEN ['a', event_type, 'b'] ELSE [event_type] END) AS destination FROM events")
def _(spark, d):
    k, q = F.col("event_id"), F.lit('"')
    dest = F.when(k % 4 == 0, "").when(k % 4 == 2, F.concat(F.lit('topics = {"a , '), "event_type", F.lit('", "b"}'))).when(k % 4 == 1, F.concat(F.lit("queues="), q, "event_type", q)).otherwise(F.concat(F.lit("destination = "), q, "event_type", q))
    group = F.when(k % 3 == 0, F.concat(F.lit(', groupId = "g'), "user_id", q)).otherwise("")
    return e.listener_inventory(load(spark, d, "events").select(F.col("user_id").cast("string").alias("repo"), k.alias("listener"), F.col("event_type").alias("broker"), F.concat(F.lit("("), dest, group, F.lit(")")).alias("attributes")))


@plan("e5_schedule_inventory", f"WITH {EV}, o AS (SELECT repo, bool_or(kind = 'signup') AS s, bool_or(kind = 'error') AS a FROM ev GROUP BY repo) SELECT repo, event_id AS member, CASE WHEN kind = 'click' THEN 'async' ELSE CASE event_id % 4 WHEN 0 THEN 'cron' WHEN 1 THEN 'fixedRate' WHEN 2 THEN 'fixedDelay' ELSE 'none' END END AS trigger, CASE WHEN kind = 'view' AND event_id % 4 < 3 THEN CASE WHEN event_id % 4 = 0 THEN concat('0 0 ', event_id % 100, ' * * *') ELSE CAST(event_id % 100 AS VARCHAR) END END AS trigger_value, CASE WHEN kind = 'view' AND event_id % 4 = 0 AND event_id % 3 = 0 THEN 'UTC' END AS zone, CASE WHEN kind = 'click' THEN a ELSE s END AS enabled FROM ev JOIN o USING (repo) WHERE kind IN ('view', 'click')")
def _(spark, d):
    k, n = F.col("event_id") % 4, F.col("event_id") % 100
    zone = F.when(F.col("event_id") % 3 == 0, ', zone = "UTC"').otherwise("")
    value = F.when(k == 0, F.concat(F.lit('(cron = "0 0 '), n, F.lit(' * * *"'), zone, F.lit(")"))).when(k == 1, F.concat(F.lit("(fixedRate="), n, F.lit(")"))).when(k == 2, F.concat(F.lit('(initialDelay = 5, fixedDelayString = "'), n, F.lit('")'))).otherwise("(5)")
    names = F.create_map(*[F.lit(x) for x in ("view", "schedule", "signup", "enable", "error", "enable_async", "click", "async")])
    return e.schedule_inventory(events(spark, d).select("repo", F.col("event_id").alias("member"), F.coalesce(names[F.col("kind")], F.lit("other")).alias("kind"), value.alias("value")))


@plan("e6_property_references", """SELECT p_partkey AS path, 'VALUE' AS type, p_brand AS name, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS default_value, NULL AS expected_value, NULL AS match_if_missing, p_size % 2 <> 0 AS required FROM part
UNION ALL SELECT p_partkey, 'LOOKUP', p_name, CASE WHEN p_size % 3 = 0 THEN 'dv' END, NULL, NULL, p_size % 3 <> 0 FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT p_partkey, 'LOOKUP', 'APP_HOME', NULL, NULL, NULL, true FROM part
UNION ALL SELECT p_partkey, 'CONDITION', concat('app.', p_size), NULL, CASE WHEN p_size % 2 = 0 THEN p_brand END, p_size % 5 = 0, p_size % 5 <> 0 FROM part""")
def _(spark, d):
    size = F.col("p_size")
    value = F.concat(F.lit("x ${"), "p_brand", F.when(size % 2 == 0, F.concat(F.lit(":"), size)).otherwise(""), F.lit("} y "))
    name = F.when(F.col("p_partkey") % 4 == 0, "java.io.tmpdir").otherwise(F.col("p_name"))
    look = F.concat(F.lit('env.getProperty("'), name, F.when(size % 3 == 0, '", "dv").trim()').otherwise('")'), F.lit(' + System.getenv("APP_HOME") '))
    cond = F.concat(F.lit('@ConditionalOnProperty(prefix = "app.", name = "'), size, F.lit('"'), F.when(size % 2 == 0, F.concat(F.lit(', havingValue = "'), "p_brand", F.lit('"'))).otherwise(""), F.when(size % 5 == 0, ", matchIfMissing = true").otherwise(""), F.lit(")"))
    rows = load(spark, d, "part").select(F.lit("r").alias("repo"), F.col("p_partkey").alias("path"), F.lit(1).alias("line"), F.concat(value, look, cond).alias("text"))
    return e.property_references(rows).select("path", "type", "name", "default_value", "expected_value", "match_if_missing", "required")


@plan("e8_pick_version", "SELECT p_partkey % 100 AS module, arg_max(CAST(p_size AS VARCHAR), (CASE p_size % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END, -p_partkey)) AS version FROM part GROUP BY 1")
def _(spark, d):
    conf = F.when(F.col("p_size") % 3 == 0, "HIGH").when(F.col("p_size") % 3 == 1, "MEDIUM").otherwise("LOW")
    return e.pick_version(load(spark, d, "part").select((F.col("p_partkey") % 100).alias("module"), F.col("p_partkey").alias("seq"), conf.alias("confidence"), F.col("p_size").cast("string").alias("version"))).select("module", "version")


@plan("e9_module_of_path", "WITH f AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), m AS (SELECT DISTINCT string_split(path, '/')[1] AS rel FROM f WHERE page_id % 2 = 0), u AS (SELECT DISTINCT path, array_to_string(string_split(path, '/')[1:i], '/') AS rel FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM f)), b AS (SELECT path, arg_max(rel, length(rel)) AS module FROM u JOIN m USING (rel) GROUP BY path) SELECT f.path, coalesce(module, '') AS module FROM f LEFT JOIN b USING (path)")
def _(spark, d):
    f = pages(spark, d).select(F.lit("web").alias("repo"), "page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    modules = f.where("page_id % 2 = 0").select("repo", F.split("path", "/")[0].alias("rel_path")).distinct()
    return s.module_of_path(f, modules).select("path", "module")


_HOST = "nullif(regexp_replace(regexp_replace(string_split(regexp_extract(url, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), ',')[1], '^[^@]*@', ''), ':[0-9]+$', ''), '')"
_BASE = "nullif(regexp_extract(url, '^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1), '')"


@plan("h1_classify_urls", "WITH v AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN concat('jdbc:', url) WHEN 2 THEN concat('${x', page_id, '}') WHEN 3 THEN replace(replace(url, 'https:', 'redis:'), 'http:', 'redis:') ELSE 'plain' END AS value FROM pages) SELECT page_id, CASE WHEN starts_with(value, '${') THEN 'PROPERTY_REFERENCE' WHEN starts_with(value, 'jdbc:') THEN 'JDBC' WHEN starts_with(value, 'http') THEN 'HTTP' ELSE 'REDIS' END AS url_kind FROM v WHERE value <> 'plain'")
def _(spark, d):
    k = F.col("page_id") % 5
    value = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("jdbc:"), "url")).when(k == 2, F.concat(F.lit("${x"), "page_id", F.lit("}"))).when(k == 3, F.regexp_replace("url", "^https?:", "redis:")).otherwise("plain")
    return h.classify_urls(pages(spark, d).select("page_id", F.lit("a.b").alias("name"), value.alias("value"))).select("page_id", "url_kind")


@plan("h2_url_parts", f"SELECT page_id, {_HOST} AS host, {_BASE} AS base_path FROM pages")
def _(spark, d):
    return h.url_parts(pages(spark, d)).select("page_id", "host", "base_path")


@plan("h3_sanitize_urls", "SELECT page_id, regexp_replace(regexp_replace(url, '([?&](?:ref|token|utm_source)=)[^&#]*', '\\1***', 'g'), '://[^/@]*@', '://') AS safe_url FROM pages")
def _(spark, d):
    return h.sanitize_urls(pages(spark, d), keys="ref|token|utm_source").select("page_id", "safe_url")


@plan("h3_sanitize_remotes", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('https://', regexp_extract(url, '://([^?#]*)', 1)) ELSE concat('host', page_id % 7, ':', regexp_extract(url, '://([^?#]*)', 1)) END AS safe_remote FROM pages")
def _(spark, d):
    rest = F.regexp_extract("url", "://(.*)$", 1)
    remote = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://me:pw@"), rest, F.lit("?x=1#top"))).otherwise(F.concat(F.lit("git@host"), F.col("page_id") % 7, F.lit(":"), rest))
    return h.sanitize_remotes(pages(spark, d).select("page_id", remote.alias("remote"))).select("page_id", "safe_remote")


@plan("h4_surface_summary", f"WITH x AS (SELECT CAST(page_id % 20 AS VARCHAR) AS repo, page_id % 3 = 0 AS o, {_HOST} AS host, {_BASE} AS base_path FROM pages) SELECT repo, count(*) FILTER (WHERE NOT o) AS inbound, count(*) FILTER (WHERE o) AS outbound, count(DISTINCT base_path) AS base_paths, count(DISTINCT host) AS hosts FROM x GROUP BY repo")
def _(spark, d):
    p = h.url_parts(pages(spark, d)).withColumn("repo", (F.col("page_id") % 20).cast("string"))
    return h.surface_summary(p.where("page_id % 3 <> 0"), p.where("page_id % 3 = 0"))


@plan("h5_exposures", "SELECT CAST(p_partkey AS VARCHAR) AS name, unnest(string_split(p_name, ' ')) AS endpoint FROM part")
def _(spark, d):
    return h.exposures(load(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name"), F.regexp_replace("p_name", " ", " , ").alias("value")))


@plan("h6_web_stack", f"""WITH {EV}, m AS (SELECT repo || '/' || scope AS module, bool_or(kind = 'error') AS s, bool_or(kind = 'signup') AS r, bool_or(kind = 'click') AS u, bool_or(kind = 'purchase') AS f, bool_or(kind = 'view') AS c, CASE WHEN repo LIKE '%7' THEN CASE max(CAST(repo AS BIGINT)) % 4 WHEN 0 THEN 'servlet' WHEN 1 THEN 'reactive' WHEN 2 THEN 'none' END END AS t FROM ev GROUP BY repo, scope)
SELECT module, CASE WHEN t IS NOT NULL THEN CASE t WHEN 'servlet' THEN 'SERVLET' WHEN 'reactive' THEN 'REACTIVE' ELSE 'NON_WEB' END WHEN s THEN 'SERVLET' WHEN r OR u THEN 'REACTIVE' WHEN f THEN 'NON_WEB' WHEN c THEN 'SERVLET' ELSE 'UNKNOWN' END AS stack,
CASE WHEN t IS NOT NULL THEN 'configured' WHEN s AND r THEN 'both stacks are present and servlet comes first' WHEN s THEN 'servlet stack is present' WHEN r THEN 'reactive stack is present' WHEN u THEN 'routing functions are present' WHEN f THEN 'framework without a web stack' WHEN c THEN 'controllers are present' ELSE 'no evidence' END AS reason FROM m""")
def _(spark, d):
    names = F.create_map(*[F.lit(x) for x in ("error", "servlet", "signup", "reactive", "click", "route", "purchase", "framework", "view", "controller")])
    facts = events(spark, d).select("repo", F.concat_ws("/", "repo", "scope").alias("module"), F.coalesce(names[F.col("kind")], F.lit("other")).alias("kind"))
    kind = F.element_at(F.array(F.lit(" Servlet"), F.lit("REACTIVE"), F.lit("none"), F.lit("odd")), (F.col("repo").cast("long") % 4 + 1).cast("int"))
    return h.web_stack(facts, facts.where("repo like '%7'").select("module", kind.alias("type")).distinct())


@plan("r11_outside_scope", "WITH p AS (SELECT page_id % 10 AS module, array_to_string(list_reverse(string_split(regexp_extract(url, '://([^/]*)', 1), '.')), '.') AS package FROM pages), roots AS (SELECT DISTINCT module, package AS root FROM p WHERE module < 7 AND length(package) % 2 = 0) SELECT module, package FROM p WHERE NOT EXISTS (SELECT 1 FROM roots r WHERE (r.module = p.module OR p.module NOT IN (SELECT module FROM roots)) AND (p.package = r.root OR starts_with(p.package, r.root || '.')))")
def _(spark, d):
    p = pages(spark, d).select((F.col("page_id") % 10).alias("module"), F.array_join(F.reverse(F.split(F.regexp_extract("url", "://([^/]*)", 1), "[.]")), ".").alias("package"))
    roots = p.where("module < 7").where(F.length("package") % 2 == 0).select("module", F.col("package").alias("root")).distinct()
    return r.rule_outside_scope(p, roots)


@plan("r11_collapse_roots", "WITH p AS (SELECT DISTINCT page_id % 5 AS module, CASE WHEN page_id % 3 = 0 THEN string_split(regexp_extract(url, '://([^/]*)', 1), '.')[-1] ELSE array_to_string(list_reverse(string_split(regexp_extract(url, '://([^/]*)', 1), '.')), '.') END AS root FROM pages) SELECT module, root FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.module = p.module AND starts_with(p.root, q.root || '.'))")
def _(spark, d):
    parts = F.split(F.regexp_extract("url", "://([^/]*)", 1), "[.]")
    root = F.when(F.col("page_id") % 3 == 0, F.element_at(parts, -1)).otherwise(F.array_join(F.reverse(parts), "."))
    return r.collapse_roots(pages(spark, d).select((F.col("page_id") % 5).alias("module"), root.alias("root")).distinct())


@plan("i1_file_manifest", "SELECT source AS repo, doc_id AS path, CAST(strlen(text) AS INT) AS size, sha256(text) AS sha256 FROM documents")
def _(spark, d):
    return i.file_manifest(files(spark, d))


_TREE = """t0 AS (SELECT source AS repo, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 4) AS b, concat(doc_id, chr(9), strlen(text), chr(9), sha256(text)) AS item FROM documents),
t1 AS (SELECT repo, b, sha256(string_agg(item, chr(10) ORDER BY item)) AS h FROM t0 GROUP BY repo, b), t2 AS (SELECT repo, substr(b, 1, 2) AS b, sha256(string_agg(concat(b, chr(9), h), chr(10) ORDER BY b, h)) AS h FROM t1 GROUP BY repo, substr(b, 1, 2)), t AS (SELECT repo, sha256(string_agg(concat(b, chr(9), h), chr(10) ORDER BY b, h)) AS content_hash FROM t2 GROUP BY repo)"""


@plan("i2_tree_hash", f"WITH {_TREE} SELECT repo, content_hash FROM t")
def _(spark, d):
    return i.tree_hash(i.file_manifest(files(spark, d)))


@plan("i3_manifest_diff", "SELECT source AS repo, count(*) FILTER (WHERE doc_id % 5 = 0) AS added, count(*) FILTER (WHERE doc_id % 5 = 1) AS removed, count(*) FILTER (WHERE doc_id % 5 = 2) AS changed, count(*) FILTER (WHERE doc_id % 5 > 2) AS same FROM documents GROUP BY source")
def _(spark, d):
    old = files(spark, d).where("path % 5 <> 0")
    new = files(spark, d).where("path % 5 <> 1").withColumn("content", F.when(F.col("path") % 5 == 2, F.concat("content", F.lit("+"))).otherwise(F.col("content")))
    return i.manifest_diff(i.file_manifest(old), i.file_manifest(new))


@plan("i4_result_key", f"WITH {_TREE} SELECT repo, sha256(concat(length(content_hash), ':', content_hash, '4:deep2:r13:1.0')) AS result_key FROM t")
def _(spark, d):
    return i.result_key(i.tree_hash(i.file_manifest(files(spark, d))).withColumnRenamed("content_hash", "effective_hash"), "deep", "r1", "1.0").select("repo", "result_key")


@plan("i5_incremental_audit", f"""WITH {HITS} SELECT repo, path, CAST(line AS INT) AS line, rule_id, NULL AS error FROM hits WHERE NOT regexp_matches(repo, '[37]$') AND NOT regexp_matches(repo, '[02]$')
UNION ALL SELECT repo, 0, 7, 'STORED', NULL FROM (SELECT DISTINCT source AS repo FROM documents WHERE regexp_matches(source, '[02]$')) UNION ALL SELECT DISTINCT source, CAST(NULL AS BIGINT), CAST(NULL AS INT), CAST(NULL AS VARCHAR), 'cannot be read' FROM documents WHERE regexp_matches(source, '[37]$')""")
def _(spark, d):
    """Sources that end in 0 or 2 are stored under their key with a finding of their own, those in 4 under another key, so they are
    audited anew as all others are; the audit fails on those that end in 3 or 7."""
    f = files(spark, d)
    current = i.result_key(i.tree_hash(i.file_manifest(f)).withColumnRenamed("content_hash", "effective_hash"), "deep", "r1", "1.0").select("repo", "result_key")
    old = current.where(F.col("repo").rlike("[024]$")).withColumn("result_key", F.when(F.col("repo").rlike("4$"), "old").otherwise(F.col("result_key")))
    stored = old.select("repo", F.lit(0).cast("long").alias("path"), F.lit(7).alias("line"), F.lit("STORED").alias("rule_id"), "result_key")

    def audit(some):
        found = r.rule_scan(s.explode_lines(some), RULES).select("repo", "path", "line", "rule_id")
        return found, some.where(F.col("repo").rlike("[37]$")).select("repo", F.lit("cannot be read").alias("error"))

    found, failures = i.incremental_audit(current, stored, f, audit)
    return found.unionByName(failures, allowMissingColumns=True)


@plan("i6_dependency_context", f"WITH RECURSIVE {closure_sql(0.005)}, f AS (SELECT p_partkey AS repo, p_name AS name FROM part) SELECT repo AS context_repo, repo, name, 'PRIMARY' AS origin FROM f UNION ALL SELECT src, repo, name, 'DEPENDENCY' FROM (SELECT * FROM reach WHERE src <> dst) JOIN f ON dst = repo")
def _(spark, d):
    facts = load(spark, d, "part").select(F.col("p_partkey").alias("repo"), F.col("p_name").alias("name"))
    return i.dependency_context(dependency_closure(edges(spark, d, 0.005)), facts)


@plan("i7_stream_audit", f"WITH {HITS} SELECT repo, path, CAST(line AS INT) AS line, rule_id FROM hits")
def _(spark, d):
    """All documents as a stream of files, each sent twice; the batch answer comes out."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    f = files(spark, d).withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    f.unionByName(f).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(f.schema).parquet(f"{base}/in")
    run_available(stream_audit(stream, RULES).select("repo", "path", "line", "rule_id"), f"{base}/out", f"{base}/state")
    return spark.read.schema("repo string, path long, line int, rule_id string").parquet(f"{base}/out")


@plan("i7_withdrawn_findings", f"""WITH {HITS}, v AS (SELECT concat('r', doc_id // 64) AS repo, doc_id // 8 AS file, doc_id, row_number() OVER w AS v, lead(doc_id) OVER w AS next FROM documents WINDOW w AS (PARTITION BY doc_id // 8 ORDER BY doc_id)),
f AS (SELECT v.*, rule_id, evidence, line, row_number() OVER (PARTITION BY doc_id, rule_id, evidence ORDER BY line) AS nth FROM hits JOIN v ON path = doc_id),
c AS (SELECT *, doc_id AS place, 'new' AS change FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.repo = a.repo AND b.file = a.file AND b.v = a.v - 1 AND b.rule_id = a.rule_id AND b.evidence = a.evidence AND b.nth = a.nth)
UNION ALL SELECT *, next AS place, 'withdrawn' AS change FROM f a WHERE next IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f b WHERE b.repo = a.repo AND b.file = a.file AND b.v = a.v + 1 AND b.rule_id = a.rule_id AND b.evidence = a.evidence AND b.nth = a.nth))
SELECT repo, CAST(file AS VARCHAR) AS path, CAST(place % 8 + 1 AS INT) AS version, change, rule_id, CAST(line AS INT) AS line, evidence FROM c""")
def _(spark, d):
    """Eight neighbouring documents are versions of one file, a day apart; the first four days arrive, then the
    others, to a stream that starts again from its state."""
    base = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    day = F.pmod(F.col("path"), F.lit(8)).cast("int")
    f = files(spark, d).select(F.concat(F.lit("r"), F.floor(F.col("path") / 64)).alias("repo"), F.floor(F.col("path") / 8).cast("string").alias("path"), "content", F.timestamp_add("DAY", day, F.to_timestamp(F.lit("2024-01-01 00:00:00"))).alias("ts"))
    for days in (F.day("ts") <= 4, F.day("ts") > 4):
        f.where(days).write.mode("append").parquet(f"{base}/in")
        run_changes(spark.readStream.schema(f.schema).parquet(f"{base}/in"), RULES, f"{base}/out", f"{base}/state")
    out = spark.read.schema(CHANGE).parquet(f"{base}/out")
    return out.select("repo", "path", F.day("ts").alias("version"), "change", "rule_id", "line", "evidence")


@plan("i7_severity_windows", f"SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS start, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END AS severity, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    ev = load(spark, d, "events")
    sev = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARNING").otherwise("INFO")
    out = severity_windows(ev.select("ts", sev.alias("severity")))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "severity", "n")
