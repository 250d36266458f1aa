"""Queries over the rule catalogue: source trees whose lines are the facts' examples, dealt by the lines of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import catalog as c
from corpusmill.operators import rules as r
from corpusmill.plans.bindings import load, plan

# Fixed values of the checks: the paths of files, by the order's number.
PATHS = ["src/A.java", "src/B.java", "src/C.java", "application.properties", "application-prod.yml", "application-test.properties", "application-dev.yml", "db/migration/V1__a.sql", "build.gradle"]
WHOLE, WHOLE_FACTS = c.rules(whole=True), c.facts(whole=True)
EXAMPLES = [f["example"] for f in WHOLE_FACTS]


def _text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def source_lines(spark, d):
    """repo: four neighbouring orders; a file per order, a line per line of it."""
    li, order = load(spark, d, "lineitem"), F.col("l_orderkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    return li.select(F.concat(F.lit("r"), F.floor(order / 4)).alias("repo"), F.concat(F.lit("m"), order, F.lit("/"), pick(PATHS, order)).alias("path"), F.col("l_linenumber").alias("line"), pick(EXAMPLES, F.col("l_partkey") * 7 + F.col("l_linenumber")).alias("text"))


_words = ", ".join(f"({_text(w)}, {_text(f['name'])}, {_text(f['pattern'])}, {_text(f['path'])})" for f in WHOLE_FACTS for w in f["words"])
_needs = ", ".join(f"({_text(x['rule_id'])}, {_text(f)}, {k})" for x in WHOLE for k, f in enumerate(x["needs"]))
_none = ", ".join(f"({_text(x['rule_id'])}, {_text(f)})" for x in WHOLE for f in x["none"])
_rules = ", ".join(f"({_text(x['rule_id'])}, {_text(x['severity'])}, {_text(x['category'])}, {_text(x['scope'])}, {len(x['needs'])}, {x['least']})" for x in WHOLE)
FACTS = f"""words(word, fact, pattern, path_pattern) AS (VALUES {_words}), l AS (SELECT concat('r', l_orderkey // 4) AS repo, concat('m', l_orderkey, '/', {_list(PATHS)}[1 + l_orderkey % {len(PATHS)}]) AS path, l_linenumber AS line, {_list(EXAMPLES)}[1 + (l_partkey * 7 + l_linenumber) % {len(EXAMPLES)}] AS text FROM lineitem),
t AS (SELECT DISTINCT *, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM l), fa AS (SELECT DISTINCT repo, path, line, fact FROM t JOIN words USING (word) WHERE regexp_matches(text, pattern) AND (path_pattern IS NULL OR regexp_matches(path, path_pattern)))"""
FOUND = f"""{FACTS}, rl(rule_id, severity, category, scope, n_needs, least) AS (VALUES {_rules}), nd(rule_id, fact, k) AS (VALUES {_needs}), nn(rule_id, fact) AS (VALUES {_none}),
sc AS (SELECT fa.*, rl.*, k, CASE WHEN scope <> 'repo' THEN path ELSE '' END AS p, CASE WHEN scope = 'line' THEN line ELSE 0 END AS n FROM fa JOIN nd USING (fact) JOIN rl USING (rule_id)),
g AS (SELECT repo, p, n, rule_id, severity, category, min((path, line)) FILTER (WHERE k = 0) AS spot FROM sc GROUP BY ALL HAVING count(DISTINCT k) = any_value(n_needs) AND count(*) FILTER (WHERE k = 0) >= any_value(least)),
bad AS (SELECT DISTINCT rule_id, repo, CASE WHEN scope <> 'repo' THEN path ELSE '' END AS p, CASE WHEN scope = 'line' THEN line ELSE 0 END AS n FROM fa JOIN nn USING (fact) JOIN rl USING (rule_id)),
found AS (SELECT repo, spot[1] AS path, CAST(spot[2] AS INT) AS line, rule_id, severity, category FROM g ANTI JOIN bad USING (rule_id, repo, p, n))"""


@plan("r2_catalog_facts", f"WITH {FACTS} SELECT repo, path, CAST(line AS INT) AS line, fact FROM fa")
def _(spark, d):
    return c.line_facts(source_lines(spark, d), WHOLE_FACTS)


@plan("r2_catalog_findings", f"WITH {FOUND} SELECT repo, path, line, rule_id, severity, category FROM found")
def catalog_findings(spark, d):
    return c.evaluate(c.line_facts(source_lines(spark, d), WHOLE_FACTS), WHOLE)


@plan("r1_catalog_states", f"WITH {FOUND} SELECT rl.severity, count(*) AS rules, count(*) FILTER (WHERE NOT starts_with(rl.rule_id, 'SPRING_JPA')) AS enabled_rules, false AS fully_disabled FROM rl WHERE rule_id IN (SELECT rule_id FROM found) GROUP BY rl.severity")
def _(spark, d):
    """Of the rules that fire, those that a configuration without persistence rules leaves on."""
    off = [x["rule_id"] for x in WHOLE if x["rule_id"].startswith("SPRING_JPA")]
    table = r.rule_catalog(spark, [(x["rule_id"], c.title(x["rule_id"]), x["severity"], x["category"]) for x in WHOLE], off)
    return r.severity_states(table.join(catalog_findings(spark, d).select("rule_id").distinct(), "rule_id", "left_semi"))
