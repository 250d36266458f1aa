"""How the given tables read as corpora, findings, facts, properties, edges; the same in SQL for the checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators.rules import rule_scan
from corpusmill.sources.files import explode_lines

QUERIES: dict = {}
SQL: dict = {}


def plan(name: str, sql: str | None = None):
    """Registers a query, and the SQL that gives the same rows."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def load(spark, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def files(spark, d):
    return load(spark, d, "documents").select(F.col("source").alias("repo"), F.col("doc_id").alias("path"), F.col("text").alias("content"))


def lines(spark, d):
    return explode_lines(files(spark, d))


LINES = "lines AS (SELECT repo, path, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT source AS repo, doc_id AS path, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents))"

# Fixed values of the test rules.
RULES = [
    {"rule_id": "EMAIL", "severity": "WARNING", "category": "SECURITY", "pattern": "[a-z0-9.]+@[a-z0-9.]+[.]com", "literal": "@"},
    {"rule_id": "IPV4", "severity": "INFO", "category": "HTTP", "pattern": "[0-9]{1,3}([.][0-9]{1,3}){3}"},
    {"rule_id": "CARD", "severity": "ERROR", "category": "SECURITY", "pattern": "[0-9]{16}"},
    {"rule_id": "DIGEST", "severity": "WARNING", "category": "CONFIGURATION", "pattern": "[0-9a-f]{40}"},
    {"rule_id": "LICENSE", "severity": "INFO", "category": "MAINTAINABILITY", "pattern": "License", "literal": "License"},
    {"rule_id": "TOKEN", "severity": "WARNING", "category": "SECURITY", "pattern": "token = ", "literal": "token = "},
    {"rule_id": "PASSWORD", "severity": "ERROR", "category": "SECURITY", "pattern": "password=", "literal": "password="},
]
CATALOG = [(r["rule_id"], r["rule_id"].title() + " in text", r["severity"], r["category"]) for r in RULES]
_rules_sql = ", ".join(f"('{r['rule_id']}', '{r['severity']}', '{r['category']}', '{r['pattern']}')" for r in RULES)
HITS = LINES + f", rules(rule_id, severity, category, pattern) AS (VALUES {_rules_sql}), hits AS (SELECT repo, path, line, rule_id, severity, category, regexp_extract(text, pattern, 0) AS evidence FROM lines JOIN rules ON regexp_matches(text, pattern))"


def hits(spark, d):
    return rule_scan(lines(spark, d), RULES)


SEVERITY = {"error": "ERROR", "purchase": "WARNING"}
EV = "ev AS (SELECT event_id, CAST(user_id AS VARCHAR) AS repo, event_type AS rule_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END AS severity, strftime(ts, '%Y-%m-%d') AS scope, event_id AS place, event_type AS kind, props, value FROM events)"


def events(spark, d):
    e = load(spark, d, "events")
    sev = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARNING").otherwise("INFO")
    return e.select("event_id", F.col("user_id").cast("string").alias("repo"), F.col("event_type").alias("rule_id"), sev.alias("severity"), F.date_format("ts", "yyyy-MM-dd").alias("scope"), F.col("event_id").alias("place"), F.col("event_type").alias("kind"), "props", "value")


PROP = "prop AS (SELECT 'part' AS repo, p_partkey AS place, concat(lower(p_type), '.', replace(p_name, ' ', '-')) AS name, p_brand AS profile, CAST(p_size AS VARCHAR) AS value FROM part)"


def props(spark, d):
    p = load(spark, d, "part")
    return p.select(F.lit("part").alias("repo"), F.col("p_partkey").alias("place"), F.concat(F.lower("p_type"), F.lit("."), F.regexp_replace("p_name", " ", "-")).alias("name"), F.col("p_brand").alias("profile"), F.col("p_size").cast("string").alias("value"))


TAGS = "tags AS (SELECT page_id AS path, unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS name FROM pages)"


def pages(spark, d):
    return load(spark, d, "pages")


COORD = "coord AS (SELECT p_partkey AS module, p_brand AS \"group\", p_name AS artifact, CASE WHEN p_size % 10 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS version FROM part)"


def coords(spark, d):
    p = load(spark, d, "part")
    return p.select(F.col("p_partkey").alias("module"), F.col("p_brand").alias("group"), F.col("p_name").alias("artifact"), F.when(F.col("p_size") % 10 != 0, F.col("p_size").cast("string")).alias("version"))


def edges(spark, d, discount: float):
    """Part to the next line's part of the same order, where the first line was returned at a small discount."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_discount")
    nxt = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return li.where((F.col("l_returnflag") == "R") & (F.col("l_discount") < discount)).join(nxt, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst").distinct()


def edges_sql(discount: float) -> str:
    return f"edges AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_returnflag = 'R' AND a.l_discount < {discount})"


def closure_sql(discount: float) -> str:
    return edges_sql(discount) + ", reach(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)"
