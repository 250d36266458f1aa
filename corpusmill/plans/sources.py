"""Queries over sources and sinks: a file tree scanned, a report written and read, outbound calls without a host."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusmill.functions.storage import shared_dir
from corpusmill.operators import facts as e
from corpusmill.operators import findings as f
from corpusmill.plans.bindings import HITS, hits, load, plan
from corpusmill.sources import files as s


@plan("s1_corpus_scan", "SELECT 'source=' || source AS repo, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes, CAST(sum(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1) AS BIGINT) AS breaks FROM documents GROUP BY source")
def _(spark, d):
    """The documents as a tree of text files, one folder a source; the tree scanned again."""
    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    load(spark, d, "documents").select("source", F.coalesce("text", F.lit("")).alias("value")).write.option("maxRecordsPerFile", 2000).partitionBy("source").text(root)
    found = s.corpus_scan(spark, root, include=["*.txt"])
    breaks = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    return found.groupBy("repo").agg(F.sum("size").alias("bytes"), F.sum(breaks).cast("long").alias("breaks"))


@plan("s8_write_report", f"WITH {HITS} SELECT repo, path, CAST(line AS BIGINT) AS line, rule_id, severity, evidence AS message FROM hits")
def _(spark, d):
    """Findings written as one folder of JSON rows a repo, and read back."""
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    f.write_report(hits(spark, d).select("repo", "path", "line", "rule_id", "severity", F.col("evidence").alias("message")), path)
    return spark.read.schema("path long, line long, rule_id string, severity string, message string, repo string").json(path)


_TOKENS = "[t FOR t IN regexp_split_to_array(lower({}), '[^a-z0-9]+') IF length(t) >= 4]"


@plan(
    "e7_best_base_url",
    f"WITH p AS (SELECT page_id AS endpoint, unnest({_TOKENS.format('concat(url, chr(32), url)')}) AS token FROM pages), "
    "n AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS name FROM pages), "
    f"u AS (SELECT name, unnest(list_distinct({_TOKENS.format('name')})) AS token FROM n WHERE name <> ''), "
    "sc AS (SELECT endpoint, name, count(*) AS score FROM p JOIN u USING (token) GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nxt FROM sc WINDOW w AS (PARTITION BY endpoint ORDER BY score DESC, name)) "
    "SELECT endpoint, name, score FROM r WHERE rn = 1 AND (nxt IS NULL OR score > nxt)",
)
def _(spark, d):
    pages = load(spark, d, "pages")
    hosts = pages.select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("name")).where("name <> ''").distinct()
    return e.best_base_url(pages.select(F.col("page_id").alias("endpoint"), F.concat_ws(" ", "url", "url").alias("hint")), hosts)
