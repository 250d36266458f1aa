"""Content hashes, change sets and audits of what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_manifest(files: DataFrame) -> DataFrame:
    return files.select("repo", "path", F.octet_length("content").alias("size"), F.sha2("content", 256).alias("sha256"))


def tree_hash(manifest: DataFrame) -> DataFrame:
    """One hash per repo over its files; only hashes meet in a group, never contents.

    Files are hashed in 65,536 buckets by the hash of their path, these in 256, these as one, so that no list grows
    with more than a small part of a repo."""
    path = F.sha2(F.col("path").cast("string"), 256)
    rows = manifest.select("repo", F.substring(path, 1, 4).alias("b"), F.concat_ws("\t", F.col("path").cast("string"), F.col("size").cast("string"), "sha256").alias("item"))
    whole = lambda: F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("item"))), 256)
    for length in (2, 0):
        rows = rows.groupBy("repo", "b").agg(whole().alias("h")).select("repo", F.substring("b", 1, length).alias("b"), F.concat_ws("\t", "b", "h").alias("item"))
    return rows.groupBy("repo").agg(whole().alias("content_hash"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per repo: files added, removed, changed, same."""
    both = old.select("repo", "path", F.col("sha256").alias("a")).join(new.select("repo", "path", F.col("sha256").alias("b")), ["repo", "path"], "full_outer")
    return both.groupBy("repo").agg(
        F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"), F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count_if(F.col("a") == F.col("b")).alias("same")
    )


def result_key(repos: DataFrame, mode: str, ruleset_hash: str, engine_version: str) -> DataFrame:
    """A key of all inputs to a repo's result; parts carry their length, so that no two lists of parts read the same."""
    parts = [F.col("effective_hash"), F.lit(mode), F.lit(ruleset_hash), F.lit(engine_version)]
    return repos.withColumn("result_key", F.sha2(F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]), 256))


def incremental_audit(current: DataFrame, stored: DataFrame, files: DataFrame, audit: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(findings, failures) of all repos in current (repo, result_key): stored findings where the key is stored, else audited anew.

    audit gives findings and failures (repo, error) of files. A failed repo has its error and no findings, and the others
    keep theirs. A repo stored without findings is in stored with a null rule."""
    hits = stored.join(current, ["repo", "result_key"], "left_semi").drop("result_key").where("rule_id is not null")
    known = stored.select("repo", "result_key").distinct()
    misses = current.join(known, ["repo", "result_key"], "left_anti").select("repo")
    found, failures = audit(files.join(misses, "repo", "left_semi"))
    failures = failures.groupBy("repo").agg(F.min("error").alias("error"))
    return hits.unionByName(found.join(failures, "repo", "left_anti")), failures


def dependency_context(closure: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts that each repo sees: its own as PRIMARY, those of its transitive dependencies as DEPENDENCY."""
    own = facts.withColumn("origin", F.lit("PRIMARY")).withColumn("context_repo", F.col("repo"))
    other = closure.select(F.col("src").alias("context_repo"), F.col("dst").alias("repo")).join(facts, "repo").withColumn("origin", F.lit("DEPENDENCY"))
    return own.unionByName(other.select(*own.columns))
