"""Corpora as tables of files and lines (S1-S3, S10, E9) and their budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.running import running_totals
from corpusmill.sources.tree import TreeSource


def corpus_scan(spark: SparkSession, root: str, include=("**",), exclude=(), max_depth: int = 64) -> DataFrame:
    """repo, path, content, size, origin of the files below root; the first folder names the repo.

    Dot files are read like others; pruned folders are not entered, and only files that the globs let through are opened. The
    tree is read by its file system's own reader, so root is a path or an address of a store that the workers can reach."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("tree").option("include", "\n".join(include)).option("exclude", "\n".join(exclude)).option("maxDepth", max_depth)
    files = reader.option("folders", 4 * spark.sparkContext.defaultParallelism).load(root)
    return files.select("repo", "path", F.decode("content", "UTF-8").alias("content"), "size", F.lit("PRIMARY").alias("origin"))


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1; CRLF counts as one break."""
    return files.select("repo", "path", F.posexplode(F.split("content", "\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def parse_property_lines(lines: DataFrame) -> DataFrame:
    """name, value of the lines with = or : (the first of either); comments, blanks and empty names go."""
    rows = lines.where(~F.trim("text").rlike("^[#!]") & F.col("text").rlike("[=:]"))
    rows = rows.withColumn("name", F.trim(F.regexp_extract("text", "^([^=:]*)[=:]", 1))).withColumn("value", F.trim(F.regexp_extract("text", "^[^=:]*[=:](.*)$", 1)))
    return rows.where("name <> ''").select("repo", "path", "line", "name", "value")


def within_budget(files: DataFrame, max_files: int, max_file_bytes: int, max_total_bytes: int, run_files: int | None = None, run_bytes: int | None = None) -> DataFrame:
    """Per repo: accepted, and the first path at which a limit is passed; accepted_in_run: whether it and the accepted repos before
    it, in order of name, stay within the limits of the whole run.

    Running sums go over ranges of paths, with the sums of the ranges before, so that a repo of any size is spread."""
    rows = files.select("repo", "path", "size", F.lit(1).alias("one"))
    run = running_totals(rows, ["repo"], ["path"], {"n": "one", "total": "size"})
    over = (F.col("n") > max_files) | (F.col("size") > max_file_bytes) | (F.col("total") > max_total_bytes)
    out = run.groupBy("repo").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.min(F.when(over, F.col("path"))).alias("first_offender")).withColumn("accepted", F.col("first_offender").isNull())
    if run_files is None and run_bytes is None:
        return out
    upto = Window.orderBy("repo").rowsBetween(Window.unboundedPreceding, 0)  # one row a repo
    taken = lambda c: F.sum(F.when(F.col("accepted"), F.col(c)).otherwise(0)).over(upto)
    fits = F.lit(True)
    for limit, column in ((run_files, "files"), (run_bytes, "bytes")):
        if limit is not None:
            fits = fits & (taken(column) <= limit)
    return out.withColumn("accepted_in_run", F.col("accepted") & fits)


def module_of_path(files: DataFrame, modules: DataFrame) -> DataFrame:
    """module of each file: the longest module path that leads to it, else the text before /src/main/, else the root ''."""
    from corpusmill.functions.text import prefixes

    steps = files.select("repo", "path", F.explode(prefixes(F.col("path"), "/")).alias("rel_path"))
    hit = steps.join(modules.select("repo", "rel_path").distinct(), ["repo", "rel_path"]).groupBy("repo", "path").agg(F.max_by("rel_path", F.length("rel_path")).alias("module"))
    fallback = F.regexp_extract("path", "^(.*?)/src/main/", 1)
    return files.select("repo", "path").join(hit, ["repo", "path"], "left").select("repo", "path", F.coalesce("module", fallback).alias("module"))
