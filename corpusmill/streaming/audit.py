"""Continuous audit (I7): new versions of files arrive, unchanged content is dropped, findings go out once, and those that a
new version no longer has are withdrawn."""

from __future__ import annotations

import json
from collections import Counter
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from corpusmill.operators.rules import rule_scan
from corpusmill.sources.files import explode_lines


def stream_audit(files: DataFrame, rules: list[dict], watermark: str = "1 hour") -> DataFrame:
    """Findings of a stream of files (repo, path, content, ts). Content seen within the watermark is not audited again;
    content that comes back later is, which repeats work and loses nothing."""
    marked = files.withColumn("sha256", F.sha2("content", 256)).withWatermark("ts", watermark)
    fresh = marked.dropDuplicatesWithinWatermark(["repo", "path", "sha256"])
    return rule_scan(explode_lines(fresh), rules)


FOUND = "array<struct<rule_id:string,evidence:string,line:int>>"
CHANGE = "repo string, path string, ts timestamp, change string, rule_id string, line int, evidence string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_findings(content: str, rules: list[dict]) -> Column:
    """The findings of one text, rule by rule, as an array of (rule_id, evidence, line)."""
    lines = F.split(F.regexp_replace(content, "\r\n", "\n"), "\n")

    def of(r):
        held = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("text"), (i + 1).alias("line"))), lambda x: x["text"].rlike(r["pattern"]))
        return F.transform(held, lambda x: F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.regexp_extract(x["text"], r["pattern"], 0).alias("evidence"), x["line"].alias("line")))

    return F.coalesce(F.flatten(F.array(*map(of, rules))), F.array().cast(FOUND))


def _versions(files: DataFrame, rules: list[dict]) -> DataFrame:
    """repo, path, ts, found of the versions that have a time."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return files.where("ts is not null").select(text("repo"), text("path"), "ts", file_findings("content", rules).alias("found"))


class LastVersion(StatefulProcessor):
    """Holds a file's last version (its time and findings) and gives what each later version adds and withdraws.

    Findings of equal rule and evidence are told apart by their number in the file, so that one stays the same when lines before it come or go."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "ts string, found string")

    def handleInputRows(self, key, rows, timerValues):
        seen, before = None, {}
        if self.last.exists():
            held = self.last.get()
            seen, before = held[0], {(r, e, n): line for r, e, n, line in json.loads(held[1])}
        done = seen  # versions up to here have gone out with earlier batches
        fields = lambda found: [[f["rule_id"], f["evidence"], f["line"]] for f in found]
        for ts, found in sorted((r.ts.isoformat(), fields(r.found)) for r in rows):
            if done is not None and ts <= done:
                continue
            now, counts = {}, Counter()
            for rule_id, evidence, line in found:
                counts[rule_id, evidence] += 1
                now[rule_id, evidence, counts[rule_id, evidence]] = line
            for change, a, b in (("new", now, before), ("withdrawn", before, now)):
                for k in a.keys() - b.keys():
                    yield Row(repo=key[0], path=key[1], ts=datetime.fromisoformat(ts), change=change, rule_id=k[0], line=a[k], evidence=k[1])
            seen, before = ts, now
        if seen != done:
            self.last.update((seen, json.dumps([[*k, line] for k, line in before.items()])))

    def close(self) -> None:
        pass


def stream_changes(files: DataFrame, rules: list[dict]) -> DataFrame:
    """repo, path, ts, change (new or withdrawn), rule_id, line, evidence of a stream of file versions (repo, path, content, ts).

    The state is one row a file: its last version's findings, never its content. Null content is a file that is gone: all its
    findings are withdrawn. A withdrawn finding has the line of the version that had it. Versions without a time are left out, as are those no later
    than one that an earlier batch has handled. Needs the state store named in STATE_STORE."""
    return _versions(files, rules).groupBy("repo", "path").transformWithState(LastVersion(), CHANGE, "append", "none")


def version_changes(files: DataFrame, rules: list[dict]) -> DataFrame:
    """stream_changes() of a whole table of versions at once."""
    order = Window.partitionBy("repo", "path").orderBy("ts", F.to_json("found"))
    versions = _versions(files, rules).withColumn("v", F.row_number().over(order)).withColumn("next", F.lead("ts").over(order))
    rows = versions.select("repo", "path", "ts", "v", "next", F.inline("found"))
    same = ["repo", "path", "v", "rule_id", "evidence"]
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy("line")))
    key = [*same, "nth"]
    new = rows.join(rows.withColumn("v", F.col("v") + 1), key, "left_anti").select("repo", "path", "ts", F.lit("new").alias("change"), "rule_id", "line", "evidence")
    gone = rows.where("next is not null").withColumn("v", F.col("v") + 1).join(rows, key, "left_anti")
    return new.unionByName(gone.select("repo", "path", F.col("next").alias("ts"), F.lit("withdrawn").alias("change"), "rule_id", "line", "evidence"))


def severity_windows(findings: DataFrame, watermark: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Findings (ts, severity) per window and severity; rows behind the watermark are dropped."""
    return findings.withWatermark("ts", watermark).groupBy(F.window("ts", width).alias("w"), "severity").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "severity", "n")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there and appends the results as Parquet."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_changes(files: DataFrame, rules: list[dict], path: str, checkpoint: str) -> None:
    """Runs stream_changes() over all that is there, with the state store that it needs."""
    conf, name = files.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, STATE_STORE)
    try:
        run_available(stream_changes(files, rules), path, checkpoint)
    finally:
        conf.set(name, before)
