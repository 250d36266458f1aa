"""Finding algebra: merge, suppress, configure, sort, summarise, group, export."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.running import running_totals
from corpusmill.functions.storage import components
from corpusmill.functions.text import normal_severity, severity_rank
from corpusmill.operators.properties import is_sensitive
from corpusmill.operators.rules import rank_first


def least_label(pairs: DataFrame) -> DataFrame:
    """id, label: the smallest id that each id reaches through shared keys. pairs: (id, key)."""
    first = pairs.groupBy("key").agg(F.min("id").alias("b"))
    roots = components(pairs.join(first, "key").select(F.col("id").alias("a"), "b"))
    return pairs.select("id").distinct().join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("label"))


def merge_overlapping(findings: DataFrame, line_rules: list[str], pairs: dict[str, list[str]], dominance: dict[str, int], default: int = 30) -> DataFrame:
    """One row per group of overlapping findings: the primary one and its related signals.

    Findings of line_rules overlap on one line of a file; findings of a named pair overlap on one target. Both
    kinds of overlap chain. A finding without a rule overlaps with none. Column finding_id tells rows apart."""
    line_key = F.when(F.col("rule_id").isin(line_rules), F.concat_ws("\t", F.lit("line"), "repo", "path", "line"))
    keys = [line_key] + [F.when(F.col("rule_id").isin(rules), F.concat_ws("\t", F.lit(name), "repo", "path", "target")) for name, rules in pairs.items()]
    keyed = findings.select(F.col("finding_id").alias("id"), F.explode(F.array_compact(F.array(*keys))).alias("key"))
    labels = least_label(keyed).withColumnRenamed("id", "finding_id")
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in dominance.items() for x in kv])[F.col("rule_id")], F.lit(default))
    rows = findings.join(labels, "finding_id", "left").withColumn("label", F.coalesce("label", "finding_id")).withColumn("dominance", rank)
    signal = F.struct((-F.col("dominance")).alias("o"), "finding_id", "rule_id", "line", "evidence")
    primary = rank_first(rows, ["label"], [F.desc("dominance"), F.col("finding_id")])
    others = rows.join(primary.select("finding_id"), "finding_id", "left_anti")
    signals = others.groupBy("label").agg(F.sort_array(F.collect_list(signal)).alias("related_signals"))
    return primary.join(signals, "label", "left").withColumn("n_signals", F.coalesce(F.size("related_signals"), F.lit(0)))


def suppress(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Findings whose (repo, rule) is not suppressed; null or blank suppressions count for nothing, null rules stay."""
    held = suppressions.where(F.trim("rule_id") != "").select("repo", "rule_id").distinct()
    return findings.join(held, ["repo", "rule_id"], "left_anti")


def apply_rule_config(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Drops findings of disabled rules, and of severities whose rules are all disabled."""
    off = catalog.where("not enabled").select("rule_id")
    gone = catalog.groupBy("severity").agg(F.bool_or("enabled").alias("any")).where("not any").select("severity")
    return findings.join(off, "rule_id", "left_anti").join(gone, "severity", "left_anti")


def normalize_severity(df: DataFrame, column: str = "severity") -> DataFrame:
    df = df.withColumn("severity_norm", normal_severity(F.col(column)))
    return df.withColumn("severity_rank", severity_rank(F.col("severity_norm")))


def numbered(rows: DataFrame, name: str, scope: list[str], order: list[Column]) -> DataFrame:
    """rows with their place (from 1) within the scope, by totals over ranges, so that a scope with a large part of all rows, and one key of the
    order with a large part of those, is spread."""
    run = running_totals(rows.withColumn("_one", F.lit(1)), scope, order, {name: "_one"})
    return run.withColumn(name, F.col(name).cast("int")).drop("_one")


def sort_findings(findings: DataFrame) -> DataFrame:
    """A position per repo: path, rule, message, severity from the worst down."""
    return numbered(findings, "position", ["repo"], [F.col("path"), F.col("rule_id"), F.col("message"), F.desc(severity_rank(F.col("severity"))), F.col("line")])


def severity_counts() -> list[Column]:
    one = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("ERROR", "WARNING", "INFO")]
    return [F.count("severity").alias("total"), *one, F.count_if(~F.col("severity").isin("ERROR", "WARNING", "INFO")).alias("unknown")]


def summarize(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Counts per repo, and over all in a row with a null repo: repos completed and failed (column status), findings by
    severity. Repos without findings stay with zeros."""
    per = findings.groupBy("repo").agg(*severity_counts())
    names = [c for c in per.columns if c != "repo"]
    failed = F.col("status") == "FAILED" if "status" in repos.columns else F.lit(False)
    joined = repos.select("repo", F.when(failed, 1).otherwise(0).alias("_failed")).join(per, "repo", "left")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]
    return joined.rollup("repo").agg(F.sum(1 - F.col("_failed")).alias("completed"), F.sum("_failed").alias("failed"), *sums)


def meets_threshold(findings: DataFrame, severity: str) -> DataFrame:
    """Per repo: findings at or above the severity, and whether there is one; 'none' is never met."""
    least = {"error": 3, "warning": 2, "info": 1, "none": 99}[severity.lower()]
    at = F.count_if(severity_rank(F.col("severity")) >= least)
    return findings.groupBy("repo").agg(at.alias("n_at_or_above"), (at > 0).alias("met"))


def clean_path(path: Column) -> Column:
    """The shortest form of a path: slashes forward and single, no empty or . segment, steps up taken; those that lead out of a
    relative path stay, those above / go. A drive letter stays in front. Null if there is no path."""
    path = F.translate(path, "\\", "/")
    drive = F.regexp_extract(path, "^[A-Za-z]:", 0)
    rest = F.substring(path, F.length(drive) + 1, F.length(path))
    rooted = F.startswith(rest, F.lit("/"))

    def step(held, part):
        up = F.when((F.size(held) > 0) & (F.coalesce(F.try_element_at(held, F.lit(-1)), F.lit("")) != ".."), F.slice(held, 1, F.size(held) - 1)).when(rooted, held).otherwise(F.array_append(held, part))
        return F.when((part == "") | (part == "."), held).when(part == "..", up).otherwise(F.array_append(held, part))

    joined = F.array_join(F.aggregate(F.split(rest, "/"), F.array().cast("array<string>"), step), "/")
    whole = F.concat(drive, F.when(rooted, "/").otherwise(""), F.when((joined == "") & ~rooted, ".").otherwise(joined))
    return F.when(rest != "", whole)


def path_below(path: Column, root: Column) -> Column:
    """What is left of an absolute clean path below an absolute clean root, empty for the root itself, null elsewhere; with drive letters without regard
    to case."""
    lower = lambda p: F.when(p.rlike("^[A-Za-z]:"), F.lower(p)).otherwise(p)
    stem = F.when(F.endswith(root, F.lit("/")), root).otherwise(F.concat(root, F.lit("/")))
    inside = F.startswith(lower(path), lower(stem)) & root.rlike("^([A-Za-z]:)?/")
    return F.when(lower(path) == lower(root), "").when(inside, F.substring(path, F.length(stem) + 1, F.length(path)))


def raw_paths(raw: Column) -> Column:
    """The paths that a finding's JSON names: of itself, and of its two kinds of places. Unreadable JSON has none."""

    def named(at: str, keys: list[str]) -> Column:
        texts = [F.get_json_object(raw, f"$.{at}{k}") for k in keys]
        return F.coalesce(*(F.when((t != "") & ~t.rlike(r"^[{\[]"), t) for t in texts))

    inner = ["sourceFile", "path", "file", "location"]
    return F.array_compact(F.array(named("", ["sourceFile", "path", "location", "file"]), named("primaryLocation.", inner), named("location.", inner)))


def drop_foreign_paths(findings: DataFrame, reserved: str, root: str, context: str | None = None, snapshot: tuple[str, str] | None = None, raw: str | None = None) -> DataFrame:
    """Findings none of whose paths (path, and those in the JSON of column raw) lies in the reserved folder: relative, under root, or
    anywhere under the context folder; outside both, where its two parent folders begin as snapshot says. Whole segments count."""
    folder, outer = clean_path(F.lit(root)), clean_path(F.lit(context))
    below = lambda p: (p == reserved) | F.startswith(p, F.lit(f"{reserved}/"))

    def foreign(path: Column) -> Column:
        path = clean_path(path)
        fallback = F.lit(False)
        if snapshot:
            before, last = map(re.escape, snapshot)
            fallback = path.rlike(f"(^|/){before}[^/]*/{last}[^/]*/{re.escape(reserved)}(/|$)")
        under = F.when(path_below(path, outer).isNotNull(), True).when(path_below(path, folder).isNotNull(), below(path_below(path, folder))).otherwise(fallback)
        return F.coalesce(F.when(path.rlike("^([A-Za-z]:)?/"), under).otherwise(below(path)), F.lit(False))

    paths = F.array(F.col("path").cast("string"))
    if raw is not None:
        paths = F.concat(paths, F.coalesce(raw_paths(F.col(raw)), F.array().cast("array<string>")))
    return findings.where(~F.exists(paths, foreign))


def filter_findings(findings: DataFrame, severity=None, category=None, runtime=None, confidence=None, triage=None, hide_info: bool = False, text: str | None = None) -> DataFrame:
    """Findings that meet all that is given; text is looked for in all shown columns there are, without regard to case."""
    for column, wanted in (("severity", severity), ("category", category), ("runtime", runtime), ("confidence", confidence), ("status", triage)):
        if wanted:
            findings = findings.where(F.col(column).isin(wanted))
    if hide_info and severity != ["INFO"]:
        findings = findings.where(F.col("severity") != "INFO")
    if text and text.strip():
        shown = [c for c in ("message", "path", "rule_id", "title", "category", "runtime", "confidence", "target", "evidence", "status") if c in findings.columns]
        findings = findings.where(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in shown])).contains(text.strip().lower()))
    return findings


def facet_counts(findings: DataFrame, facets: list[str]) -> DataFrame:
    """facet, value, n of each facet by one pass (grouping sets)."""
    sets = findings.select(*facets).groupingSets([[f] for f in facets], *facets).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    top = (1 << len(facets)) - 1
    name = F.coalesce(*[F.when(F.col("g") == top - (1 << (len(facets) - 1 - i)), F.lit(f)) for i, f in enumerate(facets)])
    return sets.select(name.alias("facet"), F.coalesce(*[F.col(f).cast("string") for f in facets]).alias("value"), "n")


def _plain(column: str) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))), r"\s+", " ")


def triage_key(grouped: bool) -> Column:
    """The key that a finding's triage is kept under: its rule (without one, its title), or also target, place and message."""
    group = F.coalesce(F.nullif(F.trim("rule_id"), F.lit("")), _plain("title"))
    if grouped:
        return F.concat(F.lit("group:"), group)
    message = F.coalesce(F.nullif(F.col("message"), F.lit("")), F.col("title"), F.lit(""))
    return F.concat_ws(":", F.lit("finding"), group, _plain("target"), _plain("path"), F.sha2(message, 256))


def join_triage(findings: DataFrame, triage: DataFrame, grouped: bool = False) -> DataFrame:
    """Findings with triage_key and status by it, OPEN where none or an unknown one is set."""
    known = triage.where(F.col("status").isin("OPEN", "ACCEPTED_RISK", "FALSE_POSITIVE", "FIXED")).select(F.col("key").alias("triage_key"), "status")
    return findings.withColumn("triage_key", triage_key(grouped)).join(known, "triage_key", "left").withColumn("status", F.coalesce("status", F.lit("OPEN")))


def target_kind(target: Column) -> Column:
    t = F.lower(F.coalesce(target, F.lit("")))
    return (
        F.when(t.rlike("#(parse|tryparse|extract|decode|convert|normalize)"), "parser-helper").when(t.contains("controller#"), "controller").when(t.contains("service#"), "service")
        .when(t.contains("repository#"), "repository").when(t.contains("#"), "method").otherwise("general")
    )


def confidence_rank(column: Column) -> Column:
    c = F.upper(column)
    return F.when(c == "HIGH", 3).when(c == "MEDIUM", 2).when(c == "LOW", 1).otherwise(0)


def _grouped(findings: DataFrame, by: list[Column], names: list[str]) -> DataFrame:
    """Groups with occurrences, the target (Multiple ... where there are several) and the representative's fields."""
    place = ["repo", "path", "line", "title", "category", "target"]
    first = F.min(F.struct((-severity_rank(F.col("severity"))).alias("s"), (-confidence_rank(F.col("confidence"))).alias("c"), *place)).alias("r")
    held = findings.groupBy(*[b.alias(n) for b, n in zip(by, names)]).agg(F.count("*").alias("occurrences"), F.countDistinct("target").alias("_targets"), first)
    several = F.when(F.col("r.category") == "EXCEPTION_HANDLING", "Multiple methods").otherwise("Multiple targets")
    target = F.when(F.col("_targets") > 1, several).otherwise(F.col("r.target"))
    return held.select(*names, "occurrences", target.alias("target"), F.col("r.title").alias("first_title"), F.col("r.category").alias("first_category"), F.col("r.repo").alias("first_repo"), F.col("r.path").alias("first_path"), F.col("r.line").alias("first_line"), (-F.col("r.s")).alias("worst_rank"), (-F.col("r.c")).alias("confidence_rank"))


def group_findings(findings: DataFrame) -> DataFrame:
    """One row per rule, category, runtime, kind of target and title. The representative has the worst severity, then the
    highest confidence, then the first place."""
    by = [F.col("rule_id"), F.col("category"), F.col("runtime"), target_kind(F.col("target")), _plain("title")]
    return _grouped(findings, by, ["rule_id", "category", "runtime", "target_kind", "title"])


def top_concerns(findings: DataFrame, priorities: dict[str, int], n: int, categories: dict[str, int] | None = None, other: int = 20) -> DataFrame:
    """The n first concerns (rules, or titles of findings without one) that are errors or warnings: by priority (of the rule, else of
    the category), severity, occurrences, confidence, title."""
    look = lambda table, key: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key] if table else F.lit(None)
    groups = _grouped(findings, [F.coalesce(F.nullif(F.trim("rule_id"), F.lit("")), _plain("title"))], ["concern"]).where("worst_rank >= 2")
    groups = groups.withColumn("priority", F.coalesce(look(priorities, F.col("concern")), look(categories, F.col("first_category")), F.lit(other)))
    return groups.orderBy("priority", F.desc("worst_rank"), F.desc("occurrences"), F.desc("confidence_rank"), "first_title", "concern").limit(n)


def collect_occurrences(findings: DataFrame) -> DataFrame:
    """One row per (repo, rule, path) with its lines in order, and the first place and number of all of the repo and rule.

    A file bounds a list; a repo's or a rule's occurrences never meet in one row."""
    held = findings.groupBy("repo", "rule_id", "path").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    per = held.groupBy("repo", "rule_id").agg(F.min(F.struct("path", F.col("lines")[0].alias("line"))).alias("first"), F.sum(F.size("lines")).alias("occurrences"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("repo", "rule_id")]
    return held.alias("a").join(per.alias("b"), same).select("a.*", "b.occurrences", F.col("b.first.path").alias("first_path"), F.col("b.first.line").alias("first_line"))


def redact_line(text: Column) -> Column:
    """A line name=value or name: value of a sensitive name with [redacted] for its value; comments and other lines as they are."""
    name = F.trim(F.regexp_extract(text, "^([^=:]*)[=:]", 1))
    hide = (name != "") & ~F.trim(text).startswith("#") & is_sensitive(name)
    return F.when(hide, F.concat(F.regexp_extract(text, r"^([^=:]*[=:]\s*)", 1), F.lit("[redacted]"))).otherwise(text)


def snippets(findings: DataFrame, lines: DataFrame, context: int, max_lines: int, redact: str = r"(?i)[.](properties|ya?ml|env|env[.]example)$|/[.]env") -> DataFrame:
    """The lines around each finding, clipped to the file; wanted numbers are exploded first, so the join is on equal keys.

    In files whose path matches ``redact``, values of sensitive names are hidden."""
    wanted = findings.select("repo", "path", F.col("line").alias("hit"), "rule_id", F.explode(F.slice(F.sequence(F.greatest(F.col("line") - context, F.lit(1)), F.col("line") + context), 1, max_lines)).alias("line"))
    return wanted.join(lines, ["repo", "path", "line"]).withColumn("highlight", F.col("line") == F.col("hit")).withColumn("text", F.when(F.col("path").cast("string").rlike(redact), redact_line(F.col("text"))).otherwise(F.col("text")))


def permalinks(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """A link to each finding's lines on a known host; null for absolute paths, parent steps and other hosts."""
    slug = F.regexp_replace(F.regexp_extract("remote", r"^(?:https://|ssh://git@|git@)github[.]com[/:]([^/]+/[^/]+?)(?:[.]git)?/?$", 1), "[.]git$", "")
    span = F.when(F.col("end_line") > F.col("line"), F.concat(F.lit("#L"), "line", F.lit("-L"), "end_line")).when(F.col("line") > 0, F.concat(F.lit("#L"), "line")).otherwise("")
    good = (slug != "") & ~F.col("path").rlike(r"^/|(^|/)\.\.(/|$)")
    return findings.join(repos, "repo", "left").withColumn("link", F.when(good, F.concat(F.lit("https://github.com/"), slug, F.lit("/blob/"), "head", F.lit("/"), "path", span)))


def review_plan(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Open findings numbered per repo, the worst first, each with the first fix that the catalogue (rule_id, fix) names."""
    rows = findings.where("status = 'OPEN'").join(catalog.select("rule_id", "fix"), "rule_id", "left")
    done = numbered(rows, "step", ["repo"], [-severity_rank(F.col("severity")), F.col("rule_id"), F.col("path"), F.col("line")])
    return done.select("repo", "step", "rule_id", "category", "severity", "target", "path", "line", "fix")


def enrich_findings(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Title, category, severity and runtime from the catalogue; what a finding has of its own wins."""
    rules = catalog.select("rule_id", *[F.col(c).alias(f"_{c}") for c in ("title", "category", "severity", "runtime")])
    held = findings.join(rules, "rule_id", "left")
    for c in ("title", "category", "severity", "runtime"):
        held = held.withColumn(c, F.coalesce(c, f"_{c}") if c in findings.columns else F.col(f"_{c}")).drop(f"_{c}")
    return held


def write_report(findings: DataFrame, path: str) -> None:
    """JSON rows in one folder per repo, in report order; a large repo is dealt over tasks by ranges of its paths."""
    order = ["repo", "path", "rule_id", "message", "line"]
    findings.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("repo").json(path)


def sarif_export(findings: DataFrame, most: int = 5000) -> DataFrame:
    """repo, part, document: result files of at most ``most`` results each, in order of path, rule, line.

    A document names its rules once (the first title wins), levels are error, warning, note or none, places stand where there is a
    path and regions where there is a line, related places come from the column related (path, line, message)."""
    level = F.when(F.col("severity") == "ERROR", "error").when(F.col("severity") == "WARNING", "warning").when(F.col("severity") == "INFO", "note").otherwise("none")
    rule = F.coalesce("rule_id", F.lit("UNKNOWN"))
    name = F.regexp_replace(F.initcap(F.regexp_replace(rule, "_", " ")), " ", "")

    def place(path: Column, line: Column) -> Column:
        region = F.when(line > 0, F.struct(line.alias("startLine")))
        return F.struct(F.struct(path.cast("string").alias("uri")).alias("artifactLocation"), region.alias("region"))

    places = F.when(F.col("path").isNotNull(), F.array(F.struct(place(F.col("path"), F.col("line")).alias("physicalLocation"))))
    related = F.lit(None).cast("array<struct<id:int>>")
    if "related" in findings.columns:
        sites = F.filter("related", lambda x: x["path"].isNotNull())
        related = F.when(F.size(sites) > 0, F.transform(sites, lambda x, i: F.struct((i + 1).alias("id"), F.when(x["message"].isNotNull(), F.struct(x["message"].alias("text"))).alias("message"), place(x["path"], x["line"]).alias("physicalLocation"))))
    result = F.struct(rule.alias("ruleId"), level.alias("level"), F.struct(F.coalesce("message", F.lit("")).alias("text")).alias("message"), places.alias("locations"), related.alias("relatedLocations"))
    rows = numbered(findings, "_at", ["repo"], [F.col("path"), F.col("rule_id"), F.col("line"), F.col("message")])
    rows = rows.select("repo", F.floor((F.col("_at") - 1) / most).alias("part"), F.struct("_at", result.alias("x")).alias("r"), F.struct(rule.alias("id"), name.alias("name")).alias("rule"))
    held = rows.groupBy("repo", "part").agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["x"]).alias("results"), F.sort_array(F.collect_set("rule")).alias("rules"))
    run = F.struct(F.struct(F.struct(F.lit("corpusmill").alias("name"), "rules").alias("driver")).alias("tool"), "results")
    return held.select("repo", "part", F.size("rules").alias("n_rules"), F.size("results").alias("n_results"), F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))
