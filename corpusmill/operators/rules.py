"""Rule evaluation: each function is one shape of rule over lines, facts, properties or findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.storage import cut
from corpusmill.functions.text import prefixes
from corpusmill.operators.graph import reach


def rule_catalog(spark: SparkSession, rules: list[tuple], disabled=()) -> DataFrame:
    """rule_id, title, severity, category, enabled; unknown ids in disabled are an error."""
    unknown = set(disabled) - {r[0] for r in rules}
    if unknown:
        raise ValueError(f"unknown rules: {', '.join(sorted(unknown))}")
    frame = spark.createDataFrame([(*r, r[0] not in disabled) for r in rules], "rule_id string, title string, severity string, category string, enabled boolean")
    return frame


def severity_states(catalog: DataFrame) -> DataFrame:
    """Per severity: rules, enabled rules, and whether all are disabled."""
    return catalog.groupBy("severity").agg(F.count("*").alias("rules"), F.count_if("enabled").alias("enabled_rules")).withColumn("fully_disabled", F.col("enabled_rules") == 0)


def rule_scan(lines: DataFrame, rules: list[dict]) -> DataFrame:
    """Findings of line-local rules in one pass: the rule table becomes columns, so lines are read once.

    A rule: rule_id, severity, category, pattern, and if need be literal (a cheap test first), unless, path and owner (patterns
    for the file's path and for the column owner). Tables of many rules go by catalog.line_facts instead."""

    def hit(r):
        text = F.col("text")
        test = text.rlike(r["pattern"])
        if r.get("literal"):
            test = text.contains(r["literal"]) & test
        if r.get("unless"):
            test = test & ~text.rlike(r["unless"])
        if r.get("path"):
            test = test & F.col("path").cast("string").rlike(r["path"])
        if r.get("owner"):
            test = test & F.coalesce(F.col("owner").rlike(r["owner"]), F.lit(False))
        return F.when(test, F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity"), F.lit(r["category"]).alias("category"), F.regexp_extract(text, r["pattern"], 0).alias("evidence")))

    found = F.filter(F.array(*map(hit, rules)), lambda x: x.isNotNull())
    any_hit = reduce(lambda a, b: a | b, [F.col("text").contains(r["literal"]) if r.get("literal") else F.col("text").rlike(r["pattern"]) for r in rules])
    return lines.where(any_hit).select("repo", "path", "line", F.explode(found).alias("f")).select("repo", "path", "line", "f.*")


def rule_missing_guard(facts: DataFrame, trigger: str, guard: str, scope=("repo", "scope")) -> DataFrame:
    """Scopes with the trigger and without the guard; the first trigger's place."""
    held = facts.where(F.col("kind").isin(trigger, guard)).groupBy(*scope).agg(F.min(F.when(F.col("kind") == trigger, F.col("place"))).alias("place"), F.bool_or(F.col("kind") == guard).alias("guarded"))
    return held.where("place is not null and not guarded").drop("guarded")


def rule_missing_enabler(facts: DataFrame, usage: str, enabler: str, repo: str = "repo") -> DataFrame:
    """Repos that use something nowhere enabled in them; the first use carries the finding."""
    used = facts.where(F.col("kind") == usage).groupBy(repo).agg(F.min("place").alias("place"))
    return used.join(facts.where(F.col("kind") == enabler).select(repo).distinct(), repo, "left_anti")


def rule_cooccurrence(facts: DataFrame, together: list[str], absent: list[str] = (), scope=("repo", "scope")) -> DataFrame:
    """Scopes that hold all kinds of the first list and none of the second."""
    kinds = [*together, *absent]
    held = facts.where(F.col("kind").isin(kinds)).groupBy(*scope).agg(*[F.bool_or(F.col("kind") == k).alias(f"k{i}") for i, k in enumerate(kinds)])
    test = reduce(lambda a, b: a & b, [F.col(f"k{i}") if i < len(together) else ~F.col(f"k{i}") for i in range(len(kinds))])
    return held.where(test).select(*scope)


def rule_duplicate_key(rows: DataFrame, key: list[str], scope: list[str], place: str) -> DataFrame:
    """Keys more than once in a scope, with the count and the first and last place."""
    return rows.groupBy(*scope, *key).agg(F.count("*").alias("n"), F.min(place).alias("first_place"), F.max(place).alias("last_place")).where("n > 1")


def rule_threshold(facts: DataFrame, min_count: int, scope: list[str], owner: str | None = None, min_owners: int = 1) -> DataFrame:
    """Scopes with at least min_count facts (of at least min_owners owners)."""
    aggs = [F.count("*").alias("n")] + ([F.countDistinct(owner).alias("owners")] if owner else [])
    held = facts.groupBy(*scope).agg(*aggs).where(F.col("n") >= min_count)
    return held.where(F.col("owners") >= min_owners) if owner else held


def rule_fact_join(uses: DataFrame, decls: DataFrame, on: list[str], owner: str) -> DataFrame:
    """Uses of a declared name; names with several owners are ambiguous and stay silent."""
    clear = decls.groupBy(*on).agg(F.countDistinct(owner).alias("_n"), F.min(owner).alias(owner)).where("_n = 1").drop("_n")
    return uses.join(clear, on)


def rule_self_call(calls: DataFrame, members: DataFrame) -> DataFrame:
    """Calls to a marked member of the caller's own class, if name and arity name one member; private, static, final ones do not count."""
    clear = members.groupBy("owner", "name", "arity").agg(F.count("*").alias("_n"), F.bool_or("marked").alias("marked"), F.bool_or("excluded").alias("excluded")).where("_n = 1 and marked and not excluded").select("owner", "name", "arity")
    return calls.join(clear, ["owner", "name", "arity"])


def rule_caller_boundary(members: DataFrame, calls: DataFrame) -> DataFrame:
    """Members (member, boundary, needs, and barrier where there is one) that need a boundary and have none, neither themselves nor in any
    caller, over any number of calls (caller, callee).

    What a boundary calls runs inside it, and so on, until a barrier: a member that is called but does not run inside its caller's boundary. A
    caller that is null or no member is not resolved and may have a boundary; it silences what it calls in the same way. Each round
    follows the calls of the members found last."""
    barrier = F.coalesce("barrier", F.lit(False)) if "barrier" in members.columns else F.lit(False)
    named = cut(members.groupBy("member").agg(F.bool_or("boundary").alias("boundary"), F.bool_or(barrier).alias("barrier")))
    open_ = named.where("not boundary and not barrier").select("member")
    inside = calls.select("caller", F.col("callee").alias("member")).distinct().join(open_, "member", "left_semi")
    inside = cut(inside.join(named.select(F.col("member").alias("caller"), F.col("boundary").alias("held")), "caller", "left"))
    first = inside.where(F.coalesce("held", F.lit(True))).select("member")
    steps = cut(inside.where(~F.coalesce("held", F.lit(True))).select(F.col("caller").alias("src"), F.col("member").alias("dst")))
    safe = reach(steps, first.select(F.lit(0).alias("origin"), F.col("member").alias("node"))).select(F.col("node").alias("member"))
    return members.where("needs and not boundary").join(safe, "member", "left_anti").select("member")


def rule_outside_scope(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (module, package) in no root of their module, nor below one; a module without roots uses all roots."""
    own = roots.select("module", F.col("root").alias("prefix")).distinct()
    free = rows.join(roots.select("module").distinct(), "module", "left_anti").select("module").distinct()
    steps = rows.withColumn("prefix", F.explode(prefixes(F.col("package"), ".")))
    inside_own = steps.join(own, ["module", "prefix"], "left_semi").select("module", "package").distinct()
    inside_any = steps.join(free, "module", "left_semi").join(roots.select(F.col("root").alias("prefix")).distinct(), "prefix", "left_semi").select("module", "package").distinct()
    return rows.join(inside_own.unionByName(inside_any), ["module", "package"], "left_anti")


def collapse_roots(roots: DataFrame) -> DataFrame:
    """The broadest of nested roots per module."""
    steps = roots.withColumn("prefix", F.explode(prefixes(F.col("root"), "."))).where("prefix <> root")
    nested = steps.join(roots.select("module", F.col("root").alias("prefix")), ["module", "prefix"], "left_semi").select("module", "root").distinct()
    return roots.join(nested, ["module", "root"], "left_anti")


PROFILES = {"prod": "PROD", "production": "PROD", "staging": "PROD", "test": "TEST", "ci": "TEST", "it": "TEST", "integration-test": "TEST"}


def rule_property(properties: DataFrame, predicates: list[dict]) -> DataFrame:
    """Findings of property rules: rule_id, severity, key test (equals, prefix or contains), value pattern, profile class."""
    profile = F.create_map(*[F.lit(x) for kv in PROFILES.items() for x in kv])[F.lower("profile")]
    kind = F.when(F.col("profile").isNull(), "DEFAULT").otherwise(F.coalesce(profile, F.lit("OTHER")))

    def hit(r):
        key = F.col("name")
        test = key == r["equals"] if "equals" in r else key.startswith(r["prefix"]) if "prefix" in r else key.contains(r["contains"])
        if "value" in r:
            test = test & F.col("value").cast("string").rlike(r["value"])
        if "profiles" in r:
            test = test & kind.isin(r["profiles"])
        return F.when(test, F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity")))

    found = F.filter(F.array(*map(hit, predicates)), lambda x: x.isNotNull())
    return properties.select("*", F.explode(found).alias("f")).select("repo", "name", "value", "profile", "f.*")


def rule_version(build: DataFrame, resolved: DataFrame, needs: dict[int, int]) -> DataFrame:
    """Modules whose version (resolved before declared) has a major that needs a higher platform than theirs; unreadable majors are silent."""
    major = F.expr("try_cast(split(version, '[.]')[0] as int)")
    rows = build.join(resolved, "module", "left").withColumn("version", F.coalesce("resolved_version", "declared_version")).withColumn("major", major)
    need = F.create_map(*[F.lit(x) for kv in needs.items() for x in kv])[F.col("major")]
    return rows.where(need.isNotNull() & (F.col("platform") < need)).select("module", "version", "major", "platform", need.alias("needed"))


def rule_version_pair(versions: DataFrame, rules: list[dict]) -> DataFrame:
    """module, rule_id, major, other_major, least: modules where a component is at a major (or merely there, without one in the
    rule) and another component's major lies below what that needs. versions: module, component, version, resolved.

    A rule: rule_id, component, major, other, least. Of several versions of a component in a module the resolved one counts, then
    the highest; unreadable majors, and components that are not there, are silent."""
    major = F.expr("try_cast(regexp_extract(version, '^([0-9]+)', 1) as int)")
    order = Window.partitionBy("module", "component").orderBy(F.desc("resolved"), F.desc_nulls_last("major"))
    held = versions.withColumn("major", major).withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select("module", "component", "major")
    table = versions.sparkSession.createDataFrame([(r["rule_id"], r["component"], r.get("major"), r["other"], r["least"]) for r in rules], "rule_id string, component string, needs int, other string, least int")
    uses = held.join(table, "component").where("needs is null or major = needs").select("module", "rule_id", "major", "other", "least")
    return uses.join(held.select("module", F.col("component").alias("other"), F.col("major").alias("other_major")), ["module", "other"]).where("other_major < least").select("module", "rule_id", "major", "other_major", "least")


def rule_presence(inventory: DataFrame, present: list[str], absent: list[str], scope: str = "repo") -> DataFrame:
    """Repos with all kinds of the first list and none of the second."""
    return rule_cooccurrence(inventory, present, absent, (scope,))


def rank_first(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")
