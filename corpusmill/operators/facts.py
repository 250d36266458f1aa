"""Fact extraction and inventories over lines and facts (E1-E8), and JSON inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.storage import cut, joined
from corpusmill.operators.rules import rank_first


def extract_facts(lines: DataFrame, patterns: dict[str, str], owner_kind: str | None = None) -> DataFrame:
    """repo, path, line, kind, name of every match (group 1) of every pattern, and the last owner_kind fact before it."""

    def named(kind: str):
        return lambda name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))

    hits = F.flatten(F.array(*[F.transform(F.regexp_extract_all("text", F.lit(p), 1), named(k)) for k, p in patterns.items()]))
    facts = lines.select("repo", "path", "line", F.posexplode(hits).alias("seq", "f")).select("repo", "path", "line", "seq", "f.kind", "f.name")
    if owner_kind is None:
        return facts
    before = Window.partitionBy("repo", "path").orderBy("line", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return facts.withColumn("owner", F.last(F.when(F.col("kind") == owner_kind, F.col("name")), ignorenulls=True).over(before))


def component_inventory(facts: DataFrame, stereotypes: list[str], main: str) -> DataFrame:
    """Owners (repo, path, owner) with a stereotype among their annotations (line, seq, name): the main one always wins, else the
    first in annotation order. annotations: all of the owner's, once each, in order."""
    first = facts.groupBy("repo", "path", "owner", "name").agg(F.min(F.struct("line", "seq")).alias("at"))
    held = first.groupBy("repo", "path", "owner").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("annotations"))
    kind = F.when(F.array_contains("annotations", main), main).otherwise(F.try_element_at(F.filter("annotations", lambda x: x.isin(stereotypes)), F.lit(1)))
    return held.withColumn("type", kind).where("type is not null")


def join_path(base: Column, tail: Column) -> Column:
    """/base/tail with single slashes and none at the end."""
    joined = F.regexp_replace(F.concat(F.lit("/"), F.coalesce(base, F.lit("")), F.lit("/"), F.coalesce(tail, F.lit(""))), "/+", "/")
    return F.when(joined == "/", joined).otherwise(F.regexp_replace(joined, "/$", ""))


def endpoint_paths(class_paths: DataFrame, method_paths: DataFrame) -> DataFrame:
    """Class path times method path of each owner; a missing side is empty."""
    return method_paths.join(class_paths, "owner", "left").select("owner", "method", join_path(F.col("class_path"), F.col("method_path")).alias("endpoint"))


def attribute(text: Column, names: str) -> Column:
    """The text of an annotation's attribute (one of the names, split by |): quoted, in braces, or plain; empty if there is none."""
    return F.regexp_extract(text, rf"(?:^|[(,\s])(?:{names})\s*=\s*(\{{[^}}]*\}}|\"[^\"]*\"|[^,)\s]+)", 1)


def listener_inventory(facts: DataFrame) -> DataFrame:
    """One row per listener and destination, with the group id: from the attributes of its annotation (repo, listener, broker,
    attributes). Lists in braces and comma lists are split; no destination leaves a null."""
    text = attribute(F.col("attributes"), "topics|queues|destination")
    quoted = F.regexp_extract_all(text, F.lit('"([^"]*)"'), F.lit(1))
    parts = F.filter(F.flatten(F.transform(quoted, lambda x: F.split(F.trim(x), r"\s*,\s*"))), lambda x: x != "")
    group = F.nullif(F.regexp_replace(attribute(F.col("attributes"), "groupId|group"), '"', ""), F.lit(""))
    return facts.select("repo", "listener", "broker", group.alias("group_id"), F.explode_outer(parts).alias("destination"))


def schedule_inventory(facts: DataFrame) -> DataFrame:
    """Scheduled members with trigger, its value and zone, and asynchronous members (trigger async); enabled: whether the repo
    switches scheduling (for asynchronous members: asynchronous calls) on.

    facts: repo, member, kind (schedule, async, enable, enable_async), value (the annotation's attributes)."""
    on = facts.groupBy("repo").agg(F.bool_or(F.col("kind") == "enable").alias("_on"), F.bool_or(F.col("kind") == "enable_async").alias("_async"))
    v = F.col("value")
    plain = lambda name: F.nullif(F.regexp_replace(attribute(v, name), '"', ""), F.lit(""))
    kinds = ("cron", "fixedRate", "fixedDelay")
    trigger = F.coalesce(*[F.when(v.rlike(rf"(^|[(,\s]){k}(String)?\s*="), k) for k in kinds], F.lit("none"))
    value = F.coalesce(*[F.when(trigger == k, plain(f"{k}|{k}String")) for k in kinds])
    timed = facts.where("kind = 'schedule'").select("repo", "member", trigger.alias("trigger"), value.alias("trigger_value"), plain("zone").alias("zone"))
    none = F.lit(None).cast("string")
    free = facts.where("kind = 'async'").select("repo", "member", F.lit("async").alias("trigger"), none.alias("trigger_value"), none.alias("zone"))
    return timed.unionByName(free).join(on, "repo").withColumn("enabled", F.when(F.col("trigger") == "async", F.col("_async")).otherwise(F.col("_on"))).drop("_on", "_async")


# Names of properties of the machine and the build tool, whose look-ups tell nothing.
SYSTEM_PREFIXES = ["java.", "os.", "user.", "sun.", "file.", "awt.", "jdk.", "org.gradle.", "systemprop."]
SYSTEM_NAMES = ["distributionurl", "distribution-url", "path.separator", "line.separator", "native.encoding"]


def property_references(lines: DataFrame) -> DataFrame:
    """type, name, default_value, required, expected_value, match_if_missing of the uses of properties in lines.

    VALUE: ${name:default}; LOOKUP: getProperty("name", "default") and getenv("NAME"); CONDITION: conditional annotations.
    A use without a default is required. Look-ups of the machine's own properties are left out. Lines are dealt anew first: a table of few bytes
    comes in one piece, however many rows it has."""
    place, none = ["repo", "path", "line"], F.lit(None).cast("string")
    lines = lines.select(*place, "text").repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), *place)

    def uses(pattern: str):
        return lines.select(*place, F.explode(F.regexp_extract_all("text", F.lit(f"({pattern})"), 1)).alias("use"))

    u = F.col("use")
    value = uses(r"\$\{[^{}]+\}").select(*place, F.lit("VALUE").alias("type"), F.trim(F.regexp_extract(u, r"^\$\{([^:}]*)", 1)).alias("name"), F.when(u.contains(":"), F.regexp_extract(u, r"^\$\{[^:}]*:([^}]*)\}", 1)).alias("default_value"), none.alias("expected_value"), F.lit(None).cast("boolean").alias("match_if_missing"))
    second = F.nullif(F.regexp_extract(u, r'"[^"]*"\s*,\s*"([^"]*)"', 1), F.lit(""))
    look = uses(r'(?:getProperty|getRequiredProperty|getenv)\(\s*"[^"]+"(?:\s*,\s*"[^"]*")?').select(*place, F.lit("LOOKUP").alias("type"), F.trim(F.regexp_extract(u, r'"([^"]+)"', 1)).alias("name"), second.alias("default_value"), none.alias("expected_value"), F.lit(None).cast("boolean").alias("match_if_missing"))
    low = F.lower("name")
    look = look.where(~low.rlike("^(" + "|".join(p.replace(".", "[.]") for p in SYSTEM_PREFIXES) + ")") & ~low.isin(SYSTEM_NAMES))
    text = lambda names: F.regexp_replace(attribute(u, names), '"', "")
    prefix, key = text("prefix"), F.coalesce(F.nullif(text("name|value"), F.lit("")), F.regexp_extract(u, r'\(\s*"([^"]+)"', 1))
    cond = uses(r"@ConditionalOnProperty\([^)]*\)").select(*place, F.lit("CONDITION").alias("type"), F.when(prefix != "", F.concat(F.regexp_replace(prefix, "[.]$", ""), F.lit("."), key)).otherwise(key).alias("name"), none.alias("default_value"), F.nullif(text("havingValue"), F.lit("")).alias("expected_value"), (text("matchIfMissing") == "true").alias("match_if_missing"))
    required = F.when(F.col("type") == "CONDITION", ~F.col("match_if_missing")).otherwise(F.col("default_value").isNull())
    return value.unionByName(look).unionByName(cond).where("name <> ''").withColumn("required", required)


def best_base_url(endpoints: DataFrame, url_properties: DataFrame, least: int = 4, common: int = 64) -> DataFrame:
    """The URL property whose name tokens occur most often in an endpoint's hint, only if better than the runner-up.

    Names of the same tokens tie everywhere, so they go as one that cannot win. Tokens in at most `common` names join names
    directly. Of the other tokens endpoints and names have few different sets: each set of endpoints' tokens meets each set of names' once
    (see common_scores), and names with rare tokens too add what their common ones count. A name that also has a rare token at the
    endpoint scores more than its set of common tokens does, so it is never counted twice at the top."""
    split = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) >= least)
    named = url_properties.select("name", F.array_sort(F.array_distinct(split(F.col("name")))).alias("tokens")).groupBy("tokens").agg(F.min("name").alias("name"), F.countDistinct("name").alias("names"))
    named = named.select("name", "names", F.explode("tokens").alias("token"))
    spread = named.groupBy("token").agg(F.count("*").alias("held"))
    e = endpoints.select("endpoint", F.explode(split(F.col("hint"))).alias("token")).groupBy("endpoint", "token").agg(F.count("*").alias("n")).join(spread, "token")
    rare = F.col("held") <= common
    u = named.join(spread, "token").groupBy("name", "names").agg(F.collect_list(F.when(rare, F.col("token"))).alias("rare"), F.array_sort(F.collect_list(F.when(~rare, F.col("token")))).alias("shared"))
    points = e.where(~rare).groupBy("endpoint").agg(F.array_sort(F.collect_list(F.struct("held", "token", "n"))).alias("points"))
    direct = e.where(rare).join(u.select("name", "names", "shared", F.explode("rare").alias("token")), "token").groupBy("endpoint", "name", "names").agg(F.sum("n").alias("score"), F.any_value("shared").alias("shared"))
    direct = direct.join(points, "endpoint", "left").select("endpoint", "name", "names", (F.col("score") + F.coalesce(_points_of("points", "shared"), F.lit(0))).alias("score"))
    sets = u.where(F.size("shared") > 0).groupBy("shared").agg(F.min("name").alias("name"), F.sum("names").alias("names"))
    top = _first_alone(common_scores(points.select("points").distinct(), sets), "points")
    found = direct.unionByName(points.join(top, "points").select("endpoint", "name", "names", "score"))
    return _first_alone(found, "endpoint").where("names = 1").select("endpoint", "name", "score")


def _points_of(points: str, tokens: str) -> Column:
    """What the tokens count in points (held, token, n)."""
    return F.aggregate(F.filter(points, lambda p: F.array_contains(tokens, p["token"])), F.lit(0).cast("long"), lambda total, p: total + p["n"])


def _first_alone(scored: DataFrame, key: str) -> DataFrame:
    """key, score, name, names: the best score of each key, its first name and how many names have it."""
    tied = scored.groupBy(key, "score").agg(F.min("name").alias("name"), F.sum("names").alias("names"))
    return tied.groupBy(key).agg(F.max_by(F.struct("score", "name", "names"), "score").alias("b")).select(key, "b.*")


def common_scores(points: DataFrame, sets: DataFrame) -> DataFrame:
    """points, shared, name, names, score of the sets of name tokens (shared, name, names) that may be best for points (arrays of
    held, token, n, the rarest first).

    Sets that hold the rarest token are scored first. Another token is joined only where it and those after it count for as much as the
    best score so far: a set that holds none but the tokens left out can neither win nor tie."""
    by_token = sets.select("*", F.explode("shared").alias("token"))
    left = F.transform("points", lambda p, i: F.struct(p["token"].alias("token"), i.alias("place"), F.aggregate(F.slice("points", i + 1, F.size("points")), F.lit(0).cast("long"), lambda total, q: total + q["n"]).alias("left")))
    tokens = points.select("points", F.inline(left))
    score = _points_of("points", "shared").alias("score")

    def meet(some: DataFrame) -> DataFrame:
        return some.join(by_token, "token").select("points", "shared", "name", "names", score)

    first = meet(tokens.where("place = 0"))
    best = first.groupBy("points").agg(F.max("score").alias("best"))
    later = tokens.where("place > 0").join(best, "points", "left").where("left >= coalesce(best, 0)")
    return first.unionByName(meet(later)).distinct()


def pick_version(candidates: DataFrame) -> DataFrame:
    """The first hit of the highest confidence per module."""
    rank = F.when(F.col("confidence") == "HIGH", 3).when(F.col("confidence") == "MEDIUM", 2).otherwise(1)
    return rank_first(candidates, ["module"], [F.desc(rank), F.col("seq")])


def flatten_json(df: DataFrame, json_col: str) -> DataFrame:
    """Rows (all columns, key, value) of the leaves at any depth: dotted names, items as key[i], null as ''.

    Empty objects and lists have no leaves. Text that is not JSON gives one row with null for key and value. Each level is a round
    that writes the nested values still open, so the number of rounds is the deepest nesting."""
    keep, spark = list(df.columns), df.sparkSession
    level = df.withColumn("_key", F.lit("")).withColumn("_v", F.try_parse_json(F.col(json_col)))
    none = F.lit(None).cast("string")
    parts = [cut(level.where("_v is null").select(*keep, none.alias("key"), none.alias("value")))]
    level = level.where("_v is not null")
    while True:
        kind = F.schema_of_variant("_v")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        tagged = cut(level.select(*keep, "_key", F.col("_v").cast("string").alias("_text"), nested.alias("_nested")))
        parts.append(cut(tagged.where("not _nested").select(*keep, F.col("_key").alias("key"), F.coalesce("_text", F.lit("")).alias("value"))))
        if tagged.where("_nested").isEmpty():
            return joined(parts)
        inner = tagged.where("_nested").withColumn("_v", F.parse_json("_text")).lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()).toDF("_pos", "_name", "_item"))
        key = F.when(F.col("_name").isNull(), F.concat("_key", F.lit("["), "_pos", F.lit("]"))).when(F.col("_key") == "", F.col("_name")).otherwise(F.concat_ws(".", "_key", "_name"))
        level = inner.select(*keep, key.alias("_key"), F.col("_item").alias("_v"))


def document_profile(flat: DataFrame, document: list[str], file_profile: str, keys=("spring.config.activate.on-profile", "spring.profiles")) -> DataFrame:
    """flat (key, value, the document's columns and file_profile) with the column profile: the first of a comma list under the first
    of the keys that the document sets, else what its file says."""
    first = lambda k: F.max(F.when((F.col("key") == k) & (F.trim("value") != ""), F.col("value")))
    named = flat.groupBy(*document).agg(F.nullif(F.trim(F.split(F.coalesce(*[first(k) for k in keys]), ",")[0]), F.lit("")).alias("_own"))
    return flat.join(named, document, "left").withColumn("profile", F.coalesce("_own", file_profile)).drop("_own")


def extract_findings(raw: DataFrame, column: str = "result") -> DataFrame:
    """Findings of worker JSON: an array, {findings}, or either of them under result; the first field present wins.

    Texts that are not JSON give none: see malformed_results."""
    v = F.try_parse_json(F.col(column))
    lists = [F.try_variant_get(v, path, "array<variant>") for path in ("$", "$.findings", "$.result", "$.result.findings", "$.result.result", "$.result.result.findings")]
    rows = raw.select("repo", F.explode(F.coalesce(*lists)).alias("f")).where(F.schema_of_variant("f").startswith("OBJECT"))

    def first(*paths: str) -> Column:
        is_text = lambda p: F.when(F.schema_of_variant(F.try_variant_get("f", f"$.{p}", "variant")) == "STRING", F.try_variant_get("f", f"$.{p}", "string"))
        return F.coalesce(*[F.nullif(is_text(p), F.lit("")) for p in paths])

    return rows.select(
        "repo", first("severity", "level").alias("severity"), first("ruleId", "rule", "ruleID", "rule.id").alias("rule_id"),
        first("sourceFile", "path", "location", "file", "primaryLocation.sourceFile", "primaryLocation.path", "primaryLocation.file").alias("path"), first("message", "title", "description").alias("message"),
    )


def malformed_results(raw: DataFrame, column: str = "result") -> DataFrame:
    """Rows whose text is there and not JSON."""
    return raw.where((F.trim(column) != "") & F.try_parse_json(F.col(column)).isNull())


def metadata_catalog(sources: DataFrame) -> DataFrame:
    """name (lower case), type, deprecated, reason, hints from metadata JSON; the source of the highest rank wins, in it the last entry.

    hints: the values that the sources name for the property, without repeats, in order."""
    item = "struct<name:string,type:string,deprecation:struct<reason:string>,deprecated:boolean>"
    parsed = F.from_json("json", f"struct<properties:array<{item}>,hints:array<struct<name:string,values:array<struct<value:string>>>>>")
    rows = sources.select("rank", F.posexplode(parsed["properties"]).alias("pos", "p"))
    rows = rows.select(F.lower("p.name").alias("name"), "rank", "pos", F.col("p.type").alias("type"), (F.coalesce("p.deprecated", F.lit(False)) | F.col("p.deprecation").isNotNull()).alias("deprecated"), F.col("p.deprecation.reason").alias("reason"))
    hints = sources.select(F.explode(parsed["hints"]).alias("h")).select(F.lower("h.name").alias("name"), F.explode("h.values").alias("v"))
    hints = hints.groupBy("name").agg(F.array_sort(F.collect_set("v.value")).alias("hints"))
    best = rank_first(rows.where("name is not null"), ["name"], [F.desc("rank"), F.desc("pos"), F.col("type")]).drop("rank", "pos")
    return best.join(hints, "name", "left")


_OF = "projectPath:string,configuration:string,group:string,artifact:string"
#: Table of a build-model report: the report's field, and the fields of its items.
BUILD_TABLES = {
    "projects": ("projects", "path:string,name:string,projectDir:string"),
    "plugins": ("plugins", "projectPath:string,pluginId:string,implementationClass:string"),
    "repositories": ("repositories", "projectPath:string,name:string,type:string,url:string"),
    "configurations": ("configurations", "projectPath:string,name:string,resolvable:boolean,consumable:boolean,dependencyCount:int,extendsFrom:array<string>"),
    "declared": ("declaredDependencies", f"{_OF},version:string,notation:string"),
    "resolved": ("resolvedDependencies", f"{_OF},version:string,direct:boolean,selectedReason:string"),
    "results": ("resolutionResults", "projectPath:string,configuration:string,attempted:boolean,successful:boolean,fallbackUsed:boolean,errorType:string,errorMessage:string,resolvedDependencyCount:int"),
    "conflicts": ("dependencyConflicts", f"{_OF},requestedVersions:array<string>,selectedVersion:string"),
    "source_sets": ("sourceSets", "projectPath:string,name:string,javaDirs:array<string>,resourceDirs:array<string>"),
    "tasks": ("tasks", "projectPath:string,name:string,group:string,description:string"),
    "toolchains": ("javaToolchains", "projectPath:string,languageVersion:string,vendor:string,implementation:string"),
}


def build_model_tables(reports: DataFrame, column: str = "json") -> dict[str, DataFrame]:
    """A table for each kind of item of build-model reports, one row per item, with the repo; see BUILD_TABLES."""
    return {name: reports.select("repo", F.explode(F.from_json(column, f"struct<{field}:array<struct<{item}>>>")[field]).alias("x")).select("repo", "x.*") for name, (field, item) in BUILD_TABLES.items()}
