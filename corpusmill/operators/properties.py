"""Property tables: names, secrets, references, prefixes, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.storage import cut, discard
from corpusmill.functions.text import kebab, normal_name, prefixes

# Parts of names that mark a secret.
SECRET_MARKERS = [
    "password", "passwd", "secret", "client-secret", "api-key", "apikey", "access-key", "private-key", "credential", "credentials", "authorization",
    "api-token", "access-token", "refresh-token", "bearer-token", "auth-token", "oauth-token", "github-token", "signing-key", "jwt-secret",
]
# Parts of names that tell of tokens, but of no secret.
HARMLESS_MARKERS = [
    "max-output-tokens", "max-tokens", "token-limit", "token-count", "token-budget", "tokens-per-minute", "tokens-per-request", "tokenizer", "token-window",
    "output-tokens", "input-tokens", "input-token-budget", "output-token-budget",
]
# Last segments that name the secret itself, and ends of such segments behind - or _.
SECRET_LEAVES = ["password", "passwd", "secret", "credential", "credentials", "authorization", "token", "pat", "apikey", "clientsecret"]
SECRET_LEAF_ENDS = ["password", "passwd", "secret", "token"]
SECRET_KEY_WORDS = ["api", "access", "private", "signing"]
# Defaults that are no better than none, and ones that only say that a value has to be set.
WEAK_DEFAULTS = ["admin", "password", "passwd", "changeme", "changeit", "secret", "default", "root", "token", "key"]
SAFE_SENTINELS = ["CHANGE_ME_OR_SET_ENV", "MUST_BE_SET", "REQUIRED", "NOT_CONFIGURED", "SET_VIA_ENV", "SET_ME"]


def normalize_names(df: DataFrame, column: str = "name") -> DataFrame:
    return df.withColumn("name_norm", normal_name(F.col(column))).withColumn("name_kebab", kebab(F.trim(column)))


def is_sensitive(name: Column) -> Column:
    n = F.lower(name)
    marked = n.rlike("|".join(SECRET_MARKERS)) | n.rlike(r"(^|[._\[\]-])pat([._\[\]-]|$)") | n.rlike(r"[.-]token$|\.token\.|-token-")
    return marked & ~n.rlike("|".join(HARMLESS_MARKERS))


def is_likely_secret(name: Column) -> Column:
    """Whether the last segment names a secret itself, not something about one."""
    n = F.lower(F.trim(name))
    leaf = F.regexp_extract(n, r"([^.\]]*)$", 1)
    ends = "|".join(SECRET_LEAF_ENDS + [f"{w}[-_]key" for w in SECRET_KEY_WORDS])
    whole = "|".join(SECRET_LEAVES + [f"{w}[-_]key" for w in SECRET_KEY_WORDS])
    return leaf.rlike(f"^({whole})$|[-_]({ends})$") & ~n.rlike("|".join(HARMLESS_MARKERS))


def redact_secrets(properties: DataFrame) -> DataFrame:
    """value of sensitive names as [redacted], unless it is only a reference to the environment."""
    hide = is_sensitive(F.col("name")) & ~F.coalesce(F.trim("value").rlike(r"^\$\{[A-Z][A-Z0-9_]*\}$"), F.lit(False))
    return properties.withColumn("sensitive", is_sensitive(F.col("name"))).withColumn("value", F.when(hide, "[redacted]").otherwise(F.col("value")))


def secret_values(properties: DataFrame) -> DataFrame:
    """Of likely secrets: verdict LITERAL, WEAK_DEFAULT, DEFAULT, SENTINEL or REFERENCE by the value."""
    default = F.trim(F.regexp_extract(F.trim("value"), r"^\$\{[^:{}]+:([^{}]*)\}$", 1))
    sentinel = F.translate(F.upper(default), "-", "_").isin(SAFE_SENTINELS)
    verdict = (
        F.when(F.trim("value").rlike(r"^\$\{[^:{}]+\}$"), "REFERENCE").when(F.lower(default).isin(WEAK_DEFAULTS), "WEAK_DEFAULT").when(sentinel, "SENTINEL")
        .when(default != "", "DEFAULT").when(F.trim("value").rlike(r"^\$\{"), "REFERENCE").otherwise("LITERAL")
    )
    return properties.where(is_likely_secret(F.col("name")) & (F.trim("value") != "")).withColumn("verdict", verdict)


def match_references(properties: DataFrame, refs: DataFrame) -> DataFrame:
    """All names of either side, with the number of rows on each and where the name is."""
    p = properties.groupBy("name").agg(F.count("*").alias("configured"))
    r = refs.groupBy("name").agg(F.count("*").alias("referenced"))
    both = p.join(r, "name", "full_outer")
    origin = F.when(F.col("referenced").isNull(), "CONFIGURED_ONLY").when(F.col("configured").isNull(), "REFERENCED_ONLY").otherwise("BOTH")
    return both.select("name", F.coalesce("configured", F.lit(0)).alias("configured"), F.coalesce("referenced", F.lit(0)).alias("referenced"), origin.alias("origin"))


def owning_prefix(properties: DataFrame, owners: DataFrame) -> DataFrame:
    """name, prefix: the longest known prefix strictly above each distinct name; names are exploded, so the join has equal keys.

    An owner with a true column map_typed also owns the names that go on with [ behind it."""
    names = properties.select("name").distinct()
    steps = names.select("name", F.explode(prefixes(F.col("name"), ".")).alias("prefix")).where("prefix <> name")
    found = steps.join(owners.select("prefix").distinct(), "prefix", "left_semi")
    if "map_typed" in owners.columns:
        opens = F.filter(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.when(F.substr("name", i, F.lit(1)) == "[", F.substr("name", F.lit(1), i - 1))), lambda x: x.isNotNull())
        mapped = names.where(F.col("name").contains("[")).select("name", F.explode(opens).alias("prefix"))
        found = found.unionByName(mapped.join(owners.where("map_typed").select("prefix").distinct(), "prefix", "left_semi"))
    return found.groupBy("name").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def _marked(names: DataFrame, other: DataFrame, mark: str) -> DataFrame:
    return names.join(other.select("name").distinct().withColumn(mark, F.lit(True)), "name", "left")


def classify_property(properties: DataFrame, definitions: DataFrame, owners: DataFrame, catalog: DataFrame, map_owners: DataFrame, known: DataFrame, refs: DataFrame, third_party: DataFrame) -> DataFrame:
    """kind of each distinct name, by precedence: a custom definition or a prefix of one, the catalogue (name, third_party), below a
    map property (prefix), known (name, third_party), referenced by a condition or otherwise (name, conditional), below a
    third-party prefix, unknown."""
    names = properties.select("name").distinct()
    out = _marked(names, definitions, "d").join(owning_prefix(properties, owners), "name", "left")
    out = out.join(catalog.groupBy("name").agg(F.bool_or("third_party").alias("c")), "name", "left")
    out = out.join(owning_prefix(properties, map_owners.withColumn("map_typed", F.lit(True))).withColumnRenamed("prefix", "m"), "name", "left")
    out = out.join(known.groupBy("name").agg(F.bool_or("third_party").alias("k")), "name", "left")
    out = out.join(refs.groupBy("name").agg(F.bool_or("conditional").alias("r")), "name", "left")
    out = out.join(owning_prefix(properties, third_party).withColumnRenamed("prefix", "t"), "name", "left")
    kind = (
        F.when(F.col("d") | F.col("prefix").isNotNull(), "CUSTOM_CONFIGURATION_PROPERTIES").when(F.col("c"), "THIRD_PARTY").when(F.col("c").isNotNull(), "SPRING_BOOT")
        .when(F.col("m").isNotNull(), "SPRING_BOOT_MAP_PROPERTY").when(F.col("k"), "THIRD_PARTY").when(F.col("k").isNotNull(), "SPRING_BOOT").when(F.col("r"), "CONDITIONAL_PROPERTY")
        .when(F.col("r").isNotNull(), "CODE_REFERENCED").when(F.col("t").isNotNull(), "THIRD_PARTY").otherwise("UNKNOWN")
    )
    return out.select("name", kind.alias("kind"))


def configuration_summary(properties: DataFrame, kinds: DataFrame, refs: DataFrame) -> DataFrame:
    """Per repo: rows, framework, custom and unknown ones by kind, sensitive ones, references (repo), and the profiles in order."""
    rows = properties.join(kinds, "name", "left")
    kind = F.col("kind")
    held = rows.groupBy("repo").agg(
        F.count("*").alias("properties"), F.count_if(kind.isin("SPRING_BOOT", "SPRING_BOOT_MAP_PROPERTY")).alias("known"), F.count_if(kind == "CUSTOM_CONFIGURATION_PROPERTIES").alias("custom"),
        F.count_if(kind == "UNKNOWN").alias("unknown"), F.count_if(is_sensitive(F.col("name"))).alias("sensitive"), F.array_sort(F.collect_set(F.when(F.trim("profile") != "", F.col("profile")))).alias("profiles"),
    )
    return held.join(refs.groupBy("repo").agg(F.count("*").alias("references")), "repo", "left").withColumn("references", F.coalesce("references", F.lit(0)))


def profile_drift(properties: DataFrame, relevant: str = ".*") -> DataFrame:
    """Names set in two profiles or more with different values, and as evidence each profile's values in order.

    Rows without a profile count for values, not for profiles. Evidence holds distinct pairs only."""
    rows = properties.where(F.col("name").rlike(relevant))
    pair = F.when(F.col("profile").isNotNull(), F.concat_ws("=", "profile", F.coalesce("value", F.lit(""))))
    held = rows.groupBy("repo", "name").agg(F.countDistinct("profile").alias("n_profiles"), F.countDistinct("value").alias("n_values"), F.array_sort(F.collect_set(pair)).alias("evidence"))
    return held.where("n_profiles >= 2 and n_values > 1")


def profile_comparison(properties: DataFrame, profiles: list[str]) -> DataFrame:
    """name, one column per profile (last value by place wins), changed."""
    last = properties.where(F.col("profile").isin(profiles)).groupBy("name", "profile").agg(F.max_by("value", "place").alias("value"))
    wide = last.groupBy("name").pivot("profile", profiles).agg(F.first("value"))
    values = F.array_distinct(F.array_compact(F.array(*profiles)))
    return wide.withColumn("changed", F.size(values) > 1)


def sensitive_in_many(properties: DataFrame) -> DataFrame:
    """Sensitive names at two places or more; WARNING if one value is given in the open."""
    rows = properties.where(is_sensitive(F.col("name"))).groupBy("repo", "name").agg(F.count("*").alias("places"), F.bool_or(~F.col("value").rlike(r"^\$\{.*\}$")).alias("open")).where("places >= 2")
    return rows.select("repo", "name", "places", F.when(F.col("open"), "WARNING").otherwise("INFO").alias("severity"), F.when(F.col("open"), "SECURITY").otherwise("PROFILE_DRIFT").alias("category"))


def conditional_matrix(refs: DataFrame, properties: DataFrame) -> DataFrame:
    """Per conditional name: how many match when missing, and configured values that no condition expects."""
    held = refs.groupBy("name").agg(F.count_if("match_if_missing").alias("missing_matches"), F.collect_set("expected_value").alias("expected"))
    values = properties.select("name", "value").distinct().join(held, "name")
    odd = values.where(~F.array_contains("expected", F.col("value"))).groupBy("name").agg(F.count("*").alias("unexpected"))
    return held.select("name", "missing_matches").join(odd, "name", "left").select("name", "missing_matches", F.coalesce("unexpected", F.lit(0)).alias("unexpected"))


def missing_override(properties: DataFrame, base_profile: str | None, override_profiles: list[str], key: str | None = None, value: str | None = None) -> DataFrame:
    """Names that the base profile (null: rows without one) sets and none of the others does; of names and values that match the patterns."""
    base = properties.where(F.col("profile").isNull() if base_profile is None else F.col("profile") == base_profile)
    for column, pattern in (("name", key), ("value", value)):
        if pattern is not None:
            base = base.where(F.col(column).rlike(pattern))
    other = properties.where(F.col("profile").isin(override_profiles)).select("repo", "name")
    return base.select("repo", "name").distinct().join(other, ["repo", "name"], "left_anti")


def resolve_placeholders(properties: DataFrame) -> DataFrame:
    """name, value with ${name:default} expanded by other properties, unresolved: whether one is left.

    Values fall into text and placeholders, the innermost first. In a round all placeholders of a value meet the names in one join;
    names that are expanded already give their values, unknown names their defaults, and without one they stay as they are. So names are
    expanded in the order in which they depend on each other, in as many rounds as the longest chain has names. When a round
    expands nothing, what is left are circles of names and what leads to them; their placeholders stay."""
    pattern = r"\$\{([^:{}$]*)(:[^{}$]*)?\}"
    shut = "\u0001"  # in place of the $ of a placeholder that stays
    names = properties.groupBy("name").agg(F.min("value").alias("value"))
    work = cut(names.select("name", "value", (~F.coalesce(F.col("value").rlike(pattern), F.lit(False))).alias("done")))
    while True:
        open_ = work.where(~F.col("done"))
        texts = F.split("value", pattern, -1)
        found = [F.regexp_extract_all("value", F.lit(pattern), F.lit(k)) for k in (0, 1, 2)]
        parts = open_.select("name", texts.alias("texts"), F.posexplode(F.arrays_zip(*(f.alias(n) for f, n in zip(found, ("whole", "key", "rest"))))).alias("pos", "part"))
        parts = parts.select("name", "texts", "pos", "part.whole", F.trim("part.key").alias("key"), "part.rest")
        known = work.select(F.col("name").alias("key"), F.col("value").alias("given"), F.col("done").alias("ready"))
        new = F.when(F.col("ready"), F.coalesce("given", F.lit(""))).when(F.col("ready").isNotNull(), F.col("whole"))
        new = new.when(F.col("rest") != "", F.substring("rest", 2, F.length("rest"))).otherwise(F.concat(F.lit(shut), F.substring("whole", 2, F.length("whole"))))
        filled = parts.join(known, "key", "left").select("name", "texts", "pos", "whole", new.alias("new"))
        filled = filled.groupBy("name", "texts").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("new"), F.bool_or(F.col("new") != F.col("whole")).alias("moved"))
        last = F.array_append(F.transform("new", lambda x: x["new"]), F.lit(""))
        value = F.array_join(F.zip_with("texts", last, lambda t, n: F.concat(t, n)), "")
        filled = cut(filled.select("name", value.alias("value"), (~value.rlike(pattern)).alias("done"), "moved"))
        stuck = filled.where("moved").isEmpty()
        before, work = work, cut(work.where("done").unionByName(filled.drop("moved")))
        discard(before)
        discard(filled)
        if stuck:
            break
    out = F.regexp_replace("value", shut, r"\$")
    return work.select("name", out.alias("value"), F.coalesce(out.rlike(pattern), F.lit(False)).alias("unresolved"))


def unused_prefixes(owners: DataFrame, properties: DataFrame) -> DataFrame:
    """Prefixes with no configured name at or below them."""
    used = properties.select("name").distinct().select(F.explode(prefixes(F.col("name"), ".")).alias("prefix")).distinct()
    return owners.select("prefix").distinct().join(used, "prefix", "left_anti")


def unknown_properties(kinds: DataFrame, properties: DataFrame) -> DataFrame:
    """Per repo: distinct names of kind UNKNOWN, and the first of them."""
    names = properties.select("repo", "name").distinct().join(kinds.where("kind = 'UNKNOWN'").select("name"), "name", "left_semi")
    return names.groupBy("repo").agg(F.count("*").alias("unknown"), F.min("name").alias("first_name"))


def deprecated_properties(properties: DataFrame, catalog: DataFrame) -> DataFrame:
    return properties.join(catalog.where("deprecated").select("name", "reason"), "name")


def dominant_namespace(properties: DataFrame, least: int = 3) -> DataFrame:
    """The most frequent two-part prefix of each repo, if it is frequent enough."""
    two = F.regexp_extract("name", r"^([^.]+[.][^.]+)", 1)
    held = properties.withColumn("namespace", two).where("namespace <> ''").groupBy("repo", "namespace").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    order = Window.partitionBy("repo").orderBy(F.desc("n"), "namespace")
    return held.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def review_signals(properties: DataFrame, refs: DataFrame, kinds: DataFrame) -> DataFrame:
    """Per repo: sensitive names, names that differ between profiles, names the code refers to, names of unknown kind."""
    per = properties.groupBy("repo", "name").agg(F.countDistinct("value").alias("values")).join(refs.select("name").distinct().withColumn("r", F.lit(1)), "name", "left").join(kinds, "name", "left")
    return per.groupBy("repo").agg(
        F.count_if(is_sensitive(F.col("name"))).alias("sensitive"), F.count_if(F.col("values") > 1).alias("changed"), F.count_if(F.col("r") == 1).alias("referenced"), F.count_if(F.col("kind") == "UNKNOWN").alias("unknown")
    )


def filter_properties(properties: DataFrame, profile: str | None = None, sensitive: bool | None = None, text: str | None = None, kind: str | None = None, file: str | None = None, focus: str | None = None, refs: DataFrame | None = None) -> DataFrame:
    """Rows that meet all that is given; kind and file go by the columns kind and file.

    focus: sensitive, unknown, changed (more than one value of a name in a repo, over all rows) or referenced (in refs)."""
    whole = properties
    if profile is not None:
        properties = properties.where(F.col("profile") == profile)
    if sensitive is not None:
        properties = properties.where(is_sensitive(F.col("name")) == sensitive)
    if kind is not None:
        properties = properties.where(F.col("kind") == kind)
    if file is not None:
        properties = properties.where(F.col("file") == file)
    if focus == "sensitive":
        properties = properties.where(is_sensitive(F.col("name")))
    elif focus == "unknown":
        properties = properties.where("kind = 'UNKNOWN'")
    elif focus == "changed":
        many = whole.groupBy("repo", "name").agg(F.countDistinct("value").alias("n")).where("n > 1").select("repo", "name")
        properties = properties.join(many, ["repo", "name"], "left_semi")
    elif focus == "referenced":
        properties = properties.join(refs.select("name").distinct(), "name", "left_semi")
    if text:
        properties = properties.where(F.lower(F.concat_ws(" ", "name", "value")).contains(text.lower()))
    return properties
