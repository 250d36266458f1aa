"""Queries over property tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import properties as p
from corpusmill.operators import rules as r
from corpusmill.plans.bindings import PROP, load, plan, props

# Fixed values of the checks: names with a word that marks a secret are made of one part type.
SECRET = "secretive AS (SELECT repo, place, CASE WHEN profile = 'Brand#11' OR place % 7 = 0 THEN concat(name, '.password') ELSE name END AS name, profile, CASE WHEN place % 5 = 0 THEN '${ENV_VALUE}' ELSE value END AS value FROM prop)"
NAMES_UP = "ups AS (SELECT DISTINCT name, array_to_string(string_split(name, '.')[1:i], '.') AS prefix FROM (SELECT name, unnest(range(1, len(string_split(name, '.')) + 1)) AS i FROM (SELECT DISTINCT name FROM prop)))"
OWNERS = "owners AS (SELECT DISTINCT lower(p_type) AS prefix FROM part WHERE p_size < 25 AND p_brand < 'Brand#3' UNION SELECT concat(lower(p_type), '.none') FROM part WHERE p_partkey % 40 = 0)"


def secretive(spark, d):
    q = props(spark, d)
    return q.withColumn("name", F.when((F.col("profile") == "Brand#11") | (F.col("place") % 7 == 0), F.concat("name", F.lit(".password"))).otherwise(F.col("name"))).withColumn("value", F.when(F.col("place") % 5 == 0, "${ENV_VALUE}").otherwise(F.col("value")))


def owners(spark, d):
    part = load(spark, d, "part")
    some = part.where("p_size < 25 and p_brand < 'Brand#3'").select(F.lower("p_type").alias("prefix"))
    return some.union(part.where("p_partkey % 40 = 0").select(F.concat(F.lower("p_type"), F.lit(".none")))).distinct()


def refs(spark, d):
    """A reference per line: the name of the part that follows the line's part."""
    part = load(spark, d, "part").select((F.col("p_partkey") - 1).alias("l_partkey"), F.concat(F.lower("p_type"), F.lit("."), F.regexp_replace("p_name", " ", "-")).alias("n"), "p_size")
    li = load(spark, d, "lineitem").join(part, "l_partkey")
    return li.select(F.when(F.col("l_linenumber") == 7, F.concat("n", F.lit(".x"))).otherwise(F.col("n")).alias("name"), F.col("p_size").cast("string").alias("expected_value"), (F.col("l_returnflag") == "R").alias("match_if_missing"))


REFS = "refs AS (SELECT CASE WHEN l_linenumber = 7 THEN concat(lower(p_type), '.', replace(p_name, ' ', '-'), '.x') ELSE concat(lower(p_type), '.', replace(p_name, ' ', '-')) END AS name, CAST(p_size AS VARCHAR) AS expected_value, l_returnflag = 'R' AS match_if_missing FROM lineitem JOIN part ON l_partkey = p_partkey - 1)"


@plan("p1_normalize_names", "SELECT p_partkey, lower(trim(concat(' ', p_type, ' '))) AS name_norm, lower(regexp_replace(regexp_replace(p_type, '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '[_ ]+', '-', 'g')) AS name_kebab FROM part")
def _(spark, d):
    return p.normalize_names(load(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("name"))).drop("name")


# Fixed values of the checks: what is put behind a part's name, by its number; every marker comes up.
WORDS = [*p.SECRET_MARKERS, *p.HARMLESS_MARKERS, "path", "token", "x-token", "pat", "my-pat.x", "token-x", "a-token-b", "password-policy", "clientsecret", "db_password", "Api_Key", "signing_key", "users[0].secret"]
VALUES = ["plain", "${ENV_VALUE}", "${env.value}", "${DB:changeme}", "${DB:set-me}", "${DB:Zx81}", "${DB:}", ""]


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


MARKED = f"marked AS (SELECT place, concat(name, '.', {_sql_list(WORDS)}[1 + place % {len(WORDS)}]) AS name, {_sql_list(VALUES)}[1 + (place // {len(WORDS)}) % {len(VALUES)}] AS value FROM prop)"


def marked(spark, d):
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("place") % len(WORDS) + 1).cast("int"))
    value = F.element_at(F.array(*map(F.lit, VALUES)), (F.floor(F.col("place") / len(WORDS)) % len(VALUES) + 1).cast("int"))
    return props(spark, d).select("place", F.concat_ws(".", "name", word).alias("name"), value.alias("value"))


@plan("p2_redact_secrets", rf"""WITH {PROP}, {MARKED}, m AS (SELECT *, lower(name) AS n FROM marked), s AS (SELECT *, len([x FOR x IN {_sql_list(p.HARMLESS_MARKERS)} IF contains(n, x)]) = 0 AND (list_contains(regexp_split_to_array(n, '[._\[\]-]+'), 'pat') OR len([x FOR x IN {_sql_list(p.SECRET_MARKERS)} IF contains(n, x)]) > 0 OR ends_with(n, '.token') OR ends_with(n, '-token') OR contains(n, '.token.') OR contains(n, '-token-')) AS sensitive FROM m)
SELECT place, name, sensitive, CASE WHEN sensitive AND value <> '${{ENV_VALUE}}' THEN '[redacted]' ELSE value END AS value FROM s""")
def _(spark, d):
    return p.redact_secrets(marked(spark, d)).select("place", "name", "sensitive", "value")


@plan("p2_secret_values", rf"""WITH {PROP}, {MARKED}, m AS (SELECT *, lower(name) AS n, regexp_extract(lower(name), '([^.\]]*)$', 1) AS leaf, regexp_extract(value, '^\$\{{[^:]*:(.*)\}}$', 1) AS dflt FROM marked WHERE value <> '')
SELECT place, name, value, CASE WHEN NOT starts_with(value, '${{') THEN 'LITERAL' WHEN dflt = '' THEN 'REFERENCE' WHEN list_contains({_sql_list(p.WEAK_DEFAULTS)}, lower(dflt)) THEN 'WEAK_DEFAULT' WHEN list_contains({_sql_list(p.SAFE_SENTINELS)}, replace(upper(dflt), '-', '_')) THEN 'SENTINEL' ELSE 'DEFAULT' END AS verdict FROM m
WHERE len([x FOR x IN {_sql_list(p.HARMLESS_MARKERS)} IF contains(n, x)]) = 0 AND (list_contains({_sql_list(p.SECRET_LEAVES)}, leaf) OR regexp_matches(leaf, '[-_](password|passwd|secret|token)$') OR regexp_matches(leaf, '(^|[-_])(api|access|private|signing)[-_]key$'))""")
def _(spark, d):
    return p.secret_values(marked(spark, d)).select("place", "name", "value", "verdict")


@plan("p3_match_references", f"WITH {PROP}, {REFS}, a AS (SELECT name, count(*) AS configured FROM prop GROUP BY name), b AS (SELECT name, count(*) AS referenced FROM refs GROUP BY name) SELECT name, coalesce(configured, 0) AS configured, coalesce(referenced, 0) AS referenced, CASE WHEN referenced IS NULL THEN 'CONFIGURED_ONLY' WHEN configured IS NULL THEN 'REFERENCED_ONLY' ELSE 'BOTH' END AS origin FROM a FULL JOIN b USING (name)")
def _(spark, d):
    return p.match_references(props(spark, d), refs(spark, d))


BRACKETS = "brackets AS (SELECT place, repo, profile, value, CASE WHEN place % 3 = 0 THEN concat(split_part(name, '.', 1), '[k].', split_part(name, '.', 2)) ELSE name END AS name FROM prop), bnames AS (SELECT DISTINCT name FROM brackets), bups AS (SELECT DISTINCT name, array_to_string(string_split(name, '.')[1:i], '.') AS prefix FROM (SELECT name, unnest(range(1, len(string_split(name, '.')) + 1)) AS i FROM bnames)), bmaps AS (SELECT name, split_part(name, '[', 1) AS prefix FROM bnames WHERE contains(name, '['))"
BOWNED = "bowned AS (SELECT name, arg_max(prefix, length(prefix)) AS prefix FROM (SELECT name, prefix FROM bups JOIN owners USING (prefix) WHERE prefix <> name UNION SELECT name, prefix FROM bmaps JOIN (SELECT prefix FROM owners WHERE length(prefix) % 2 = 0) USING (prefix)) GROUP BY name)"


def brackets(spark, d):
    part = F.split("name", "[.]")
    return props(spark, d).withColumn("name", F.when(F.col("place") % 3 == 0, F.concat(part[0], F.lit("[k]."), part[1])).otherwise(F.col("name")))


def map_owners(spark, d):
    return owners(spark, d).withColumn("map_typed", F.length("prefix") % 2 == 0)


@plan("p4_owning_prefix", f"WITH {PROP}, {OWNERS}, {BRACKETS}, {BOWNED} SELECT name, prefix FROM bowned")
def _(spark, d):
    return p.owning_prefix(brackets(spark, d), map_owners(spark, d))


KINDS = f"""{OWNERS}, {BRACKETS}, {BOWNED}, {REFS}, kinds AS (SELECT name, CASE WHEN name IN (SELECT name FROM brackets WHERE place % 11 = 0) THEN 'CUSTOM_CONFIGURATION_PROPERTIES' WHEN name IN (SELECT name FROM bowned WHERE prefix < 'm') THEN 'CUSTOM_CONFIGURATION_PROPERTIES'
WHEN name IN (SELECT name FROM brackets WHERE place % 13 = 0 AND place % 2 = 0) THEN 'THIRD_PARTY' WHEN name IN (SELECT name FROM brackets WHERE place % 13 = 0) THEN 'SPRING_BOOT' WHEN name IN (SELECT name FROM bups WHERE prefix LIKE 'small%' AND prefix <> name UNION SELECT name FROM bmaps WHERE prefix LIKE 'small%') THEN 'SPRING_BOOT_MAP_PROPERTY'
WHEN name IN (SELECT name FROM brackets WHERE place % 17 = 0 AND place % 2 = 0) THEN 'THIRD_PARTY' WHEN name IN (SELECT name FROM brackets WHERE place % 17 = 0) THEN 'SPRING_BOOT' WHEN name IN (SELECT name FROM refs WHERE match_if_missing) THEN 'CONDITIONAL_PROPERTY' WHEN name IN (SELECT name FROM refs) THEN 'CODE_REFERENCED'
WHEN name IN (SELECT name FROM bups WHERE prefix LIKE 'promo%' AND prefix <> name AND NOT contains(prefix, '[')) THEN 'THIRD_PARTY' ELSE 'UNKNOWN' END AS kind FROM bnames)"""


def kinds(spark, d):
    q = brackets(spark, d)
    marked = lambda n: q.where(F.col("place") % n == 0).select("name", (F.col("place") % 2 == 0).alias("third_party"))
    heads = lambda start: load(spark, d, "part").where(F.lower("p_type").startswith(start)).select(F.lower("p_type").alias("prefix")).distinct()
    own = map_owners(spark, d).where("prefix < 'm'")
    conditional = refs(spark, d).select("name", F.col("match_if_missing").alias("conditional"))
    return p.classify_property(q, q.where("place % 11 = 0"), own, marked(13), heads("small"), marked(17), conditional, heads("promo"))


@plan("p5_classify_property", f"WITH {PROP}, {KINDS} SELECT name, kind FROM kinds")
def _(spark, d):
    return kinds(spark, d)


@plan("p6_configuration_summary", f"""WITH {PROP}, {KINDS}, b AS (SELECT b.*, profile AS r, kind FROM brackets b JOIN kinds USING (name)), c AS (SELECT concat('Brand#', 11 + l_linenumber) AS repo, count(*) AS "references" FROM lineitem GROUP BY 1)
SELECT b.r AS repo, count(*) AS properties, count(*) FILTER (WHERE kind IN ('SPRING_BOOT', 'SPRING_BOOT_MAP_PROPERTY')) AS known, count(*) FILTER (WHERE kind = 'CUSTOM_CONFIGURATION_PROPERTIES') AS custom, count(*) FILTER (WHERE kind = 'UNKNOWN') AS unknown, CAST(0 AS BIGINT) AS sensitive, array_to_string(list_sort(list_distinct(list(value) FILTER (WHERE trim(value) <> ''))), ',') AS profiles, coalesce(max("references"), 0) AS "references" FROM b LEFT JOIN c ON c.repo = b.r GROUP BY b.r""")
def _(spark, d):
    used = load(spark, d, "lineitem").select(F.concat(F.lit("Brand#"), F.col("l_linenumber") + 11).alias("repo"))
    rows = brackets(spark, d).select(F.col("profile").alias("repo"), "name", F.col("value").alias("profile"))
    return p.configuration_summary(rows, kinds(spark, d), used).withColumn("profiles", F.array_join("profiles", ","))


@plan("p7_profile_drift", f"WITH {PROP}, q AS (SELECT repo, name, CASE WHEN place % 9 <> 0 THEN profile END AS profile, value FROM prop) SELECT repo, name, count(DISTINCT profile) AS n_profiles, count(DISTINCT value) AS n_values, array_to_string(list_sort(list_distinct(list(concat(profile, '=', value)) FILTER (WHERE profile IS NOT NULL))), ',') AS evidence FROM q GROUP BY repo, name HAVING n_profiles >= 2 AND n_values > 1")
def _(spark, d):
    rows = props(spark, d).withColumn("profile", F.when(F.col("place") % 9 != 0, F.col("profile")))
    return p.profile_drift(rows).withColumn("evidence", F.array_join("evidence", ","))


@plan("p8_profile_comparison", f"""WITH {PROP}, l AS (SELECT name, profile, arg_max(value, place) AS value FROM prop WHERE profile IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY name, profile)
SELECT name, max(value) FILTER (WHERE profile = 'Brand#11') AS "Brand#11", max(value) FILTER (WHERE profile = 'Brand#12') AS "Brand#12", max(value) FILTER (WHERE profile = 'Brand#13') AS "Brand#13", count(DISTINCT value) > 1 AS changed FROM l GROUP BY name""")
def _(spark, d):
    return p.profile_comparison(props(spark, d), ["Brand#11", "Brand#12", "Brand#13"])


@plan("p9_sensitive_in_many", f"WITH {PROP}, {SECRET} SELECT repo, name, count(*) AS places, CASE WHEN bool_or(value <> '${{ENV_VALUE}}') THEN 'WARNING' ELSE 'INFO' END AS severity, CASE WHEN bool_or(value <> '${{ENV_VALUE}}') THEN 'SECURITY' ELSE 'PROFILE_DRIFT' END AS category FROM secretive WHERE contains(name, '.password') GROUP BY repo, name HAVING count(*) >= 2")
def _(spark, d):
    return p.sensitive_in_many(secretive(spark, d))


@plan("p10_conditional_matrix", f"""WITH {PROP}, {REFS}, h AS (SELECT name, count(*) FILTER (WHERE match_if_missing) AS missing_matches FROM refs GROUP BY name), o AS (SELECT name, count(*) AS unexpected FROM (SELECT DISTINCT name, value FROM prop) v WHERE name IN (SELECT name FROM refs) AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.name = v.name AND r.expected_value = v.value) GROUP BY name)
SELECT name, missing_matches, coalesce(unexpected, 0) AS unexpected FROM h LEFT JOIN o USING (name)""")
def _(spark, d):
    return p.conditional_matrix(refs(spark, d), props(spark, d))


@plan("p11_missing_override", f"WITH {PROP}, q AS (SELECT repo, name, value, CASE WHEN profile <> 'Brand#11' THEN profile END AS profile FROM prop) SELECT DISTINCT repo, name FROM q WHERE profile IS NULL AND regexp_matches(name, '^[lms]') AND regexp_matches(value, '^[0-9]+$') AND name NOT IN (SELECT name FROM q WHERE profile IN ('Brand#12', 'Brand#21', 'Brand#33'))")
def _(spark, d):
    rows = props(spark, d).withColumn("profile", F.when(F.col("profile") != "Brand#11", F.col("profile")))
    return p.missing_override(rows, None, ["Brand#12", "Brand#21", "Brand#33"], "^[lms]", "^[0-9]+$")


@plan("p12_resolve_placeholders", """WITH RECURSIVE t AS (SELECT concat('n', p_partkey) AS name, CASE WHEN p_partkey % 4 = 0 THEN concat('v', p_size) WHEN p_partkey % 4 = 1 THEN concat('<${n', p_partkey - 1, '}>') WHEN p_partkey % 4 = 2 THEN concat('${n', p_partkey - 1, ':d}!') ELSE concat('${none', p_size, CASE WHEN p_size % 2 = 0 THEN ':dflt' ELSE '' END, '}') END AS value FROM part),
s AS (SELECT name, CAST(substr(name, 2) AS BIGINT) AS k, value FROM t)
SELECT a.name, CASE a.k % 4 WHEN 0 THEN a.value WHEN 1 THEN concat('<', coalesce(b.value, concat('${n', a.k - 1, '}')), '>') WHEN 2 THEN concat('<', coalesce(c.value, concat('${n', a.k - 2, '}')), '>!') ELSE CASE WHEN contains(a.value, ':dflt') THEN 'dflt' ELSE a.value END END AS value, (a.k % 4 = 3 AND NOT contains(a.value, ':dflt')) OR (a.k % 4 = 1 AND b.value IS NULL) OR (a.k % 4 = 2 AND c.value IS NULL) AS unresolved
FROM s a LEFT JOIN s b ON b.k = a.k - 1 LEFT JOIN s c ON c.k = a.k - 2
UNION ALL SELECT concat('w', p_partkey), concat_ws('.', 'v' || p_size, 'v' || p_size, 'x', 'v' || p_size), false FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT concat('c', p_partkey), concat('v', p_size, '${c', p_partkey, '}'), true FROM part WHERE p_partkey % 4 = 0""")
def _(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    value = F.when(k % 4 == 0, F.concat(F.lit("v"), size)).when(k % 4 == 1, F.concat(F.lit("<${n"), k - 1, F.lit("}>"))).when(k % 4 == 2, F.concat(F.lit("${n"), k - 1, F.lit(":d}!")))
    value = value.otherwise(F.concat(F.lit("${none"), size, F.when(size % 2 == 0, ":dflt").otherwise(""), F.lit("}")))
    part = load(spark, d, "part")
    rows = part.select(F.concat(F.lit("n"), k).alias("name"), value.alias("value"))
    own = F.concat(F.lit("${n"), k, F.lit("}"))
    wide = part.where(k % 4 == 0).select(F.concat(F.lit("w"), k), F.concat_ws(".", own, own, F.concat(F.lit("${none:x}")), own))
    ring = part.where(k % 4 == 0).select(F.concat(F.lit("c"), k), F.concat(own, F.lit("${c"), k, F.lit("}")))
    return p.resolve_placeholders(rows.union(wide).union(ring))


@plan("p13_unused_prefixes", f"WITH {PROP}, {NAMES_UP}, {OWNERS} SELECT prefix FROM owners WHERE prefix NOT IN (SELECT prefix FROM ups)")
def _(spark, d):
    return p.unused_prefixes(owners(spark, d), props(spark, d))


@plan("p13_unknown_properties", f"WITH {PROP}, {KINDS} SELECT profile AS repo, count(DISTINCT name) AS unknown, min(name) AS first_name FROM brackets JOIN kinds USING (name) WHERE kind = 'UNKNOWN' GROUP BY profile")
def _(spark, d):
    return p.unknown_properties(kinds(spark, d), brackets(spark, d).withColumn("repo", F.col("profile")))


@plan("p14_deprecated_properties", f"WITH {PROP}, c AS (SELECT DISTINCT name, concat('use ', profile) AS reason FROM prop WHERE place % 17 = 0 AND profile > 'Brand#4') SELECT repo, place, prop.name, profile, value, reason FROM prop JOIN c USING (name)")
def _(spark, d):
    q = props(spark, d)
    catalog = q.where("place % 17 = 0").select("name", (F.col("profile") > "Brand#4").alias("deprecated"), F.concat(F.lit("use "), "profile").alias("reason")).distinct()
    return p.deprecated_properties(q, catalog)


@plan("p15_dominant_namespace", f"WITH {PROP}, n AS (SELECT profile AS repo, regexp_extract(name, '^([^.]+[.][^.]+)', 1) AS namespace, count(*) AS n FROM prop GROUP BY 1, 2 HAVING count(*) >= 2) SELECT repo, namespace, n FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, namespace) AS rn FROM n) WHERE rn = 1")
def _(spark, d):
    return p.dominant_namespace(props(spark, d).withColumn("repo", F.col("profile")), 2)


@plan("p16_review_signals", f"WITH {PROP}, {KINDS}, g AS (SELECT repo, name, count(DISTINCT value) AS v FROM brackets GROUP BY repo, name) SELECT repo, CAST(0 AS BIGINT) AS sensitive, count(*) FILTER (WHERE v > 1) AS changed, count(*) FILTER (WHERE name IN (SELECT name FROM refs)) AS referenced, count(*) FILTER (WHERE kind = 'UNKNOWN') AS unknown FROM g JOIN kinds USING (name) GROUP BY repo")
def _(spark, d):
    return p.review_signals(brackets(spark, d), refs(spark, d), kinds(spark, d))


@plan("p16_filter_properties", f"WITH {PROP}, {SECRET} SELECT place, name FROM secretive WHERE profile = 'Brand#11' AND contains(name, '.password') AND contains(lower(concat_ws(' ', name, value)), '1')")
def _(spark, d):
    return p.filter_properties(secretive(spark, d), "Brand#11", True, "1").select("place", "name")


@plan("p16_filter_by_focus", f"""WITH {PROP}, {KINDS}, q AS (SELECT b.*, kind, concat('f', place % 4) AS file FROM brackets b JOIN kinds USING (name)), ch AS (SELECT repo, name FROM q GROUP BY repo, name HAVING count(DISTINCT value) > 1)
SELECT 'changed' AS focus, place FROM q JOIN ch USING (repo, name) WHERE file = 'f1' UNION ALL SELECT 'referenced', place FROM q WHERE kind = 'CONDITIONAL_PROPERTY' AND name IN (SELECT name FROM refs) UNION ALL SELECT 'unknown', place FROM q WHERE kind = 'UNKNOWN' AND file = 'f2'""")
def _(spark, d):
    q = brackets(spark, d).join(kinds(spark, d), "name").withColumn("file", F.concat(F.lit("f"), F.col("place") % 4))
    one = p.filter_properties(q, file="f1", focus="changed").select(F.lit("changed").alias("focus"), "place")
    two = p.filter_properties(q, kind="CONDITIONAL_PROPERTY", focus="referenced", refs=refs(spark, d)).select(F.lit("referenced").alias("focus"), "place")
    return one.unionByName(two).unionByName(p.filter_properties(q, file="f2", focus="unknown").select(F.lit("unknown").alias("focus"), "place"))


@plan("r12_rule_property", f"WITH {PROP}, {SECRET}, q AS (SELECT *, CASE profile WHEN 'Brand#11' THEN 'PROD' WHEN 'Brand#12' THEN 'TEST' ELSE 'OTHER' END AS k FROM secretive) SELECT place, name, 'SMALL_IN_PROD' AS rule_id FROM q WHERE k = 'PROD' AND regexp_matches(value, '^[0-9]$') UNION ALL SELECT place, name, 'OPEN_PASSWORD' FROM q WHERE contains(name, 'password') AND regexp_matches(value, '^[0-9]+$') UNION ALL SELECT place, name, 'ECONOMY_TEST' FROM q WHERE starts_with(name, 'economy') AND k = 'TEST'")
def _(spark, d):
    q = secretive(spark, d).withColumn("profile", F.when(F.col("profile") == "Brand#11", "production").when(F.col("profile") == "Brand#12", "ci").otherwise(F.col("profile")))
    rules = [
        {"rule_id": "SMALL_IN_PROD", "severity": "ERROR", "contains": "", "value": "^[0-9]$", "profiles": ["PROD"]},
        {"rule_id": "OPEN_PASSWORD", "severity": "WARNING", "contains": "password", "value": "^[0-9]+$"},
        {"rule_id": "ECONOMY_TEST", "severity": "INFO", "prefix": "economy", "profiles": ["TEST"]},
    ]
    return r.rule_property(q.withColumn("repo", F.col("place")), rules).select(F.col("repo").alias("place"), "name", "rule_id")
