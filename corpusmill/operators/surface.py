"""URLs, endpoints and web stacks (H1-H6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROTOCOLS = [("jdbc:", "JDBC"), ("http://", "HTTP"), ("https://", "HTTP"), ("amqp", "BROKER"), ("kafka", "BROKER"), ("redis", "REDIS"), ("smtp", "MAIL")]


def classify_urls(properties: DataFrame) -> DataFrame:
    """kind of each value that is a URL or refers to one; the first test that holds decides."""
    v, n = F.lower("value"), F.lower("name")
    kind = F.when(v.startswith("${"), "PROPERTY_REFERENCE").when(v.startswith("jdbc:"), "JDBC").when(n.contains("issuer") | n.contains("oauth"), "OIDC").when(n.contains("otlp") | n.contains("metrics"), "OBSERVABILITY")
    for start, name in PROTOCOLS[1:]:
        kind = kind.when(v.startswith(start), name)
    kind = kind.when(v.rlike("^[a-z][a-z0-9+.-]*://"), "OTHER")
    return properties.withColumn("url_kind", kind).where("url_kind is not null")


def url_parts(df: DataFrame, column: str = "url") -> DataFrame:
    """host (first of a comma list) and base_path (first path segment); null where the URL has none."""
    rest = F.regexp_extract(column, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.split(rest, ",")[0], "^[^@]*@", ""), ":[0-9]+$", "")
    base = F.regexp_extract(column, r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    return df.withColumn("host", F.nullif(host, F.lit(""))).withColumn("base_path", F.nullif(base, F.lit("")))


def sanitize_urls(df: DataFrame, column: str = "url", keys: str = "token|key|secret|password|access_token") -> DataFrame:
    """Values of telling query keys as ***, and no user names."""
    safe = F.regexp_replace(column, f"([?&](?:{keys})=)[^&#]*", "$1***")
    return df.withColumn("safe_url", F.regexp_replace(safe, "://[^/@]*@", "://"))


def sanitize_remotes(df: DataFrame, column: str = "remote") -> DataFrame:
    """Remotes without user info, query and fragment: as URLs, or as host:path."""
    bare = F.regexp_replace(F.trim(column), "[?#].*$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "://[^/@]*@", "://"), r"^[^/@:\s]+@([^/:]+:)", "$1")
    return df.withColumn("safe_remote", bare)


def surface_summary(inbound: DataFrame, outbound: DataFrame) -> DataFrame:
    """One row per repo: endpoints in and out, distinct base paths and hosts over both."""
    rows = inbound.select("repo", "host", "base_path", F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(outbound.select("repo", "host", "base_path", F.lit(0).alias("i"), F.lit(1).alias("o")))
    return rows.groupBy("repo").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound"), F.countDistinct("base_path").alias("base_paths"), F.countDistinct("host").alias("hosts"))


def exposures(properties: DataFrame) -> DataFrame:
    """name, endpoint of exposure lists, one row per item."""
    return properties.select("name", F.explode(F.split("value", r"\s*,\s*")).alias("endpoint")).where("endpoint <> ''")


EXPLICIT_STACKS = {"servlet": "SERVLET", "reactive": "REACTIVE", "none": "NON_WEB"}


def web_stack(facts: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """stack and reason of each module. An explicit type (module, type) wins; then its facts' kinds: servlet before reactive, then
    routes, framework, controllers."""
    flag = lambda k: F.bool_or(F.col("kind") == k)
    held = facts.groupBy("module").agg(flag("servlet").alias("s"), flag("reactive").alias("r"), flag("route").alias("u"), flag("framework").alias("f"), flag("controller").alias("c"))
    given = F.lit(None).cast("string")
    if explicit is not None:
        one = explicit.groupBy("module").agg(F.min(F.lower(F.trim("type"))).alias("_type"))
        held = held.join(one, "module", "full_outer")
        given = F.create_map(*[F.lit(x) for kv in EXPLICIT_STACKS.items() for x in kv])[F.col("_type")]
    steps = [
        (given.isNotNull(), given, "configured"), (F.col("s") & F.col("r"), "SERVLET", "both stacks are present and servlet comes first"), (F.col("s"), "SERVLET", "servlet stack is present"),
        (F.col("r"), "REACTIVE", "reactive stack is present"), (F.col("u"), "REACTIVE", "routing functions are present"), (F.col("f"), "NON_WEB", "framework without a web stack"),
        (F.col("c"), "SERVLET", "controllers are present"),
    ]
    pick = lambda i, rest: F.coalesce(*[F.when(s[0], s[i] if not isinstance(s[i], str) else F.lit(s[i])) for s in steps], F.lit(rest))
    return held.select("module", pick(1, "UNKNOWN").alias("stack"), pick(2, "no evidence").alias("reason"))
