"""Queries over declarations, dependency edges and their closures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.operators import graph as g
from corpusmill.operators import rules as r
from corpusmill.plans.bindings import COORD, closure_sql, coords, edges, edges_sql, load, plan

DAG, CYC = 0.005, 0.015


@plan("d1_dependency_declarations", """WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 5 = 0 THEN ':1.+' ELSE concat(':', p_size) END AS v, replace(p_name, ' ', '-') AS artifact, replace(p_brand, '#', '-') AS g, concat(split_part(p_name, ' ', 1), '-', p_size % 4) AS al FROM part),
c AS (SELECT DISTINCT replace(al, '-', '.') AS k, concat('grp.', split_part(al, '-', 1)) AS g, al AS a, CASE WHEN ends_with(al, '1') THEN NULL ELSE '2.0' END AS v FROM p WHERE NOT ends_with(al, '3'))
SELECT p_partkey AS path, 'COORDINATE' AS kind, NULL AS project_path, g AS "group", artifact, nullif(substr(v, 2), '') AS version, v IN ('', ':1.+') AS dynamic FROM p
UNION ALL SELECT p_partkey, 'PROJECT', concat(':mod:', artifact), NULL, NULL, NULL, false FROM p WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'ALIAS', NULL, c.g, c.a, c.v, c.v IS NULL FROM p LEFT JOIN c ON c.k = replace(al, '-', '.') WHERE p_partkey % 5 = 0""")
def _(spark, d):
    p = load(spark, d, "part")
    v = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 5 == 0, ":1.+").otherwise(F.concat(F.lit(":"), "p_size"))
    artifact, alias = F.regexp_replace("p_name", " ", "-"), F.concat(F.split("p_name", " ")[0], F.lit("-"), F.col("p_size") % 4)
    project = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(' project(path: ":mod:'), artifact, F.lit('")'))).otherwise("")
    used = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(" implementation(libs."), alias, F.lit(") libs.versions.x"))).otherwise("")
    text = F.concat(F.lit("implementation '"), F.regexp_replace("p_brand", "#", "-"), F.lit(":"), artifact, v, F.lit("'"), project, used)
    rows = p.select(F.lit("r").alias("repo"), F.col("p_partkey").alias("path"), F.lit(1).alias("line"), text.alias("text"))
    catalog = p.select(alias.alias("artifact")).where(~F.col("artifact").endswith("3")).distinct()
    catalog = catalog.select(F.regexp_replace("artifact", "-", "_").alias("alias"), F.concat(F.lit("grp."), F.split("artifact", "-")[0]).alias("group"), "artifact", F.when(~F.col("artifact").endswith("1"), "2.0").alias("version"))
    return g.dependency_declarations(rows, catalog).select("path", "kind", "project_path", "group", "artifact", "version", "dynamic")


def declarations(spark, d):
    """A declaration per line: by the part's coordinates, by a project path, by an explicit target, or incomplete."""
    part = load(spark, d, "part").select(F.col("p_partkey").alias("module"), F.col("p_brand").alias("group"), F.col("p_name").alias("artifact"), "p_size")
    rows = load(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("decl"), F.col("l_partkey").alias("module"), "l_linenumber", "l_suppkey").join(part, "module")
    n = F.col("l_linenumber")
    version = F.when(n > 1, (F.col("p_size") + n % 2).cast("string"))
    path = F.when(n == 5, F.concat(F.lit(":"), "artifact"))
    target = F.when(n == 6, F.when(F.col("l_suppkey") % 3 == 0, -1).otherwise(F.col("module")))
    return rows.select(
        "decl", F.col("group").alias("repo"), F.when(F.col("l_suppkey") % 2 == 0, "gradle").otherwise("maven").alias("build_system"), target.cast("long").alias("target"), path.alias("project_path"),
        F.when(n != 7, F.col("group")).alias("group"), "artifact", version.alias("version"), version.isNull().alias("dynamic"),
    )


def local_modules(spark, d):
    c = coords(spark, d)
    return c.select("module", F.col("group").alias("repo"), F.concat(F.lit("m/"), F.col("module") % 97).alias("path"), F.when(F.col("module") % 2 == 0, "gradle").otherwise("maven").alias("build_system"), F.when(F.col("module") % 3 == 0, F.concat(F.lit(":"), "artifact")).alias("project_path"), F.when(F.col("module") % 4 == 0, F.col("artifact")).alias("project_name"), "group", "artifact", "version")


def _pick(name: str, on: str) -> str:
    """Joins the candidates of a key and the one to take, as n, m and v with the name behind."""
    return f"""LEFT JOIN LATERAL (SELECT count(*) AS n_{name}, count(version) AS v_{name}, CASE WHEN count(*) > 1 AND count(*) FILTER (WHERE build_system = d.build_system) > 0 THEN CASE WHEN count(*) FILTER (WHERE build_system = d.build_system) = 1 OR count(DISTINCT (repo, path)) FILTER (WHERE build_system = d.build_system) = 1 THEN min(module) FILTER (WHERE build_system = d.build_system) END WHEN count(*) = 1 OR count(DISTINCT (repo, path)) = 1 THEN min(module) END AS m_{name} FROM lm WHERE {on}) ON true"""


@plan("d2_resolve_dependencies", f"""WITH {COORD}, lm AS (SELECT module, "group" AS repo, concat('m/', module % 97) AS path, CASE WHEN module % 2 = 0 THEN 'gradle' ELSE 'maven' END AS build_system, CASE WHEN module % 3 = 0 THEN concat(':', artifact) END AS project_path, CASE WHEN module % 4 = 0 THEN artifact END AS project_name, "group", artifact, version FROM coord),
d AS (SELECT l_orderkey * 10 + l_linenumber AS decl, p_brand AS repo, CASE WHEN l_suppkey % 2 = 0 THEN 'gradle' ELSE 'maven' END AS build_system, CASE WHEN l_linenumber = 6 THEN CASE WHEN l_suppkey % 3 = 0 THEN -1 ELSE l_partkey END END AS target, CASE WHEN l_linenumber = 5 THEN concat(':', p_name) END AS project_path, CASE WHEN l_linenumber <> 7 THEN p_brand END AS "group", p_name AS artifact, CASE WHEN l_linenumber > 1 THEN CAST(p_size + l_linenumber % 2 AS VARCHAR) END AS version FROM lineitem JOIN part ON l_partkey = p_partkey),
kd AS (SELECT DISTINCT repo, build_system, project_path, "group", artifact, version FROM d),
kj AS (SELECT d.*, n_p, m_p, n_q, m_q, n_e, m_e, n_l, m_l, v_l FROM kd d {_pick('p', 'lm.repo = d.repo AND lm.project_path = d.project_path')} {_pick('q', 'lm.project_name = substr(d.project_path, 2)')} {_pick('e', 'lm."group" = d."group" AND lm.artifact = d.artifact AND lm.version = d.version')} {_pick('l', 'lm."group" = d."group" AND lm.artifact = d.artifact')}),
j AS (SELECT d.decl, d.target, kj.* FROM d JOIN kj ON kj.repo = d.repo AND kj.build_system = d.build_system AND kj.project_path IS NOT DISTINCT FROM d.project_path AND kj."group" IS NOT DISTINCT FROM d."group" AND kj.artifact = d.artifact AND kj.version IS NOT DISTINCT FROM d.version),
k AS (SELECT *, CASE WHEN target = -1 THEN 'UNRESOLVED' WHEN target IS NOT NULL THEN 'LOCAL' WHEN project_path IS NOT NULL THEN CASE WHEN n_p > 0 THEN CASE WHEN m_p IS NOT NULL THEN 'LOCAL' ELSE 'UNRESOLVED' END WHEN m_q IS NOT NULL THEN 'LOCAL' WHEN n_q > 0 THEN 'UNRESOLVED' WHEN version IS NULL THEN 'UNRESOLVED' ELSE 'EXTERNAL' END WHEN "group" IS NULL THEN 'UNRESOLVED'
WHEN version IS NOT NULL AND n_e > 0 THEN CASE WHEN m_e IS NOT NULL THEN 'LOCAL' ELSE 'UNRESOLVED' END WHEN version IS NOT NULL AND n_l > 0 THEN CASE WHEN n_l = 1 AND v_l = 0 THEN 'LOCAL' ELSE 'EXTERNAL' END WHEN m_l IS NOT NULL THEN 'LOCAL' WHEN n_l > 0 OR version IS NULL THEN 'UNRESOLVED' ELSE 'EXTERNAL' END AS resolution FROM j)
SELECT decl, project_path, "group", artifact, version, resolution, CASE WHEN resolution = 'LOCAL' THEN CASE WHEN target IS NOT NULL THEN target WHEN project_path IS NOT NULL THEN CASE WHEN n_p > 0 THEN m_p ELSE m_q END WHEN version IS NOT NULL AND n_e > 0 THEN m_e ELSE m_l END END AS module FROM k""")
def _(spark, d):
    return g.resolve_dependencies(declarations(spark, d), local_modules(spark, d))


_PARENTS = "m AS (SELECT p_partkey AS module, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey - 1 WHEN (p_partkey // 3) % 11 = 0 THEN p_partkey + 1 END AS parent, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS g, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS v FROM part)"


def parents(spark, d):
    """Chains of three parts; of some the first points at the second, so that these two run in a circle."""
    k = F.col("p_partkey")
    parent = F.when(k % 3 != 0, k - 1).when(F.floor(k / 3) % 11 == 0, k + 1)
    return load(spark, d, "part").select(k.alias("module"), parent.alias("parent"), F.when(k % 3 == 0, F.col("p_brand")).alias("group"), F.when(k % 2 == 0, F.col("p_size").cast("string")).alias("version"))


@plan("d3_inherit_coordinates", f"""WITH {_PARENTS}, c AS (SELECT module FROM m WHERE (module // 3) % 11 = 0 AND module % 3 < 2 AND module + 1 - 2 * (module % 3) IN (SELECT module FROM m)), l AS (SELECT module, CASE WHEN module IN (SELECT module FROM c) THEN NULL ELSE parent END AS parent, g, v FROM m)
SELECT a.module, coalesce(a.g, b.g, c.g) AS "group", coalesce(a.v, b.v, c.v) AS version, a.module IN (SELECT module FROM c) AS in_cycle FROM l a LEFT JOIN l b ON a.parent = b.module LEFT JOIN l c ON b.parent = c.module""")
def _(spark, d):
    return g.inherit_coordinates(parents(spark, d))


@plan("d3_managed_versions", f"""WITH {_PARENTS}, c AS (SELECT module FROM m WHERE (module // 3) % 11 = 0 AND module % 3 < 2 AND module + 1 - 2 * (module % 3) IN (SELECT module FROM m)), l AS (SELECT module, CASE WHEN module IN (SELECT module FROM c) THEN NULL ELSE parent END AS parent FROM m), up AS (SELECT module, module AS anc, 0 AS depth FROM l UNION ALL SELECT module, parent, 1 FROM l WHERE parent IS NOT NULL UNION ALL SELECT a.module, b.parent, 2 FROM l a JOIN l b ON a.parent = b.module WHERE b.parent IS NOT NULL),
mg AS (SELECT DISTINCT l_partkey AS module, 'g' AS "group", CAST(l_suppkey % 5 AS VARCHAR) AS artifact, CAST(max(l_linenumber) AS VARCHAR) AS version FROM lineitem GROUP BY l_partkey, l_suppkey % 5) SELECT up.module, "group", artifact, arg_min(version, depth) AS version FROM up JOIN mg ON anc = mg.module GROUP BY up.module, "group", artifact""")
def _(spark, d):
    managed = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("module"), (F.col("l_suppkey") % 5).cast("string").alias("artifact")).agg(F.max("l_linenumber").cast("string").alias("version"))
    return g.managed_versions(parents(spark, d), managed.withColumn("group", F.lit("g")))


@plan("d3_parent_links", """WITH m AS (SELECT p_partkey AS module, p_brand AS repo, concat('d/', p_name) AS path, concat('g', p_size % 10) AS "group", p_name AS artifact, CASE WHEN p_partkey % 2 = 0 THEN concat('d/', p_name) END AS parent_path, concat('g', (p_size + 1) % 10) AS pg, p_name AS pa FROM part),
a AS (SELECT repo, path, min(module) AS first_at, count(*) AS n FROM m GROUP BY repo, path), o AS (SELECT "group", artifact, min(module) AS sole FROM m GROUP BY 1, 2 HAVING count(*) = 1)
SELECT m.module, coalesce(nullif(CASE WHEN n = 1 THEN a.first_at END, m.module), nullif(sole, m.module)) AS parent FROM m LEFT JOIN a ON a.repo = m.repo AND a.path = m.parent_path AND n = 1 LEFT JOIN o ON o."group" = pg AND o.artifact = pa""")
def _(spark, d):
    p = load(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("module"), F.col("p_brand").alias("repo"), F.concat(F.lit("d/"), "p_name").alias("path"), F.concat(F.lit("g"), F.col("p_size") % 10).alias("group"), F.col("p_name").alias("artifact"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("d/"), "p_name")).alias("parent_path"), F.concat(F.lit("g"), (F.col("p_size") + 1) % 10).alias("parent_group"), F.col("p_name").alias("parent_artifact"))
    alone = rows.groupBy("repo", "path").agg(F.count("*").alias("n")).where("n > 1").select("repo", "path")
    shared = rows.join(alone, ["repo", "path"], "left_semi").withColumn("path", F.lit(None).cast("string"))  # a folder holds one module
    return g.parent_links(rows.join(alone, ["repo", "path"], "left_anti").unionByName(shared))


@plan("d4_duplicate_modules", f'WITH {COORD} SELECT module, CAST(row_number() OVER (PARTITION BY "group", artifact ORDER BY module) AS INT) AS turn FROM coord')
def _(spark, d):
    return g.duplicate_modules(coords(spark, d), ["group", "artifact"], "module").select("module", "turn")


@plan("d5_repo_edges", f"WITH {edges_sql(CYC)} SELECT DISTINCT a.p_brand AS src_repo, b.p_brand AS dst_repo FROM edges JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey WHERE a.p_brand <> b.p_brand")
def _(spark, d):
    part = load(spark, d, "part")
    deps = edges(spark, d, CYC).join(part.select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("src_repo")), "src").join(part.select(F.col("p_partkey").alias("dst"), F.col("p_brand").alias("dst_repo")), "dst")
    return g.repo_edges(deps.withColumn("resolution", F.lit("LOCAL")))


@plan("d6_dependency_closure", f"WITH RECURSIVE {closure_sql(CYC)} SELECT src, dst FROM reach WHERE src <> dst")
def _(spark, d):
    return g.dependency_closure(edges(spark, d, CYC))


@plan("d7_impact", f"""WITH RECURSIVE {closure_sql(CYC)}, ch AS (SELECT DISTINCT dst AS node FROM edges WHERE dst % 20 = 0), di AS (SELECT DISTINCT src AS node FROM edges WHERE dst IN (SELECT node FROM ch) AND src NOT IN (SELECT node FROM ch)), al AS (SELECT DISTINCT src AS node FROM reach WHERE dst IN (SELECT node FROM ch) AND src NOT IN (SELECT node FROM ch))
SELECT node, CASE WHEN node IN (SELECT node FROM di) THEN 'DIRECT' ELSE 'TRANSITIVE' END AS kind FROM al""")
def _(spark, d):
    e = edges(spark, d, CYC)
    return g.impact(e, e.where("dst % 20 = 0").select(F.col("dst").alias("node")))


@plan("d8_cycle_groups", f"WITH RECURSIVE {closure_sql(CYC)} SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src")
def _(spark, d):
    return g.cycle_groups(edges(spark, d, CYC))


@plan("d8_cycle_owners", f"WITH RECURSIVE {closure_sql(CYC)}, c AS (SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src) SELECT DISTINCT component, p_brand AS repo, nodes FROM c JOIN part ON node = p_partkey JOIN (SELECT component, count(*) AS nodes FROM c GROUP BY component) USING (component)")
def _(spark, d):
    owners = load(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("repo"))
    return g.cycle_owners(g.cycle_groups(edges(spark, d, CYC)), owners)


@plan("d9_levels_of_all_orders", "WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS src, l_orderkey * 10 + l_linenumber + 1 AS dst FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), i AS (SELECT node, node - row_number() OVER (PARTITION BY node // 10 ORDER BY node) AS island FROM n) SELECT node, CAST(max(node) OVER (PARTITION BY island, node // 10) - node AS INT) AS level FROM i")
def _(spark, d):
    """Each line of each order depends on the next one of its order: the whole table as one graph."""
    li = load(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("src"))
    return g.dependency_levels(li.select("src", (F.col("src") + 1).alias("dst")).join(li.select(F.col("src").alias("dst")), "dst", "left_semi"))


@plan("d9_dependency_levels", f"""WITH RECURSIVE {closure_sql(CYC)}, comp AS (SELECT a.src AS node, min(a.dst) AS c FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src), nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), named AS (SELECT node, coalesce(c, node) AS c FROM nodes LEFT JOIN comp USING (node)), flat AS (SELECT DISTINCT a.c AS cs, b.c AS cd FROM edges JOIN named a ON src = a.node JOIN named b ON dst = b.node WHERE a.c <> b.c),
up(c, level) AS (SELECT DISTINCT c, 0 FROM named UNION SELECT f.cs, up.level + 1 FROM up JOIN flat f ON f.cd = up.c)
SELECT node, max(level) AS level FROM named JOIN up USING (c) GROUP BY node""")
def _(spark, d):
    return g.dependency_levels(edges(spark, d, CYC))


@plan("d10_effective_hash", f"""WITH RECURSIVE {closure_sql(CYC)}, n AS (SELECT DISTINCT node FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) JOIN part ON node = p_partkey)
SELECT node, node % 25 = 0 OR node IN (SELECT src FROM reach WHERE dst % 25 = 0) AS changed FROM n""")
def _(spark, d):
    """Which nodes' hashes change when the contents of every 25th do, on a graph with circles."""
    e = edges(spark, d, CYC)
    nodes = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct()
    part = load(spark, d, "part").select(F.col("p_partkey").alias("node"), F.concat("p_name", F.col("p_size").cast("string")).alias("content")).join(nodes, "node")
    after = F.when(F.col("node") % 25 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    hashes = g.effective_hash(part.select("node", F.sha2("content", 256).alias("before"), F.sha2(after, 256).alias("after")), e, contents=("before", "after"))
    return hashes.select("node", (F.col("before") != F.col("after")).alias("changed"))


_ISLANDS = "ns AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS node, l_orderkey AS o FROM lineitem), i AS (SELECT node, o, node - row_number() OVER (PARTITION BY o ORDER BY node) AS island FROM ns)"


@plan("d8_cycles_of_all_orders", f"WITH {_ISLANDS}, s AS (SELECT o, island, min(node) AS component, count(*) AS n FROM i GROUP BY ALL) SELECT node, component FROM i JOIN s USING (o, island) WHERE n > 1 AND o % 3 = 0")
def _(spark, d):
    """Each line of each order depends on the next one; of every third order the last of a run depends on the first as well: the whole table as one graph."""
    li = load(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("src"), F.col("l_orderkey").alias("o")).distinct()
    step = li.select("src", (F.col("src") + 1).alias("dst"), "o").join(li.select(F.col("src").alias("dst")), "dst", "left_semi")
    run = Window.partitionBy("o").orderBy("src")
    runs = li.withColumn("run", F.col("src") - F.row_number().over(run)).groupBy("o", "run").agg(F.max("src").alias("src"), F.min("src").alias("dst")).where("src <> dst and o % 3 = 0")
    return g.cycle_groups(step.select("src", "dst").unionByName(runs.select("src", "dst")))


@plan("d6_closure_of_all_orders", f"WITH {_ISLANDS} SELECT a.node AS src, b.node AS dst FROM i a JOIN i b ON a.o = b.o AND a.island = b.island AND a.node < b.node WHERE a.node % 10 = 1")
def _(spark, d):
    """What the first line of every order depends on, over the whole table."""
    li = load(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("src")).distinct()
    step = li.select("src", (F.col("src") + 1).alias("dst")).join(li.select(F.col("src").alias("dst")), "dst", "left_semi")
    return g.dependency_closure(step, li.where("src % 10 = 1"))


@plan("d11_version_conflicts", f'WITH {COORD} SELECT "group", artifact, count(DISTINCT version) AS versions, count(DISTINCT string_split(version, \'.\')[1]) AS majors FROM coord GROUP BY 1, 2 HAVING count(DISTINCT version) > 1')
def _(spark, d):
    return g.version_conflicts(coords(spark, d))


@plan("d12_dependency_tree", "SELECT p_brand AS \"group\", count(*) FILTER (WHERE l_linenumber = 1) AS direct, count(*) FILTER (WHERE l_linenumber <> 1) AS transitive, concat(CASE WHEN starts_with(p_brand, 'Brand#3') THEN '0' ELSE '1' END, p_brand) AS sort_key FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def _(spark, d):
    rows = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("group"), (F.col("l_linenumber") == 1).alias("direct"))
    return g.dependency_tree(rows, "Brand#3")


@plan("d13_resolution_summary", "SELECT o_orderpriority AS configuration, count(*) AS attempted, count(*) FILTER (WHERE o_orderstatus = 'F') AS succeeded, NOT bool_or(o_orderstatus = 'F') AS nothing_resolved FROM orders GROUP BY 1")
def _(spark, d):
    return g.resolution_summary(load(spark, d, "orders").select(F.col("o_orderpriority").alias("configuration"), (F.col("o_orderstatus") == "F").alias("ok")))


@plan("d13_failed_resolutions", "SELECT o_orderpriority AS configuration, CASE WHEN o_orderkey % 3 = 0 THEN 'no message' ELSE concat('status ', o_orderstatus) END AS message, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2")
def _(spark, d):
    message = F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.concat(F.lit("status "), "o_orderstatus"))
    return g.failed_resolutions(load(spark, d, "orders").select(F.col("o_orderpriority").alias("configuration"), (F.col("o_orderstatus") == "F").alias("ok"), message.alias("message")))


@plan("d14_graph_diagnostics", f"""WITH RECURSIVE {closure_sql(CYC)} SELECT 'UNRESOLVED' AS code, CAST(l_partkey AS VARCHAR) AS subject, count(*) AS n FROM lineitem WHERE l_discount > 0.09 GROUP BY 2 UNION ALL SELECT 'DUPLICATE', p_name, count(*) FROM part GROUP BY p_name HAVING count(*) > 0 UNION ALL SELECT 'CYCLE', CAST(src AS VARCHAR), 1 FROM (SELECT DISTINCT a.src FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src)""")
def _(spark, d):
    bad = load(spark, d, "lineitem").where("l_discount > 0.09").select("l_partkey")
    return g.graph_diagnostics(bad, load(spark, d, "part").select("p_name"), g.cycle_groups(edges(spark, d, CYC)).select("node"))


@plan("r10_caller_boundary", f"""WITH RECURSIVE {edges_sql(CYC)}, m AS (SELECT p_partkey AS member, p_size < 25 AS boundary, p_size % 2 = 1 AS needs, p_size % 10 = 7 AS barrier FROM part WHERE p_partkey % 9 <> 0),
inside AS (SELECT src, dst, s.boundary AS held FROM edges LEFT JOIN m s ON src = s.member JOIN m t ON dst = t.member WHERE NOT t.boundary AND NOT t.barrier), safe(member) AS (SELECT dst FROM inside WHERE coalesce(held, true) UNION SELECT i.dst FROM safe JOIN inside i ON i.src = safe.member)
SELECT member FROM m WHERE needs AND NOT boundary AND member NOT IN (SELECT member FROM safe)""")
def _(spark, d):
    size = F.col("p_size")
    m = load(spark, d, "part").where("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("member"), (size < 25).alias("boundary"), (size % 2 == 1).alias("needs"), (size % 10 == 7).alias("barrier"))
    return r.rule_caller_boundary(m, edges(spark, d, CYC).select(F.col("src").alias("caller"), F.col("dst").alias("callee")))


@plan("r10_boundaries_of_all_orders", """WITH RECURSIVE m AS (SELECT l_orderkey * 10 + l_linenumber AS member, bool_or(l_returnflag = 'A' AND l_quantity < 10) AS boundary, bool_or(l_discount > 0.07) AS barrier FROM lineitem GROUP BY 1),
calls AS (SELECT CASE WHEN member % 70 <> 1 THEN member - 1 END AS caller, member AS callee FROM m WHERE member % 70 = 1 OR (member - 1) % 10 <> 0), inside AS (SELECT caller, callee, s.boundary AS held FROM calls LEFT JOIN m s ON caller = s.member JOIN m t ON callee = t.member WHERE NOT t.boundary AND NOT t.barrier),
safe(member) AS (SELECT callee FROM inside WHERE coalesce(held, true) UNION SELECT i.callee FROM safe JOIN inside i ON i.caller = safe.member)
SELECT member FROM m WHERE NOT boundary AND member NOT IN (SELECT member FROM safe)""")
def _(spark, d):
    """Each line of an order is called by the one before it: the whole table as one call graph; some first lines are called from elsewhere."""
    li = load(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("member"))
    m = li.agg(F.bool_or((F.col("l_returnflag") == "A") & (F.col("l_quantity") < 10)).alias("boundary"), F.bool_or(F.col("l_discount") > 0.07).alias("barrier")).withColumn("needs", F.lit(True))
    calls = m.select(F.when(F.col("member") % 70 != 1, F.col("member") - 1).alias("caller"), F.col("member").alias("callee")).where("caller is null or caller % 10 <> 0")
    return r.rule_caller_boundary(m, calls)
