"""Dependency graph: declarations, resolution, closure, impact, cycles, levels, hashes.

Edges are (src, dst): src depends on dst. Loops run on the driver over whole rounds only and have no limit on rounds;
each round writes only what is new to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.storage import cut, discard, joined


def is_dynamic(version: Column) -> Column:
    v = F.coalesce(version, F.lit(""))
    return (v == "") | v.rlike(r"[$+\[\](),]") | F.upper(v).isin("LATEST", "RELEASE")


def dependency_declarations(lines: DataFrame, catalog: DataFrame | None = None, catalog_name: str = "libs") -> DataFrame:
    """kind, project_path, group, artifact, version, dynamic of what lines declare: quoted coordinates g:a[:v], project
    references project(':a:b'), and catalogue aliases libs.x.y by the table catalog (alias, group, artifact, version).

    An alias that the catalogue does not have is dynamic and without coordinates; libs.versions and libs.bundles are none."""
    place, none = ["repo", "path", "line"], F.lit(None).cast("string")
    found = lines.select(*place, F.explode(F.regexp_extract_all("text", F.lit("['\"]([A-Za-z0-9_.-]+:[A-Za-z0-9_.-]+(?::[^'\":]+)?)['\"]"), 1)).alias("coordinate"))
    parts = F.split("coordinate", ":")
    rows = found.select(*place, F.lit("COORDINATE").alias("kind"), none.alias("project_path"), parts[0].alias("group"), parts[1].alias("artifact"), F.try_element_at(parts, F.lit(3)).alias("version"))
    refs = lines.select(*place, F.explode(F.regexp_extract_all("text", F.lit("project\\s*\\(\\s*(?:path\\s*[:=]\\s*)?['\"]([^'\"]+)['\"]"), 1)).alias("p"))
    path = F.regexp_replace(F.concat(F.lit(":"), "p"), "^:+", ":")
    rows = rows.unionByName(refs.select(*place, F.lit("PROJECT").alias("kind"), path.alias("project_path"), none.alias("group"), none.alias("artifact"), none.alias("version")))
    if catalog is not None:
        alias = lambda c: F.regexp_replace(F.lower(c), "[_-]", ".")
        used = lines.select(*place, F.explode(F.regexp_extract_all("text", F.lit(rf"\b{catalog_name}\.([A-Za-z_][A-Za-z0-9_.-]*)"), 1)).alias("a")).where("a not like 'versions.%' and a not like 'bundles.%'")
        known = catalog.select(alias(F.col("alias")).alias("k"), "group", "artifact", "version")
        rows = rows.unionByName(used.join(known, alias(F.col("a")) == F.col("k"), "left").select(*place, F.lit("ALIAS").alias("kind"), none.alias("project_path"), "group", "artifact", "version"))
    return rows.withColumn("dynamic", (F.col("kind") != "PROJECT") & is_dynamic(F.col("version")))


def _candidates(decls: DataFrame, modules: DataFrame, key: list[str], name: str) -> DataFrame:
    """decls with {name}_n, how many modules have the key, and {name}_m, the one to take: of several those of the
    declaration's build system if there are any, then one if all lie at one path of one repo; else null."""
    spot = F.countDistinct(F.struct("repo", "path"))
    known = modules.where(" and ".join(f"`{k}` is not null" for k in key))
    every = known.groupBy(*key).agg(F.count("*").alias("_n"), F.min("module").alias("_m"), spot.alias("_s"), F.count("version").alias("_v"))
    kin = known.groupBy(*key, "build_system").agg(F.count("*").alias("_kn"), F.min("module").alias("_km"), spot.alias("_ks"))
    rows = decls.join(every, key, "left").join(kin, [*key, "build_system"], "left")
    own = (F.col("_n") > 1) & (F.col("_kn") > 0)
    n, m, s = (F.when(own, F.col(f"_k{c}")).otherwise(F.col(f"_{c}")) for c in "nms")
    rows = rows.withColumn(f"{name}_n", F.coalesce("_n", F.lit(0))).withColumn(f"{name}_m", F.when((n == 1) | (s == 1), m)).withColumn(f"{name}_v", F.coalesce("_v", F.lit(0)))
    return rows.drop("_n", "_m", "_s", "_v", "_kn", "_km", "_ks")


def resolve_dependencies(decls: DataFrame, modules: DataFrame) -> DataFrame:
    """resolution and module of each declaration (decl, repo, build_system, target, project_path, group, artifact, version, dynamic).

    In turn: an explicit target; a project path in the same repo, else its last part as a project's name; exact
    coordinates; group and artifact. A fixed version that no module has is local only if the one module of that group and
    artifact has no version. Candidates that stay several are unresolved; none is external, or unresolved if dynamic."""
    rows = decls.withColumn("project_name", F.regexp_extract("project_path", "([^:]*)$", 1))
    rows = rows.join(modules.select(F.col("module").alias("_target")).distinct(), F.col("target") == F.col("_target"), "left")
    for key, name in ((["repo", "project_path"], "p"), (["project_name"], "q"), (["group", "artifact", "version"], "e"), (["group", "artifact"], "l")):
        rows = _candidates(rows, modules, key, name)
    fixed = F.col("version").isNotNull() & ~F.col("dynamic")
    open_ = F.when(F.col("dynamic"), "UNRESOLVED").otherwise("EXTERNAL")

    def take(name: str, other: Column) -> Column:
        return F.when(F.col(f"{name}_m").isNotNull(), "LOCAL").when(F.col(f"{name}_n") > 0, "UNRESOLVED").otherwise(other)

    path = F.col("project_path").isNotNull()
    whole = F.col("group").isNotNull() & F.col("artifact").isNotNull()
    fits = (F.col("l_n") == 1) & (F.col("l_v") == 0)
    resolution = (
        F.when(F.col("_target").isNotNull(), "LOCAL").when(F.col("target").isNotNull(), "UNRESOLVED").when(path & (F.col("p_n") > 0), take("p", open_)).when(path, take("q", open_)).when(~whole, "UNRESOLVED")
        .when(fixed & (F.col("e_n") > 0), take("e", open_)).when(fixed & (F.col("l_n") > 0), F.when(fits, "LOCAL").otherwise("EXTERNAL")).otherwise(take("l", open_))
    )
    found = (
        F.when(F.col("target").isNotNull(), F.col("_target")).when(path & (F.col("p_n") > 0), F.col("p_m")).when(path, F.col("q_m")).when(~whole, None)
        .when(fixed & (F.col("e_n") > 0), F.col("e_m")).otherwise(F.col("l_m"))
    )
    return rows.select("decl", "project_path", "group", "artifact", "version", resolution.alias("resolution"), F.when(resolution == "LOCAL", found).alias("module"))


def parent_links(modules: DataFrame) -> DataFrame:
    """module, parent: the module at parent_path in the same repo, else the one module with the declared parent_group and parent_artifact."""
    at = modules.select("repo", F.col("path").alias("parent_path"), F.col("module").alias("_at"))
    only = modules.where("`group` is not null and artifact is not null").groupBy(F.col("group").alias("parent_group"), F.col("artifact").alias("parent_artifact")).agg(F.count("*").alias("_n"), F.min("module").alias("_only")).where("_n = 1")
    rows = modules.join(at, ["repo", "parent_path"], "left").join(only, ["parent_group", "parent_artifact"], "left")
    link = lambda c: F.when(F.col(c) != F.col("module"), F.col(c))
    return rows.select("module", F.coalesce(link("_at"), link("_only")).alias("parent"))


def parent_cycles(modules: DataFrame) -> DataFrame:
    """node: the modules on a cycle of parents, by pointer doubling: after as many steps as there are modules, only these are reached."""
    jump = cut(modules.where("parent is not null").select("module", "parent"))
    steps, n = 1, jump.count()
    while steps < n:
        far = jump.select(F.col("module").alias("_m"), F.col("parent").alias("_p"))
        new = cut(jump.join(far, F.col("parent") == F.col("_m")).select("module", F.col("_p").alias("parent")))
        discard(jump)
        jump, steps = new, steps * 2
    return jump.select(F.col("parent").alias("node")).distinct()


def ancestors(modules: DataFrame) -> DataFrame:
    """module, ancestor, depth up the parents, by doubling; a module on a cycle of parents has none."""
    links = modules.where("parent is not null").select("module", "parent")
    links = cut(links.join(parent_cycles(modules).withColumnRenamed("node", "module"), "module", "left_anti"))
    known, far = [cut(links.select("module", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))], 1
    while True:
        whole = joined(known)
        last = whole.where(F.col("depth") == far).select(F.col("module").alias("_m"), F.col("ancestor").alias("_mid"))
        step = last.join(whole.select(F.col("module").alias("_mid"), "ancestor", "depth"), "_mid").select(F.col("_m").alias("module"), "ancestor", (F.col("depth") + far).alias("depth"))
        new = cut(step)
        if new.isEmpty():
            return whole
        known, far = [*known, new], far * 2


def inherit_coordinates(modules: DataFrame) -> DataFrame:
    """module, group, version with what the nearest parent has where a module says nothing; in_cycle: whether its parents
    run in a circle that it lies on, so that it inherits nothing."""
    up = cut(ancestors(modules).unionByName(modules.select("module", F.col("module").alias("ancestor"), F.lit(0).alias("depth"))))
    own = modules.select(F.col("module").alias("ancestor"), "group", "version")
    near = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("depth"))).alias(c)
    held = up.join(own, "ancestor").groupBy("module").agg(near("group"), near("version"))
    bad = parent_cycles(modules).select(F.col("node").alias("module"), F.lit(True).alias("_bad"))
    return held.join(bad, "module", "left").select("module", "group", "version", F.coalesce("_bad", F.lit(False)).alias("in_cycle"))


def managed_versions(modules: DataFrame, managed: DataFrame) -> DataFrame:
    """module, group, artifact, version that hold for each module: its own managed rows (module, group, artifact, version), else the nearest parent's."""
    up = ancestors(modules).unionByName(modules.select("module", F.col("module").alias("ancestor"), F.lit(0).alias("depth")))
    rows = up.join(managed.withColumnRenamed("module", "ancestor"), "ancestor")
    return rows.groupBy("module", "group", "artifact").agg(F.min_by("version", "depth").alias("version"))


def duplicate_modules(modules: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows with their turn among rows of the same key; the first stays, later ones are to be reported."""
    return modules.withColumn("turn", F.row_number().over(Window.partitionBy(*key).orderBy(order)))


def repo_edges(deps: DataFrame) -> DataFrame:
    return deps.where("resolution = 'LOCAL' and src_repo <> dst_repo").select("src_repo", "dst_repo").distinct()


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(origin, node) pairs that the pairs in start lead to along edges, start's own pairs included; semi-naive.

    Each round writes its new pairs only; what is known is all rounds' tables read together."""
    parts = [cut(start.select("origin", "node").distinct())]
    while True:
        step = parts[-1].join(edges, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).distinct()
        new = cut(step.join(joined(parts), ["origin", "node"], "left_anti"))
        if new.isEmpty():
            return joined(parts)
        parts.append(new)


def dependency_closure(edges: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(src, dst) of all transitive dependencies, of the targets (column src) or of all; a node is not its own.

    Of all: by doubling, so a chain of n takes some log n rounds."""
    edges = cut(edges.select("src", "dst").distinct())
    if targets is not None:
        first = edges.join(targets.select("src").distinct(), "src", "left_semi")
        found = reach(edges, first.select(F.col("src").alias("origin"), F.col("dst").alias("node")))
        return found.select(F.col("origin").alias("src"), F.col("node").alias("dst")).where("src <> dst")
    known = edges
    while True:
        step = known.select("src", F.col("dst").alias("_mid")).join(known.select(F.col("src").alias("_mid"), "dst"), "_mid").select("src", "dst").distinct()
        new = cut(step.join(known, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return known.where("src <> dst")
        known = joined([known, new])


def impact(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Dependents of the changed nodes that are not changed themselves: node, kind DIRECT or TRANSITIVE."""
    back = cut(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct())
    changed = changed.select("node").distinct()
    first = back.join(changed, back.src == changed.node).select(F.col("dst").alias("node")).distinct()
    direct = cut(first.join(changed, "node", "left_anti"))
    every = reach(back, first.select(F.lit(0).alias("origin"), "node")).select("node").join(changed, "node", "left_anti").distinct()
    return every.join(direct.withColumn("d", F.lit(1)), "node", "left").select("node", F.when(F.col("d") == 1, "DIRECT").otherwise("TRANSITIVE").alias("kind"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """edges (a table of cut()) without those at nodes that have no edge in or none out, over and over."""
    n = edges.count()
    while n:
        kept = cut(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        left = kept.count()
        if left == n:
            break
        discard(edges)
        edges, n = kept, left
    return edges


def _core_groups(edges: DataFrame) -> DataFrame:
    """(node, component) of the cycles of edges (a table of cut()), by colouring.

    Nodes take the smallest label that reaches them and split off those that reach back; all labels' groups of a round are placed at
    once, until none is left."""
    left, out = _trimmed(edges), []
    while not left.isEmpty():
        colour = left.select(F.col("src").alias("node")).union(left.select(F.col("dst").alias("node"))).distinct().withColumn("colour", F.col("node"))
        colour = _spread(left, cut(colour))
        inner = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b")
        back = cut(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")))  # edges stay within a colour
        found = cut(reach(back, colour.where("node = colour").select(F.col("colour").alias("origin"), "node")))
        out.append(cut(found.select("node", F.col("origin").alias("component"))))
        gone = found.select("node").distinct()
        left = _trimmed(cut(left.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")))
    if not out:
        return edges.limit(0).select(F.col("src").alias("node"), F.col("dst").alias("component"))
    whole = joined(out)
    return whole.join(whole.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component"), "component").select("node", "component")


def _jumps(steps: DataFrame) -> list[DataFrame]:
    """Of steps (node, to), one a node, the tables (node, to, least, on) after 1, 2, 4, ... steps: where it leads, the smallest node on the
    way, and whether it goes on from there. The last table stands where all ways end, or on circles.

    A node that is the smallest on its own way is on a circle, which it has gone round. Ways that met such a node are on its circle by now, so the
    longest way and circle set the number of tables, not the number of steps."""
    n = steps.count()
    first = steps.select("node", "to", F.col("to").alias("least")).join(steps.select(F.col("node").alias("to"), F.lit(True).alias("on")), "to", "left")
    tables = [cut(first.select("node", "to", "least", F.coalesce("on", F.lit(False)).alias("on")))]
    while 1 << (len(tables) - 1) < n:
        on = tables[-1].where("on")
        if on.join(on.where("node = least").select("least"), "least", "left_anti").isEmpty():
            break
        ahead = tables[-1].select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"), F.col("on").alias("on2"))
        met = tables[-1].join(ahead, "to", "left")
        tables.append(cut(met.select("node", F.coalesce("to2", "to").alias("to"), F.least("least", F.coalesce("least2", "least")).alias("least"), F.coalesce("on2", F.lit(False)).alias("on"))))
    return tables


def cycle_groups(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes on a cycle; the component is its smallest node.

    First the graph is drawn together, in turns forward and backward. Nodes with one edge lead somewhere in some log n jumps, however long the
    way: round a circle of such nodes, which is a component; to a node without edges, then they are on no cycle; or to a node with several
    edges, and then their own edges in are led there. What is left has several edges at every node both ways, and is coloured. Then the
    nodes drawn together are placed: those on a way from a node of a component to one of the same component belong to it."""
    edges = cut(edges.select("src", "dst").distinct())
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    left, found, undo, idle = cut(edges.where("src <> dst")), [], [], 0
    while idle < 2 and not left.isEmpty():
        degrees = cut(left.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("to")))
        steps = degrees.where("n = 1").select(F.col("src").alias("node"), "to")
        if steps.isEmpty():
            idle += 1
        else:
            idle, jumps = 0, _jumps(steps)
            ways = jumps[-1]
            ring = ways.where("on").select(F.col("to").alias("node")).distinct()
            found.append(cut(ways.join(ring, "node").select("node", F.col("least").alias("component"))))
            big = degrees.where("n > 1").select(F.col("src").alias("node"))
            onward = left.join(big.withColumnRenamed("node", "src"), "src", "left_semi").join(ways.select(F.col("node").alias("dst"), "to", "on"), "dst", "left")
            onward = onward.where("not coalesce(on, false)").select("src", "dst", F.coalesce("to", "dst").alias("end")).join(big.withColumnRenamed("node", "end"), "end", "left_semi")
            onward = cut(onward)
            undo.append((jumps, cut(onward.where("dst <> end"))))
            found.append(cut(onward.where("src = end").select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()))
            left = cut(onward.where("src <> end").select("src", F.col("end").alias("dst")).distinct())
        left = cut(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))  # the other way
    core = cut(_core_groups(left))
    known = joined([core, *found]) if found else core
    known = cut(known.groupBy("node").agg(F.min_by("component", F.when(F.col("node") == F.col("component"), 1).otherwise(0)).alias("component")))
    for jumps, entries in reversed(undo):
        at = lambda name: known.select(F.col("node").alias(name), F.col("component").alias(f"c_{name}"))
        marked = entries.join(at("src"), "src").join(at("end"), "end").where("c_src = c_end").select(F.col("dst").alias("node"), F.col("c_end").alias("component")).distinct()
        marked = cut(marked)
        if marked.isEmpty():
            continue
        for table in jumps:  # a way of any length is a sum of powers of two
            more = marked.join(table, "node").select(F.col("to").alias("node"), "component")
            marked = cut(marked.unionByName(more).distinct())
        known = cut(known.unionByName(marked.join(known.select("node"), "node", "left_anti")))
    sized = known.groupBy("component").agg(F.min("node").alias("least"))
    groups = known.join(sized, "component").select("node", F.col("least").alias("component"))
    return groups.unionByName(loops.join(groups.select("node"), "node", "left_anti"))


def cycle_owners(groups: DataFrame, owners: DataFrame) -> DataFrame:
    """component, nodes, and the distinct repos (node, repo) that its nodes belong to, one row a repo."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("nodes"))
    return groups.join(owners, "node").select("component", "repo").distinct().join(sizes, "component")


def _spread(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """The smallest node that reaches each node."""
    while True:
        step = edges.join(colour, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("colour").alias("c"))
        new = cut(colour.join(step, F.col("node") == F.col("dst"), "left").select("node", F.least("colour", F.coalesce("c", "colour")).alias("colour")))
        if new.join(colour, ["node", "colour"], "left_anti").isEmpty():
            return new
        discard(colour)
        colour = new


def condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, c): the component of every node, itself where it is on no cycle; and the edges (cs, cd) between components."""
    edges = cut(edges.select("src", "dst").distinct())
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    named = cut(nodes.join(cycle_groups(edges), "node", "left").select("node", F.coalesce("component", "node").alias("c")))
    flat = edges.join(named.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(named.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst")
    return named, cut(flat.where("cs <> cd").select("cs", "cd").distinct())


def _longest(steps: DataFrame) -> DataFrame:
    """Of steps (node, to, low, far), one a node and without circles: to, where it ends, and low, far, so that the node's level is the greater of low and
    far more than the level there; by doubling."""
    table = cut(steps)
    while True:
        ahead = table.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"), F.col("far").alias("far2"))
        met = table.join(ahead, "to", "left")
        new = cut(met.select("node", F.coalesce("to2", "to").alias("to"), F.greatest("low", F.coalesce(F.col("low2") + F.col("far"), "low")).alias("low"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.col("to2").isNotNull().alias("moved")))
        discard(table)
        table = new
        if new.where("moved").isEmpty():
            return new.drop("moved")


def longest_paths(edges: DataFrame) -> DataFrame:
    """(node, level) of the nodes of a graph (cs, cd) without circles: the most edges of a path from it.

    Edges carry a length. In a round, nodes whose dependencies all have levels get theirs; nodes with one open dependency follow it to its end, over any
    number of such nodes by doubling, and their own edges in are led there with the length of the way. So a round is needed for each place where
    several open ways part, not for each edge."""
    left = cut(edges.select(F.col("cs").alias("src"), F.col("cd").alias("dst"), F.lit(1).alias("far")))
    nodes = left.select(F.col("src").alias("node")).union(left.select(F.col("dst").alias("node"))).distinct()
    open_, found = nodes.withColumn("low", F.lit(0)), []
    while True:
        degrees = left.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("to"), F.min("far").alias("far")).withColumnRenamed("src", "node")
        state = cut(open_.join(degrees, "node", "left").select("node", "low", F.coalesce("n", F.lit(0)).alias("n"), "to", "far"))
        ends, single = state.agg(F.count_if(F.col("n") == 0), F.count_if(F.col("n") == 1)).first()
        if not ends and not single:
            break
        drawn = single > ends  # fewer ends than ways to them: the ways are long
        placed = state.where("n = 0").select("node", F.col("low").alias("level"), "to", "low", "far")
        if drawn:
            ways = _longest(state.where("n = 1").select("node", "to", "low", "far"))
            ways = ways.join(placed.select(F.col("node").alias("to"), F.col("level").alias("end")), "to", "left")
            placed = placed.unionByName(ways.select("node", F.greatest("low", F.col("end") + F.col("far")).alias("whole"), "end", "to", "low", "far").select("node", F.when(F.col("end").isNotNull(), F.col("whole")).alias("level"), "to", "low", "far"))
        found.append(cut(placed))
        rest = state.where("n > 1" if drawn else "n > 0").select("node", "low")
        out = left.join(rest.select(F.col("node").alias("src")), "src", "left_semi")
        out = out.join(found[-1].select(F.col("node").alias("dst"), "level", "to", F.col("low").alias("low2"), F.col("far").alias("far2")), "dst", "left")
        led = F.col("level").isNull() & F.col("to").isNotNull()
        out = cut(out.select("src", F.when(led, F.col("to")).otherwise(F.col("dst")).alias("dst"), (F.col("far") + F.when(led, F.col("far2")).otherwise(0)).alias("far"), (F.col("far") + F.coalesce("level", "low2")).alias("least"), F.col("level").isNotNull().alias("done")))
        lows = out.groupBy("src").agg(F.max("least").alias("least")).withColumnRenamed("src", "node")
        open_ = rest.join(lows, "node", "left").select("node", F.greatest("low", F.coalesce("least", F.lit(0))).alias("low"))
        left = out.where("not done").groupBy("src", "dst").agg(F.max("far").alias("far"))
    if not found:
        return edges.limit(0).select(F.col("cs").alias("node"), F.lit(0).alias("level"))
    known = cut(joined(found).where("level is not null").select("node", "level"))
    for table in reversed(found):
        later = table.where("level is null")
        if not later.isEmpty():
            more = later.drop("level").join(known.select(F.col("node").alias("to"), "level"), "to").select("node", F.greatest("low", F.col("level") + F.col("far")).alias("level"))
            known = joined([known, cut(more)])
    return known


def dependency_levels(edges: DataFrame) -> DataFrame:
    """(node, level): every dependency is on a lower level; a cycle's nodes share their component's level."""
    named, flat = condensed(edges)
    placed = longest_paths(flat)
    return named.join(placed.withColumnRenamed("node", "c"), "c", "left").select("node", F.coalesce("level", F.lit(0)).alias("level"))


LANES = 4


def _sums(hash_: Column, of: int) -> list[Column]:
    """Sums of parts of 60 bits of SHA-256 hashes: one hash for a set of any size, in any order, without a list of it."""
    return [F.sum(F.conv(F.substring(hash_, 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{of}_{k}") for k in range(LANES)]


def _joined_sums(of: int) -> Column:
    return F.concat_ws(",", *(F.coalesce(F.col(f"s{of}_{k}"), F.lit(0).cast("decimal(38,0)")).cast("string") for k in range(LANES)))


def leveled(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """condensed(), and (c, level) of the components that have edges."""
    named, flat = condensed(edges)
    return named, flat, cut(longest_paths(flat).withColumnRenamed("node", "c"))


def effective_hash(nodes: DataFrame, edges: DataFrame, shape: tuple | None = None, contents: tuple = ("content_hash",)) -> DataFrame:
    """node, hash of nodes (node, content_hash); shape is leveled(edges), where it is known already. The hash changes with the node's content and with that of anything it depends on, and with nothing else.

    Hashes roll up the condensed graph, level by level: a component's hash is that of its nodes' contents and of the hashes of the components that it
    depends on, each of them once; sets are hashed by sums, so no row holds a list of hashes. A node's own hash adds its name. Several contents are rolled up at
once; the hash then has the content's name."""
    turns = range(len(contents))
    named, flat, levels = shape or leveled(edges)
    named = cut(nodes.join(named, "node", "left").select("node", F.coalesce("c", "node").alias("c"), *contents))
    own = named.groupBy("c").agg(*(x for i in turns for x in _sums(F.sha2(F.concat_ws(":", F.col("node").cast("string"), contents[i]), 256), i)))
    own = own.select("c", *(_joined_sums(i).alias(f"own{i}") for i in turns))
    placed = own.join(levels, "c", "left").select("c", *(f"own{i}" for i in turns), F.coalesce("level", F.lit(0)).alias("level"))
    placed, parts, level = cut(placed), [], 0
    top = placed.agg(F.max("level").alias("top")).first().top
    while top is not None and level <= top:
        here = placed.where(F.col("level") == level)
        if parts:
            below = flat.join(here.select(F.col("c").alias("cs")), "cs", "left_semi").join(joined(parts).withColumnRenamed("c", "cd"), "cd")
            here = here.join(below.groupBy("cs").agg(*(x for i in turns for x in _sums(F.col(f"hash{i}"), i))).withColumnRenamed("cs", "c"), "c", "left")
        else:
            here = here.select("*", *(F.lit(None).cast("decimal(38,0)").alias(f"s{i}_{k}") for i in turns for k in range(LANES)))
        parts.append(cut(here.select("c", *(F.sha2(F.concat_ws("|", f"own{i}", _joined_sums(i)), 256).alias(f"hash{i}") for i in turns))))
        level += 1
    rolled = joined(parts) if parts else placed.select("c", *(F.col(f"own{i}").alias(f"hash{i}") for i in turns))
    return named.join(rolled, "c").select("node", *(F.sha2(F.concat_ws("|", F.col("node").cast("string"), f"hash{i}"), 256).alias(contents[i] if len(contents) > 1 else "hash") for i in turns))


def version_conflicts(resolved: DataFrame) -> DataFrame:
    """Coordinates with several versions, and how many majors they span."""
    major = F.split(F.col("version").cast("string"), "[.]")[0]
    return resolved.groupBy("group", "artifact").agg(F.countDistinct("version").alias("versions"), F.countDistinct(major).alias("majors")).where("versions > 1")


def dependency_tree(resolved: DataFrame, preferred: str) -> DataFrame:
    """Groups with direct and transitive counts and their place: the preferred prefix first, then by name."""
    held = resolved.groupBy("group").agg(F.count_if("direct").alias("direct"), F.count_if(~F.col("direct")).alias("transitive"))
    return held.withColumn("sort_key", F.concat(F.when(F.col("group").startswith(preferred), "0").otherwise("1"), F.col("group")))


def resolution_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("configuration").agg(F.count("*").alias("attempted"), F.count_if("ok").alias("succeeded"), (~F.bool_or("ok")).alias("nothing_resolved"))


def failed_resolutions(results: DataFrame) -> DataFrame:
    """configuration, message, n of the failed rows, whatever their message."""
    return results.where("not ok").groupBy("configuration", F.coalesce(F.nullif(F.trim("message"), F.lit("")), F.lit("no message")).alias("message")).agg(F.count("*").alias("n"))


def graph_diagnostics(unresolved: DataFrame, duplicates: DataFrame, cycles: DataFrame) -> DataFrame:
    """code, subject, n over the three kinds of trouble; repeats are counted."""
    rows = [d.select(F.lit(code).alias("code"), F.col(d.columns[0]).cast("string").alias("subject")) for code, d in (("UNRESOLVED", unresolved), ("DUPLICATE", duplicates), ("CYCLE", cycles))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("code", "subject").agg(F.count("*").alias("n"))
