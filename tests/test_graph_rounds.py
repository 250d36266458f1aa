"""Graphs whose depth must not set the number of rounds, and random ones against plain searches."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import graph as g
from corpusmill.operators import rules as r


def reached(edges, start):
    seen, todo = set(), [start]
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    while todo:
        for b in out.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def random_graph(seed):
    """Chains, circles, trees and knots that touch each other."""
    rng = random.Random(seed)
    edges, n = set(), 60
    for _ in range(rng.randrange(3, 9)):
        a, k = rng.randrange(n), rng.randrange(1, 12)
        edges |= {((a + i) % n, (a + i + 1) % n) for i in range(k)}
        if rng.random() < 0.4:
            edges.add(((a + k) % n, a))
    edges |= {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(25))}
    return sorted(edges)


@pytest.mark.parametrize("seed", [0, 5])
def test_random_graphs(spark, seed):
    edges = random_graph(seed)
    frame = spark.createDataFrame(edges, "src long, dst long")
    nodes = sorted({x for e in edges for x in e})
    down = {x: reached(edges, x) for x in nodes}
    component = {x: min([y for y in down[x] if x in down[y]] or [x]) for x in nodes}
    assert {(x.node, x.component) for x in g.cycle_groups(frame).collect()} == {(x, component[x]) for x in nodes if x in down[x]}
    flat = {(component[a], component[b]) for a, b in edges if component[a] != component[b]}
    level = {}

    def deep(c):
        if c not in level:
            level[c] = max([1 + deep(b) for a, b in flat if a == c], default=0)
        return level[c]

    assert {(x.node, x.level) for x in g.dependency_levels(frame).collect()} == {(x, deep(component[x])) for x in nodes}


def test_depth_does_not_set_the_rounds(spark):
    n = 10_000
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    ring = spark.range(n).select((F.col("id") + 20_000).alias("src"), ((F.col("id") + 1) % n + 20_000).alias("dst"))
    for edges, groups in ((chain, 0), (ring, n)):
        start = time.time()
        found = g.cycle_groups(edges)
        assert found.count() == groups and time.time() - start < 60
    assert g.cycle_groups(ring).select("component").distinct().collect() == [(20_000,)]
    start = time.time()
    assert g.longest_paths(chain.withColumnsRenamed({"src": "cs", "dst": "cd"})).where("level = 10000 - node").count() == n + 1
    assert time.time() - start < 60


def test_a_hash_changes_with_what_it_depends_on(spark):
    edges = [(0, 1), (1, 2), (2, 1), (2, 3), (4, 3), (5, 6), (7, 7)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    contents = lambda changed: spark.createDataFrame([(k, f"{k}{'!' if k in changed else ''}") for k in range(9)], "node long, content_hash string")
    shape = g.leveled(frame)
    hashes = lambda changed=(): {x.node: x.hash for x in g.effective_hash(contents(changed), frame, shape).collect()}
    before = hashes()
    assert len(set(before.values())) == 9 and before == hashes()
    for changed, moved in (((3,), {0, 1, 2, 3, 4}), ((1, 8), {0, 1, 2, 8}), ((6, 7, 0), {0, 5, 6, 7})):
        after = hashes(changed)
        assert {k for k in before if before[k] != after[k]} == moved


def test_boundaries_over_any_number_of_calls(spark):
    members = [("open", True, False, False), ("a", False, True, False), ("b", False, True, False), ("async", False, True, True), ("c", False, True, False), ("lone", False, True, False), ("x", False, True, False), ("y", False, True, False), ("r1", False, True, False), ("r2", False, True, False)]
    calls = [("open", "a"), ("a", "b"), ("a", "async"), ("async", "c"), (None, "x"), ("x", "y"), ("r1", "r2"), ("r2", "r1"), ("lone", "open")]
    got = r.rule_caller_boundary(spark.createDataFrame(members, "member string, boundary boolean, needs boolean, barrier boolean"), spark.createDataFrame(calls, "caller string, callee string"))
    assert {x.member for x in got.collect()} == {"async", "c", "lone", "r1", "r2"}
    alone = r.rule_caller_boundary(spark.createDataFrame(members, "member string, boundary boolean, needs boolean, barrier boolean").drop("barrier"), spark.createDataFrame(calls + [("gone", "lone")], "caller string, callee string"))
    assert {x.member for x in alone.collect()} == {"r1", "r2"}


def test_small_circles_need_few_jumps(spark):
    n = 3000  # circles of three, and ways of two into them
    ring = spark.range(n).select((F.col("id") * 5).alias("k"))
    steps = ring.select(F.explode(F.array(*(F.struct((F.col("k") + a).alias("node"), (F.col("k") + b).alias("to")) for a, b in ((0, 1), (1, 2), (2, 0), (4, 3), (3, 1))))).alias("s")).select("s.*")
    tables = g._jumps(steps)
    assert len(tables) <= 4
    got = {(x.node, x.component) for x in g.cycle_groups(steps.select(F.col("node").alias("src"), F.col("to").alias("dst"))).collect()}
    assert got == {(5 * k + i, 5 * k) for k in range(n) for i in range(3)}


def test_two_contents_are_rolled_up_at_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4)], "src long, dst long")
    nodes = spark.range(1, 6).select(F.col("id").alias("node"), F.lit("x").alias("before"), F.when(F.col("id") == 3, "y").otherwise("x").alias("after"))
    both = {x.node: (x.before, x.after) for x in g.effective_hash(nodes, edges, contents=("before", "after")).collect()}
    alone = {x.node: x.hash for x in g.effective_hash(nodes.withColumnRenamed("after", "content_hash"), edges).collect()}
    assert {n for n, (a, b) in both.items() if a != b} == {1, 2, 3} and {n: b for n, (_, b) in both.items()} == alone
