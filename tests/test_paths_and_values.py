"""Paths put straight, trees read with their dot files, placeholders expanded, totals over ranges: small cases with the meaning of the reference behaviour."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.running import running_totals
from corpusmill.operators import findings, properties
from corpusmill.sources import files


@pytest.mark.parametrize(
    "path, clean",
    [("a//b/./c/", "a/b/c"), ("../../ctx/x", "../../ctx/x"), ("a/b/c/d/e/f/../../../../../../ctx/x", "ctx/x"), ("a/../../b", "../b"), ("/../x", "/x"), ("C:\\W\\..\\d", "C:/d"), ("./", "."), ("", None), ("C:", None), ("/", "/"), ("a/..", "."), ("a/b/../../..", "..")],
)
def test_clean_path(spark, path, clean):
    assert spark.createDataFrame([(path,)], "path string").select(findings.clean_path(F.col("path")).alias("c")).first().c == clean


def test_drop_foreign_paths(spark):
    rows = [
        ("../../ctx/x", None, True), ("a/b/c/d/e/f/../../../../../../ctx/x", None, False), ("ctx", None, False), ("ctxx/a", None, True), ("a/ctx/b", None, True),
        ("/repo/ctx/a", None, False), ("/repo/a/ctx", None, True), ("/repo/../other/ctx/a", None, True), ("/over/all/x", None, False), ("/over/allx", None, True),
        ("/tmp/run-1/copy-2/ctx/a", None, False), ("/tmp/run-1/x/copy-2/ctx/a", None, True), ("/tmp/copy-2/ctx/a", None, True), (None, None, True),
        ("a", '{"sourceFile": "ctx/b"}', False), ("a", '{"location": {"file": "/repo/x/../ctx/b"}}', False), ("a", '{"primaryLocation": {"path": "b"}}', True), ("a", "{oops", True), ("a", '{"path": ["ctx/b"]}', True),
    ]
    kept = findings.drop_foreign_paths(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, path string, raw string, stays boolean"), "ctx", "/repo", "/over/all", ("run-", "copy-"), "raw")
    assert {r.id for r in kept.collect()} == {k for k, r in enumerate(rows) if r[2]}
    drive = spark.createDataFrame([("C:\\Work\\CTX\\a",), ("c:/work/Ctx/b",), ("d:/work/ctx/b",), ("/work/ctx/b",)], "path string")
    assert {r.path for r in findings.drop_foreign_paths(drive.withColumn("path", F.lower("path")), "ctx", "C:/Work").collect()} == {"d:/work/ctx/b", "/work/ctx/b"}


def write(root, names):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)


def test_tree_keeps_dot_files_and_skips_pruned_folders(spark, tmp_path):
    names = ["r/.env", "r/.github/w.yml", "r/_conf/b.properties", "r/a/b/c/D.java", "q/_x/.y/z.txt", "q/top.md"]
    pruned = ["r/build/x.yml", "r/a/target/y.java", "r/node_modules/z/p.json", "r/.git/config", "r/a/.gradle/g"]
    write(tmp_path, names + pruned)
    for name in pruned:  # a file that is opened would fail the scan
        (tmp_path / name).chmod(0)
    found = files.corpus_scan(spark, str(tmp_path)).collect()
    assert sorted(f"{r.repo}/{r.path}" for r in found) == sorted(names) and all(r.content == f"{r.repo}/{r.path}" and r.size == len(r.content) for r in found)
    assert sorted(r.path for r in files.corpus_scan(spark, str(tmp_path), include=["*.yml", "_conf/**"], exclude=["*.md"]).collect()) == [".github/w.yml", "_conf/b.properties"]
    assert sorted(r.path for r in files.corpus_scan(spark, str(tmp_path), max_depth=2).collect()) == [".env", ".github/w.yml", "_conf/b.properties", "top.md"]


def test_tree_deals_folders(spark, tmp_path):
    write(tmp_path, [f"one/src/p{k % 7}/q{k % 3}/f{k}.txt" for k in range(60)])
    found = files.corpus_scan(spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
    assert found.count() == 60 and found.select("task").distinct().count() > 3
    assert files.corpus_scan(spark, str(tmp_path / "one" / "src")).select("repo").distinct().count() == 7


def test_placeholders(spark):
    rows = [("a", "${b}${b}${b}"), ("b", "${c}${c}${c}"), ("c", "${d}${d}${d}"), ("d", "1"), ("x", "${y}-${d}"), ("y", "${x}"), ("z", "<${x}>"), ("n", "${none}/${none:dd}/${none:}"), ("m", "${none:${d}}${n}"), ("e", None), ("u", "${e}!"), ("s", "${ d }")]
    rows += [(f"k{i}", f"${{k{i + 1}}}") for i in range(20)] + [("k20", "end")]
    got = {r.name: (r.value, r.unresolved) for r in properties.resolve_placeholders(spark.createDataFrame(rows, "name string, value string")).collect()}
    assert got["a"] == ("1" * 27, False) and got["k0"] == ("end", False) and got["s"] == ("1", False)
    assert got["x"] == ("${y}-1", True) and got["y"] == ("${x}", True) and got["z"] == ("<${x}>", True)
    assert got["n"] == ("${none}/dd/", True) and got["m"] == ("1${none}/dd/", True) and got["u"] == ("!", False) and got["e"] == (None, False)


def test_running_totals_of_a_hot_key(spark):
    rows = [("hot", f"src/main/{k:05d}", k % 7) for k in range(5000)] + [("cold", f"{k}", 1) for k in range(9)] + [(None, "x", 4)]
    got = running_totals(spark.createDataFrame(rows, "repo string, path string, size int").repartition(6), ["repo"], ["path"], {"total": "size"})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sums, seen = {}, {}
        for r in sorted(got.collect(), key=lambda r: (str(r.repo), r.path)):
            sums[r.repo] = sums.get(r.repo, 0) + r.size
            seen[r.repo, r.path] = (r.total, sums[r.repo])
        assert all(a == b for a, b in seen.values()) and len(seen) == len(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    kept = files.within_budget(spark.createDataFrame(rows, "repo string, path string, size int").where("repo is not null"), 4000, 6, 10**6)
    assert {r.repo: r.first_offender for r in kept.collect()} == {"hot": "src/main/04000", "cold": None}
