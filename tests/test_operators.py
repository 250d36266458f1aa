import json

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import catalog as c
from corpusmill.operators import facts as e
from corpusmill.operators import findings as f
from corpusmill.operators import graph as g
from corpusmill.operators import incremental as i
from corpusmill.operators import properties as p
from corpusmill.operators import rules as r
from corpusmill.sources import files as s

FINDINGS = "finding_id long, repo string, path string, line int, target string, rule_id string, evidence string"
LINE = ["SWALLOWED", "BROAD", "INTERRUPTED", "PRINT"]
PAIRS = {"trace": ["INTERRUPTED", "PRINT"], "raw": ["RAW", "HANDLER"]}
DOMINANCE = {"SWALLOWED": 80, "BROAD": 60, "INTERRUPTED": 70}


def merged(spark, rows):
    out = f.merge_overlapping(spark.createDataFrame(rows, FINDINGS), LINE, PAIRS, DOMINANCE)
    return {(x.rule_id, x.finding_id): sorted(y.rule_id for y in x.related_signals or []) for x in out.collect()}


def test_merge_same_line_takes_the_dominant(spark):
    assert merged(spark, [(1, "r", "A", 20, "t", "BROAD", "e"), (2, "r", "A", 20, "t", "SWALLOWED", "e")]) == {("SWALLOWED", 2): ["BROAD"]}


def test_merge_pair_on_one_target_and_chain(spark):
    rows = [(1, "r", "A", 1, "t", "BROAD", ""), (2, "r", "A", 1, "t", "INTERRUPTED", ""), (3, "r", "A", 9, "t", "PRINT", ""), (4, "r", "B", 9, "t", "PRINT", ""), (5, "r", "A", 9, "u", "RAW", ""), (6, "r", "A", 8, "v", "HANDLER", ""), (7, "r", "A", 1, "t", None, "")]
    got = merged(spark, rows)
    assert got[("INTERRUPTED", 2)] == ["BROAD", "PRINT"]
    assert len(got) == 5 and sum(1 + len(v) for v in got.values()) == len(rows)


def test_suppress_keeps_null_rules(spark):
    rows = spark.createDataFrame([("r", "A"), ("r", None), ("s", "A")], "repo string, rule_id string")
    out = spark.createDataFrame([("r", "A"), ("r", None), ("r", " ")], "repo string, rule_id string")
    assert sorted((x.repo, x.rule_id or "") for x in f.suppress(rows, out).collect()) == [("r", ""), ("s", "A")]


def test_unknown_disabled_rule_is_an_error(spark):
    with pytest.raises(ValueError):
        r.rule_catalog(spark, [("A", "a", "ERROR", "X")], ["B"])


def test_corpus_scan_prunes_and_matches(spark, tmp_path):
    for path in ("one/src/a.properties", "one/target/b.properties", "two/c.txt", "two/d/e.properties"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("a.b = 1\r\n# no\nc:d=2\n=x\n")
    files = s.corpus_scan(spark, str(tmp_path), include=["*.properties"])
    assert sorted((x.repo, x.path) for x in files.collect()) == [("one", "src/a.properties"), ("two", "d/e.properties")]
    rows = s.parse_property_lines(s.explode_lines(files.where("repo = 'one'"))).orderBy("line").collect()
    assert [(x.line, x.name, x.value) for x in rows] == [(1, "a.b", "1"), (3, "c", "d=2")]


def test_budget_names_the_first_offender(spark):
    rows = spark.createDataFrame([("r", "a", 5), ("r", "b", 50), ("r", "c", 1), ("s", "a", 1)], "repo string, path string, size long")
    got = {x.repo: (x.accepted, x.first_offender) for x in s.within_budget(rows, 10, 20, 100).collect()}
    assert got == {"r": (False, "b"), "s": (True, None)}


def test_resolution_truth_table(spark):
    modules = [("m1", "r", "p1", "maven", ":a", "a", "g", "a", "1"), ("m2", "r", "p2", "maven", None, None, "g", "b", None), ("m3", "r", "p3", "maven", None, "c", "g", "c", "1"), ("m4", "s", "p4", "gradle", None, "c", "g", "c", "2"), ("m5", "s", "p5", "maven", None, None, "g", "d", "1"), ("m6", "s", "p5", "maven", None, None, "g", "d", "1")]
    modules = spark.createDataFrame(modules, "module string, repo string, path string, build_system string, project_path string, project_name string, group string, artifact string, version string")
    none = (None, None)
    decls = [
        (1, "r", "maven", *none, "g", "a", "1", False), (2, "r", "maven", *none, "g", "a", "9", False), (3, "r", "maven", *none, "g", "b", "7", False), (4, "r", "maven", *none, "g", "a", None, True), (5, "r", "ant", *none, "g", "c", None, True),
        (6, "r", "maven", *none, "x", "y", "1", False), (7, "r", "maven", *none, "x", "y", None, True), (8, "r", "gradle", *none, "g", "c", None, True), (9, "r", "maven", *none, "g", "d", "1", False), (10, "r", "maven", "m4", None, None, None, None, True),
        (11, "r", "maven", "m9", None, None, None, None, True), (12, "r", "gradle", None, ":a", None, None, None, False), (13, "s", "gradle", None, ":x:a", None, None, None, False), (14, "s", "ant", None, ":c", None, None, None, False), (15, "r", "maven", *none, "g", None, "1", False),
    ]
    decls = spark.createDataFrame(decls, "decl int, repo string, build_system string, target string, project_path string, group string, artifact string, version string, dynamic boolean")
    got = {x.decl: (x.resolution, x.module) for x in g.resolve_dependencies(decls, modules).collect()}
    open_ = ("UNRESOLVED", None)
    assert got == {
        1: ("LOCAL", "m1"), 2: ("EXTERNAL", None), 3: ("LOCAL", "m2"), 4: ("LOCAL", "m1"), 5: open_, 6: ("EXTERNAL", None), 7: open_, 8: ("LOCAL", "m4"), 9: ("LOCAL", "m5"), 10: ("LOCAL", "m4"),
        11: open_, 12: ("LOCAL", "m1"), 13: ("LOCAL", "m1"), 14: open_, 15: open_,
    }


def test_graph_of_three_and_a_cycle(spark):
    e3 = spark.createDataFrame([("service", "library"), ("consumer", "service"), ("x", "y"), ("y", "x"), ("x", "library"), ("l", "l")], "src string, dst string")
    levels = {x.node: x.level for x in g.dependency_levels(e3).collect()}
    assert levels["library"] < levels["service"] < levels["consumer"] and levels["x"] == levels["y"] == 1
    hit = {x.node: x.kind for x in g.impact(e3, spark.createDataFrame([("library",)], "node string")).collect()}
    assert hit == {"service": "DIRECT", "x": "DIRECT", "consumer": "TRANSITIVE", "y": "TRANSITIVE"}
    assert sorted((x.node, x.component) for x in g.cycle_groups(e3).collect()) == [("l", "l"), ("x", "x"), ("y", "x")]


def test_placeholders(spark):
    rows = spark.createDataFrame([("a", "${b}/${c:x}"), ("b", "${d:1}"), ("e", "${none}-${b}")], "name string, value string")
    got = {x.name: (x.value, x.unresolved) for x in p.resolve_placeholders(rows).collect()}
    assert got == {"a": ("1/x", False), "b": ("1", False), "e": ("${none}-1", True)}


def test_secrets(spark):
    rows = spark.createDataFrame([("db.password", "x"), ("db.password", "${DB_PW}"), ("jwt.token-validity", "5"), ("my.pat", "y"), ("path", "z")], "name string, value string")
    assert [x.value for x in p.redact_secrets(rows).collect()] == ["[redacted]", "${DB_PW}", "5", "[redacted]", "z"]


def test_findings_of_worker_json(spark):
    raw = [("a", '[{"level":"ERROR","rule":"R","file":"p","title":"t"}]'), ("b", '{"result":{"findings":[{"severity":"INFO","ruleID":"S"}]}}'), ("c", "broken"), ("d", None)]
    got = sorted((x.repo, x.severity, x.rule_id, x.path) for x in e.extract_findings(spark.createDataFrame(raw, "repo string, result string")).collect())
    assert got == [("a", "ERROR", "R", "p"), ("b", "INFO", "S", None)]


def test_sarif_has_levels_and_unknown_rules(spark):
    rows = spark.createDataFrame([("r", "MY_RULE", "ERROR", "p", 3, "m"), ("r", None, "odd", None, 0, None)], "repo string, rule_id string, severity string, path string, line int, message string")
    doc = json.loads(f.sarif_export(rows).first().document)
    run = doc["runs"][0]
    assert {x["id"]: x["name"] for x in run["tool"]["driver"]["rules"]} == {"MY_RULE": "MyRule", "UNKNOWN": "Unknown"}
    assert {x["ruleId"]: (x["level"], "locations" in x) for x in run["results"]} == {"MY_RULE": ("error", True), "UNKNOWN": ("none", False)}


def test_report_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("r", "p", "A", "m", 1), ("s", "q", "B", "n", 2)], "repo string, path string, rule_id string, message string, line int")
    f.write_report(rows, str(tmp_path / "out"))
    assert sorted((x.repo, x.rule_id) for x in spark.read.json(str(tmp_path / "out")).collect()) == [("r", "A"), ("s", "B")]


def test_hashes_do_not_depend_on_order(spark):
    rows = spark.createDataFrame([("r", str(k), f"text {k}") for k in range(20)], "repo string, path string, content string")
    a = i.tree_hash(i.file_manifest(rows)).first().content_hash
    assert a == i.tree_hash(i.file_manifest(rows.orderBy(F.desc("path")).repartition(3))).first().content_hash
    assert a != i.tree_hash(i.file_manifest(rows.withColumn("content", F.concat("content", F.lit("x"))))).first().content_hash


def test_base_url_needs_a_strict_winner(spark):
    urls = spark.createDataFrame([("billing.url",), ("orders.url",)], "name string")
    ends = spark.createDataFrame([("a", "BillingClient billing call"), ("b", "billing orders")], "endpoint string, hint string")
    assert [(x.endpoint, x.name) for x in e.best_base_url(ends, urls).collect()] == [("a", "billing.url")]


PLACES = {"application-[a-z0-9]+[.]": "application-dev.yml", "-(prod|production|staging)[.]": "application-prod.yml", "db/migration/V[0-9]": "db/migration/V1__a.sql", "db/migration/V1__": "db/migration/V1__a.sql", "application[.]": "application.yml", "-(test|ci|it|integration-test)[.]": "application-test.yml", "application(-(prod|production|staging|dev))?[.]": "application.yml"}


def test_every_rule_of_the_catalogue_fires_and_holds_back(spark):
    """Each rule on a repo of its facts' examples, and on one where a fact is missing or a guard is there."""
    facts, rules, lines = {x["name"]: x for x in c.facts()}, c.rules(), []
    assert len(c.all_rules()) == 199 and len({x["rule_id"] for x in c.all_rules()}) == 199
    for rule in rules:
        for kind in ("fires", "holds back"):
            held = [rule["needs"][0]] * rule["least"] + rule["needs"][1:]
            if kind == "holds back":
                held = held + rule["none"][:1] if rule["none"] else held[1:]
            for k, name in enumerate(held):
                fact = facts[name]
                path = PLACES.get(fact["path"]) if fact["path"] else f"src/A{k if rule['scope'] == 'repo' else ''}.java"
                lines.append((f"{kind} {rule['rule_id']}", path, 10 * (k + 1), fact["example"]))
    found = c.evaluate(c.line_facts(spark.createDataFrame(lines, "repo string, path string, line int, text string")))
    got = {(x.repo, x.rule_id) for x in found.collect()}
    assert [x["rule_id"] for x in rules if (f"fires {x['rule_id']}", x["rule_id"]) not in got] == []
    assert [x["rule_id"] for x in rules if (f"holds back {x['rule_id']}", x["rule_id"]) in got] == []


def test_long_chains(spark):
    """A thousand links: closure, parents, overlap groups."""
    n = 1000
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert g.dependency_closure(chain).count() == n * (n + 1) // 2
    parents = spark.range(n + 1).select(F.col("id").alias("module"), F.when(F.col("id") < n, F.col("id") + 1).alias("parent"), F.when(F.col("id") == n, "top").alias("group"), F.lit(None).cast("string").alias("version"))
    assert g.inherit_coordinates(parents).where("`group` = 'top' and version is null and not in_cycle").count() == n + 1
    pairs = spark.range(n).select(F.col("id"), F.explode(F.array(F.concat(F.lit("k"), F.col("id")), F.concat(F.lit("k"), F.col("id") + 1))).alias("key"))
    assert f.least_label(pairs).select("label").distinct().collect() == [(0,)]


def test_parents_in_a_circle_inherit_nothing(spark):
    rows = [("a", "b", None), ("b", "a", "gb"), ("c", "a", None), ("d", None, "gd"), ("e", "d", None)]
    got = {x.module: (x.group, x.in_cycle) for x in g.inherit_coordinates(spark.createDataFrame([(*r, None) for r in rows], "module string, parent string, group string, version string")).collect()}
    assert got == {"a": (None, True), "b": ("gb", True), "c": (None, False), "d": ("gd", False), "e": ("gd", False)}
