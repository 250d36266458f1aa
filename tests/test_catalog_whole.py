"""The catalogue queries cover all 199 rules, and lines meet facts without a shuffle of their texts."""

from corpusmill.operators import catalog as c
from corpusmill.operators import facts
from corpusmill.plans.bindings import SQL
from corpusmill.registry import QUERIES  # noqa: F401  registers the plans


def test_queries_hold_every_rule():
    assert len(c.rules(whole=True)) == 199 and len(c.facts(whole=True)) == 237
    for name in ("r2_catalog_findings", "r1_catalog_states"):
        assert [x["rule_id"] for x in c.all_rules() if f"'{x['rule_id']}'" not in SQL[name]] == []
    assert [f["name"] for f in c.facts(whole=True) if f"'{f['name']}'" not in SQL["r2_catalog_facts"]] == []


def test_rules_by_lines_alone(spark):
    rows = [("r", "A.java", 3, "@Transactional private void f() {"), ("r", "A.java", 3, "@Transactional private void f() {"), ("r", "B.java", 1, '@Service("main")'), ("s", "B.java", 1, '@Service("main")'), ("s", "C.java", 2, '@Service("main")')]
    lines = spark.createDataFrame(rows, "repo string, path string, line int, text string")
    found = c.line_facts(lines, c.facts(whole=True))
    assert found.count() == found.distinct().count()
    got = {(x.repo, x.path, x.line, x.rule_id) for x in c.evaluate(found, c.rules(whole=True)).collect()}
    assert ("r", "A.java", 3, "SPRING_TRANSACTIONAL_ON_PRIVATE_METHOD") in got and ("s", "B.java", 1, "SPRING_BEAN_NAME_COLLISION") in got
    assert not any(repo == "r" and rule == "SPRING_BEAN_NAME_COLLISION" for repo, _, _, rule in got)


def test_texts_meet_words_by_a_broadcast(spark):
    lines = spark.range(10).selectExpr("'r' AS repo", "'A.java' AS path", "id AS line", "concat('@Async ', id) AS text")
    plan = c.line_facts(lines)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_lines_of_one_piece_are_dealt(spark):
    lines = spark.range(100).coalesce(1).selectExpr("'r' AS repo", "id AS path", "1 AS line", "concat('${a.b:', id, '}') AS text")
    found = facts.property_references(lines)
    assert found.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions")) and found.count() == 100
