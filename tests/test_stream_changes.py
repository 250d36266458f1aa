"""New and withdrawn findings of a stream of file versions."""

import datetime
import uuid

from pyspark.sql import functions as F

from corpusmill.streaming.audit import CHANGE, run_changes, version_changes

RULES = [{"rule_id": "A", "severity": "INFO", "category": "X", "pattern": "a[0-9]"}, {"rule_id": "B", "severity": "INFO", "category": "X", "pattern": "b"}]
FILES = "repo string, path string, content string, ts timestamp"


def day(k):
    return datetime.datetime(2024, 1, k)


def replay(spark, folder, batches):
    base = f"{folder}/{uuid.uuid4().hex}"
    for rows in batches:
        spark.createDataFrame(rows, FILES).write.mode("append").parquet(f"{base}/in")
        run_changes(spark.readStream.schema(FILES).parquet(f"{base}/in"), RULES, f"{base}/out", f"{base}/state")
    return sorted((r.path, r.ts.day, r.change, r.rule_id, r.line, r.evidence) for r in spark.read.schema(CHANGE).parquet(f"{base}/out").collect())


ROWS = [
    ("r", "p", "x\na1\nb", day(1)), ("r", "p", "a1 \r\nx\na1", day(2)), ("r", "p", None, day(3)), ("r", "p", "x\n\n\nb", day(5)),
    ("r", "q", "b", day(1)), ("r", "q", "new\nb", day(2)), ("r", "q", "b\nb", day(4)), ("r", "q", "", day(6)), (None, None, "a7", day(2)), ("r", "z", "a1", None),
]
EXPECTED = [
    ("", 2, "new", "A", 1, "a7"),
    ("p", 1, "new", "A", 2, "a1"), ("p", 1, "new", "B", 3, "b"), ("p", 2, "new", "A", 3, "a1"), ("p", 2, "withdrawn", "B", 3, "b"),
    ("p", 3, "withdrawn", "A", 1, "a1"), ("p", 3, "withdrawn", "A", 3, "a1"), ("p", 5, "new", "B", 4, "b"),
    ("q", 1, "new", "B", 1, "b"), ("q", 4, "new", "B", 2, "b"), ("q", 6, "withdrawn", "B", 1, "b"), ("q", 6, "withdrawn", "B", 2, "b"),
]


def test_replay_is_the_batch_difference(spark, tmp_path):
    batch = version_changes(spark.createDataFrame(ROWS, FILES), RULES).collect()
    assert sorted((r.path, r.ts.day, r.change, r.rule_id, r.line, r.evidence) for r in batch) == EXPECTED
    assert replay(spark, tmp_path, [ROWS]) == EXPECTED
    later = lambda r: r[3] is not None and r[3] > day(3)
    assert replay(spark, tmp_path, [[r for r in ROWS if not later(r)], [r for r in ROWS if later(r)]]) == EXPECTED


def test_a_version_that_comes_late_changes_nothing(spark, tmp_path):
    got = replay(spark, tmp_path, [[("r", "p", "a1", day(4))], [("r", "p", "b", day(2)), ("r", "p", "a1", day(4))], [("r", "p", "b", day(5))]])
    assert got == [("p", 4, "new", "A", 1, "a1"), ("p", 5, "new", "B", 1, "b"), ("p", 5, "withdrawn", "A", 1, "a1")]


def test_repeated_versions_of_one_time(spark):
    """Both are versions, in order of their findings; the batch gives what each adds and withdraws."""
    rows = [("r", "p", "a1", day(1)), ("r", "p", "b", day(1)), ("r", "p", "b", day(1))]
    got = version_changes(spark.createDataFrame(rows, FILES), RULES)
    assert sorted((r.change, r.rule_id) for r in got.collect()) == [("new", "A"), ("new", "B"), ("withdrawn", "A")]
    assert version_changes(spark.createDataFrame([], FILES), RULES).count() == 0
