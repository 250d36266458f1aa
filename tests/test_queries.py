"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from corpusmill.registry import QUERIES, SQL

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def rows(frame):
    text = lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in r) for r in frame)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    mine = QUERIES[name](spark, str(DATA))
    found = db.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(mine.columns)
    assert rows(mine.select(*[f"`{c}`" for c in columns]).collect()) == rows(found.fetchall())
