"""Column helpers over names, paths and dotted keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefixes(col: Column, sep: str) -> Column:
    """All leading parts of a separated name, itself last: a.b.c gives a, a.b, a.b.c."""
    parts = F.split(col, "[" + sep + "]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws(sep, F.slice(parts, 1, n)))


def normal_name(col: Column) -> Column:
    return F.lower(F.trim(col))


def kebab(col: Column) -> Column:
    """fieldName or field_name to field-name."""
    return F.lower(F.regexp_replace(F.regexp_replace(col, "([a-z0-9])([A-Z])", "$1-$2"), "[_ ]+", "-"))


def severity_rank(col: Column) -> Column:
    return F.when(col == "ERROR", 3).when(col == "WARNING", 2).when(col == "INFO", 1).otherwise(0)


def normal_severity(col: Column) -> Column:
    s = F.upper(F.trim(col))
    return F.when(s.isin("ERROR", "ERR"), "ERROR").when(s.isin("WARNING", "WARN"), "WARNING").when(s == "INFO", "INFO").otherwise("UNKNOWN")


def chosen(key: Column, values: list[Column]) -> Column:
    """The value at key (from 0), found by halves. Only that one is computed, and a pattern in it is compiled once, not once a row."""

    def part(k: Column, low: int, high: int) -> Column:
        mid = (low + high) // 2
        return values[low] if high - low == 1 else F.when(k < mid, part(k, low, mid)).otherwise(part(k, mid, high))

    return F.transform(F.array(key), lambda k: part(k, 0, len(values)))[0]
