"""Running totals and ranks within keys of any size: two passes over ranges of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.storage import cut


def running_totals(rows: DataFrame, keys: list[str], order: list, sums: dict[str, str]) -> DataFrame:
    """rows with, for each name of sums, the total of its column over the rows of the same keys up to and with this one.

    Rows are dealt by range of keys and order, so that a key with most of the rows lies in many ranges; within a range
    totals run in order, and each starts from the totals of the ranges before, of which there is one row a key and range. Rows that are equal in
    keys and order come in any order."""
    by: list[Column] = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = cut(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    cells = dealt.groupBy(*keys, "_range").agg(*(F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = [F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in sums]
    cells = cells.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_range").alias("_key_range"), *bases)
    within = Window.partitionBy(*keys, "_range").orderBy(*by[len(keys) :]).rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.select("*", *(F.sum(c).over(within).alias(f"_run_{n}") for n, c in sums.items()))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys] + [F.col("_range") == F.col("_key_range")]
    run = run.join(cells, same)
    return run.select(*rows.columns, *((F.col(f"_run_{n}") + F.col(f"_base_{n}")).alias(n) for n in sums))
