"""Ranks and running totals over a whole table without one task that holds it.

Rows are dealt out by ranges of their order and written once; a range's rows are counted and summed by
themselves, and only one row for each range is put in one order to give every range what lies before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep, shuffle_tasks


def _dealt(df: DataFrame, order: list) -> DataFrame:
    """df written in ranges of `order`, with each row's range (_part) and place in it (_at)."""
    cut = df.repartitionByRange(shuffle_tasks(df.sparkSession), *order).sortWithinPartitions(*order)
    part = F.spark_partition_id()
    return keep(cut.withColumn("_part", part).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ordered")


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """df with the row number (from 1) in `order`, which must tell all rows apart."""
    cut = _dealt(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return cut.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def running(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """df with running totals up to and including each row: sums maps a new column to the one it adds up."""
    cut = _dealt(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    totals = totals.select("_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(F.broadcast(totals), "_part")
    return out.withColumns({n: F.col(f"_b_{n}") + F.sum(c).over(within) for n, c in sums.items()}).drop("_part", "_at", *[f"_b_{n}" for n in sums])


def running_max(df: DataFrame, order: list, tops: dict[str, str]) -> DataFrame:
    """df with the largest value before each row, null for the first: tops maps a new column to the one it is of."""
    cut = _dealt(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy("_part").agg(*[F.max(c).alias(n) for n, c in tops.items()])
    parts = parts.select("_part", *[F.max(n).over(before).alias(f"_b_{n}") for n in tops])
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(F.broadcast(parts), "_part")
    return out.withColumns({n: F.greatest(F.max(c).over(within), F.col(f"_b_{n}")) for n, c in tops.items()}).drop("_part", "_at", *[f"_b_{n}" for n in tops])


def next_known(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """df with the first value that is not null at or after each row in `order`."""
    cut = _dealt(df, order)
    after = Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    heads = cut.groupBy("_part").agg(F.min_by(F.struct(F.col(value).alias("v")), F.when(F.col(value).isNotNull(), F.col("_at"))).alias("_h"))
    heads = heads.select("_part", F.first("_h.v", ignorenulls=True).over(after).alias("_following"))
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(0, Window.unboundedFollowing)
    out = cut.join(F.broadcast(heads), "_part")
    return out.withColumn(name, F.coalesce(F.first(value, ignorenulls=True).over(within), F.col("_following"))).drop("_part", "_at", "_following")


def value_counts(rows: DataFrame, keys: list[str], counts: dict[str, Column]) -> DataFrame:
    """Distinct values with their counts: what is put in order is combined map-side first."""
    return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in counts.items()])
