"""Running sums and numbers over a whole table's order, without a task that sees all of it.

Rows are cut to ranges of the order at sampled points, so that crowded values get as
many ranges as they need; the ranges' totals, one row each, are summed in order, and
each range goes on from the sum of those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pondera.plans.scratch import Scratch

PART = "_part"


def ranges(rows: DataFrame, *order: str, descending: bool = False) -> DataFrame:
    """The rows with ``_part``, the place of their range; equal keys are in one range.

    The table is written: sampling cuts it anew each time, and sums must be of the
    ranges that rows are in.
    """
    keys = [F.desc(c) if descending else F.asc(c) for c in order]
    return Scratch(rows.sparkSession, "ranges").keep(rows.repartitionByRange(*keys).withColumn(PART, F.spark_partition_id()), "rows")


def running_sums(rows: DataFrame, *order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Add each sum of a column up to and with the row: ``sums`` names the new column of each old one.

    Rows that are equal in ``order`` are in any order among themselves; nulls count as 0.
    """
    cut = ranges(rows, *order, descending=descending)
    totals = cut.groupBy(PART).agg(*[F.sum(c).alias(c) for c in sums])
    ahead = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col(PART).alias("_p"), *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_before_{c}") for c in sums])
    within = Window.partitionBy(PART).orderBy(*[F.desc(c) if descending else F.asc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    run = cut.withColumns({f"_run_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums}).join(F.broadcast(before), F.col(PART) == F.col("_p"))  # a row for each range
    return run.select(*rows.columns, *[(F.col(f"_run_{c}") + F.col(f"_before_{c}")).alias(name) for c, name in sums.items()])


def number(keys: DataFrame, key: str) -> DataFrame:
    """``key, ordinal``: the distinct keys from 0 in their order."""
    one = keys.select(key).distinct().withColumn("_one", F.lit(1).cast("long"))
    return running_sums(one, key, sums={"_one": "_upto"}).select(key, (F.col("_upto") - 1).alias("ordinal"))
