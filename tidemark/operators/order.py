"""Positions and running sums over all rows of a table, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

#: Rows of a block of cumulative(); a window never holds more.
BLOCK = 4096


def numbered(df: DataFrame, group: list[str], order: list[str], write: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """df with pos, the row's place (from 0) in its group by order, nulls first, and n, the group's size.

    The group's columns must not be null; rows that agree in group and order stand in any order. Rows are
    dealt out by ranges of (group, order), so a large group spreads over many tasks; only the number of its
    rows in each task is summed up.
    """
    columns = [*group, *order]
    rows = write(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = write(parts.select(*group, "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n")), "parts")
    return rows.join(parts, [*group, "_part"]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).select(*df.columns, "pos", "n")


def cumulative(df: DataFrame, pos: str, columns: list[str], n: int) -> DataFrame:
    """df, whose column pos numbers it from 0 to n - 1, with before_<c> for each of columns: the sum of c over the rows before.

    Blocks of BLOCK rows are summed by themselves, then the blocks' totals in the same way.
    """
    block = F.floor(F.col(pos) / BLOCK)
    before = Window.partitionBy("_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_block", block).withColumns({f"before_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in columns})
    if n <= BLOCK:
        return rows.drop("_block")
    totals = df.groupBy(block.alias("_block")).agg(*(F.sum(c).alias(c) for c in columns)).withColumnRenamed("_block", pos)
    totals = cumulative(totals, pos, columns, (n - 1) // BLOCK + 1)
    totals = totals.select(F.col(pos).alias("_block"), *(F.col(f"before_{c}").alias(f"_all_{c}") for c in columns))
    rows = rows.join(totals, "_block")
    return rows.withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"_all_{c}") for c in columns}).select(*df.columns, *(f"before_{c}" for c in columns))
