"""Places in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagloom.operators.lineage import settle

# Bits of a row's number within its partition in Spark's increasing ids.
_ROW_BITS = 33
# Rows that one range is to hold; more rows make more ranges.
RANGE_ROWS = 200_000


def range_count(df: DataFrame, range_rows: int = RANGE_ROWS) -> int:
    """Ranges so that each holds about ``range_rows`` rows, and at least one a shuffle partition."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // range_rows))


def numbered(df: DataFrame, out: str, *order: str | Column) -> DataFrame:
    """Adds ``out``: the place of each row in the order, from 0.

    The order is dealt to partitions by range, so equal leading values can lie in
    several; rows are counted per partition, and the counts before a partition are
    added to a row's number in it. One task sees only one count per partition. The
    partitions grow in number with the rows, so that a task sorts no more of a larger table."""
    ordered = df.repartitionByRange(range_count(df), *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = settle(ordered, "ordered")
    part = F.shiftright("_id", _ROW_BITS)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = rows.join(F.broadcast(before), part == F.col("_part"))
    place = F.col("_before") + F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)
    return placed.withColumn(out, place).select(*df.columns, out)


def numbered_within(df: DataFrame, out: str, group: str, *order: str | Column) -> DataFrame:
    """Adds ``out``: the place of each row among those of its group, from 0. A group may lie in many tasks."""
    rows = numbered(df, "_place", group, *order)
    first = rows.groupBy(F.col(group).alias("_group")).agg(F.min("_place").alias("_first"))
    joined = rows.join(first, F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn(out, F.col("_place") - F.col("_first")).select(*df.columns, out)
