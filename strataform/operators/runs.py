"""Values that run along a group's rows in order, without one task per group.

Rows are dealt into blocks of ``BLOCK`` consecutive order numbers. Inside a block a window gives the
value; what a block needs from those before it comes from a table of one row per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 1 << 16


def _joined(rows: DataFrame, ends: DataFrame, group: str) -> DataFrame:
    other = ends.withColumnsRenamed({group: "other_group", "block_": "other_block"})
    return rows.join(other, F.col(group).eqNullSafe(F.col("other_group")) & F.col("block_").eqNullSafe(F.col("other_block")), "left").drop("other_group", "other_block", "block_")


def previous(rows: DataFrame, group: str, order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """Add ``name``: a struct with ``value`` of the group's row before, null for its first row."""
    dealt = rows.withColumn("block_", F.floor(F.col(order) / block))
    inside = Window.partitionBy(group, "block_").orderBy(order)
    ends = dealt.groupBy(group, "block_").agg(F.max_by(F.struct(value), order).alias("tail"))
    ends = ends.select(group, "block_", F.lag("tail").over(Window.partitionBy(group).orderBy("block_")).alias("carried"))
    marked = dealt.withColumn(name, F.lag(F.struct(value)).over(inside))
    return _joined(marked, ends, group).withColumn(name, F.coalesce(name, "carried")).drop("carried")


def running_sum(rows: DataFrame, group: str, order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the group's rows up to this one."""
    dealt = rows.withColumn("block_", F.floor(F.col(order) / block))
    inside = Window.partitionBy(group, "block_").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = dealt.groupBy(group, "block_").agg(F.sum(value).alias("part"))
    before = F.sum("part").over(Window.partitionBy(group).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(group, "block_", before.alias("carried"))
    marked = dealt.withColumn(name, F.sum(value).over(inside))
    return _joined(marked, ends, group).withColumn(name, F.col(name) + F.coalesce("carried", F.lit(0))).drop("carried")

