"""Places of rows in the order of a large group, without sorting the group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.written import written


def numbered(rows: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """rows with their place (from 1) within the group by order.

    Rows are dealt by ranges of group and order, so a group of any size is many ranges; each numbers its own rows, and what lies before a range in its group is a
    sum over counts by range, of which a group has at most as many as there are partitions. order must tell rows of a group apart."""
    keys = [F.col(group).asc_nulls_first(), *order]
    dealt = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("mark_", F.monotonically_increasing_id()), "ranges").withColumn("range_", F.shiftright("mark_", 33))
    counts = dealt.groupBy(F.col(group).alias("group_"), F.col("range_").alias("in_")).agg(F.min("mark_").alias("first_"), F.count("*").alias("size_"))
    before = F.coalesce(F.sum("size_").over(Window.partitionBy("group_").orderBy("in_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("group_", "in_", (before - F.col("first_") + 1).alias("start_"))
    placed = dealt.join(starts, F.col(group).eqNullSafe(F.col("group_")) & (F.col("range_") == F.col("in_")))
    return placed.withColumn(name, (F.col("mark_") + F.col("start_")).cast("int")).drop("mark_", "range_", "group_", "in_", "start_")
