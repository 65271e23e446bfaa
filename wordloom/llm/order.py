"""Places of rows in an order, without one task seeing a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch


def indexed(df: DataFrame, group: str, order: list[str], scratch: Scratch) -> DataFrame:
    """``df`` with ``group_no`` (groups in ascending order, from 0), ``index`` (from 0 in its group, without gaps) and ``group_size`` (rows of the group).

    Rows are dealt by ranges of (group, order), so that a group of any size is spread over many tasks, sorted
    there and written. A place is the place inside its task plus the rows of the group in earlier tasks; these
    sums have one row for each group and task. Rows that are equal in group and order take consecutive places.
    The names ``_part``, ``_at`` and those of the results must be free; no rows give no rows.
    """
    names = df.columns
    rows = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    rows = scratch.table(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    pieces = rows.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("group_size", F.sum("_n").over(W.partitionBy(group)))
    # groups are numbered by the tasks in which they begin: a sum over tasks, then places inside a task
    pieces = scratch.table(pieces.withColumn("_begins", (F.col("_before") == 0).cast("long")))
    tasks = pieces.groupBy("_part").agg(F.sum("_begins").alias("_b"), F.count("*").alias("_pieces"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a task of the exchange above
    tasks = tasks.select("_part", F.coalesce(F.sum("_b").over(earlier), F.lit(0)).alias("_groups"))
    inside = W.partitionBy("_part").orderBy("_first").rowsBetween(W.unboundedPreceding, 0)
    pieces = pieces.join(tasks, "_part").withColumn("group_no", F.col("_groups") + F.sum("_begins").over(inside) - 1)
    both = rows.join(pieces.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_first", "_before", "group_size", "group_no"), (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p")))
    return both.select(*names, "group_no", (F.col("_before") + F.col("_at") - F.col("_first")).alias("index"), "group_size")
