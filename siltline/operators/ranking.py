"""Ranks over groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltline.session import cut


def distributed_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column], weight: str, name: str = "rank") -> DataFrame:
    """Adds the 1-based position of each row in its group, a row counting ``weight`` times; equal rows of the order follow one another.

    Rows are range-partitioned by (group, order), so a large group spreads over many tasks. Positions within a task
    are running sums; the sums of the earlier tasks of a group, one number per task and group, are added after.
    """
    # both uses below must see the same partitions, also after an executor is lost
    placed = cut(df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("_before", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    sums = placed.groupBy("_part", *group).agg(F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", *group, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    keyed = [F.col(f"r.{g}").eqNullSafe(F.col(f"o.{g}")) for g in group]
    condition = F.col("r._part") == F.col("o._part")
    for k in keyed:
        condition = condition & k
    joined = ranked.alias("r").join(offsets.alias("o"), condition)
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("_before") + F.col("_offset") + 1).alias(name))
