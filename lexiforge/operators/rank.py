"""Places within groups that may be of any size, and joins by keys that may be null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.sources.spool import partitions, spool


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys in which null equals null; the keys come once."""
    other = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    out = left.join(other, on, how)
    return out.drop(*[f"__r_{k}" for k in keys])


def place_in_groups(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    """df and each row's place (long, from 1) in its group.

    Rows are dealt to ranges of group and order, counted there, and the counts of earlier ranges are added, so a group of
    any size is spread over tasks.
    """
    n = partitions(df.sparkSession)
    dealt = spool(df.repartitionByRange(n, *group, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part", *group).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__part", *group, F.coalesce(F.sum("__n").over(earlier), F.lit(0).cast("long")).alias("__before"))
    here = F.row_number().over(Window.partitionBy("__part", *group).orderBy(*order))
    out = join_same(dealt.withColumn("__here", here), before, ["__part", *group])
    return out.withColumn(name, F.col("__before") + F.col("__here")).drop("__before", "__here", "__part")
