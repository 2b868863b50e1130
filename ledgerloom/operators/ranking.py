"""Row numbers without a single task for all rows, or for all rows of one group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import storage


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with its row number from 1 within ``group`` (none: among all rows) by ``order``, as bigint ``name``.

    Rows are range-partitioned by group and order, so a group with a third of all rows is spread over a third
    of the tasks; each task numbers its rows, and counts of the groups' parts, a table of about as many rows as
    there are tasks and groups, give what to add.  Equal rows by ``order`` get their numbers in any order.
    """
    keys = [*(F.col(g).asc_nulls_first() for g in group), *order]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = storage.cut(placed.withColumn("_part", F.shiftright("_at", 33)))
    parts = placed.groupBy("_part", *group).agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    if group:
        w = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    else:  # one row for each task
        w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_from") + 1).drop("_from", "_n")
    parts = parts.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), "_before")
    on = placed["_part"] == parts["_p"]
    for i, g in enumerate(group):
        on = on & placed[g].eqNullSafe(parts[f"_g{i}"])
    ranked = placed.join(parts, on).withColumn(name, (F.col("_at") + F.col("_before")).cast("bigint"))
    return ranked.drop("_at", "_part", "_p", "_before", *(f"_g{i}" for i in range(len(group))))
