"""The last value before each row, without a single task for all rows of one group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import storage

#: Rows of one group beyond which it is scanned in chunks.
HOT_ROWS = 100_000


def hot_groups(df: DataFrame, group: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The groups of more than ``hot_rows`` rows; None if there are none."""
    hot = storage.cut(df.groupBy(group).count().filter(F.col("count") > hot_rows).select(group, F.lit(True).alias("_hot")))
    return None if hot.isEmpty() else hot


def last_before(df: DataFrame, group: str, order: str, values: dict[str, Column], hot: DataFrame | None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` and under each name of ``values`` its last value that isn't null among the group's rows before this one.

    ``order`` is a bigint unique within the group.  A group of ``hot`` (``hot_groups``) is cut into chunks of ``hot_rows``
    consecutive places, each scanned by itself; what each chunk ends with, one row a chunk, is scanned
    in turn and carried into the next ones.
    """
    df = df.withColumns({f"_set_{n}": v for n, v in values.items()})
    before = lambda *by: Window.partitionBy(*by)
    last = lambda n, w: F.last(n, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    drop = [f"_set_{n}" for n in values]
    if hot is None:
        return df.withColumns({n: last(f"_set_{n}", before(group).orderBy(order)) for n in values}).drop(*drop)
    cut = df.join(hot, group, "left").withColumn("_chunk", F.when(F.col("_hot"), F.floor(F.col(order) / hot_rows)).otherwise(F.lit(0)).cast("bigint"))
    within = cut.withColumns({f"_in_{n}": last(f"_set_{n}", before(group, "_chunk").orderBy(order)) for n in values})
    ends = cut.filter("_hot").groupBy(group, "_chunk").agg(*(F.max(F.when(F.col(f"_set_{n}").isNotNull(), F.struct(order, F.col(f"_set_{n}").alias("v"))))["v"].alias(f"_end_{n}") for n in values))
    carried = ends.select(group, "_chunk", *(last(f"_end_{n}", before(group).orderBy("_chunk")).alias(f"_from_{n}") for n in values))
    both = within.join(carried, [group, "_chunk"], "left").withColumns({n: F.coalesce(f"_in_{n}", f"_from_{n}") for n in values})
    return both.drop("_hot", "_chunk", *drop, *(f"_{x}_{n}" for x in ("in", "from") for n in values))
