"""Changes of the ledger as snapshots made from snapshots; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import values as V
from ledgerloom.operators.ledger import filled, live
from ledgerloom.operators.ranking import rank_within


def add(records: DataFrame, new: DataFrame, current_month: str) -> DataFrame:
    """The ledger with new rows (its columns but id, sr_no and month): dates normalised, month by the date or
    else the current one, places after the month's last, ids after the last; in the order of column ``_seq``."""
    dated = new.withColumns({"month": F.coalesce(V.month_key(V.parse_date("bid_date")), F.lit(current_month)), "bid_date": V.normalise_date("bid_date")})
    last = live(records).groupBy("month").agg(F.max("sr_no").alias("_last"))
    placed = rank_within(dated, ["month"], [F.asc("_seq")], "_place").join(last, "month", "left")
    top = records.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    rows = rank_within(placed, [], [F.asc("_seq")], "_n").withColumns({"sr_no": (F.coalesce("_last", F.lit(0)) + F.col("_place")).cast("bigint"), "id": F.col("_n") + F.lit(top)})
    return records.unionByName(rows.drop("_seq", "_place", "_last", "_n"), allowMissingColumns=True)


def update(records: DataFrame, changes: DataFrame) -> DataFrame:
    """The ledger with the columns of ``changes`` (one row for each id) laid over its live rows.

    Place stays; the month follows the date, blank where it can't be read.  Ids that aren't there, or are deleted, change nothing.
    """
    fields = [c for c in changes.columns if c != "id"]
    over = changes.select("id", F.struct(*fields).alias("_new"))
    hit = F.col("_new").isNotNull() & (F.col("deleted_at").isNull() if "deleted_at" in records.columns else F.lit(True))
    out: dict[str, Column] = {f: F.when(hit, F.col(f"_new.{f}")).otherwise(F.col(f)) for f in fields}
    if "bid_date" in fields:
        out["bid_date"] = F.when(hit, V.normalise_date("_new.bid_date")).otherwise(F.col("bid_date"))
        out["month"] = F.when(hit, F.coalesce(V.month_key(V.parse_date("_new.bid_date")), F.lit(""))).otherwise(F.col("month"))
    return records.join(over, "id", "left").withColumns(out).select(*records.columns)


def delete(records: DataFrame, ids: DataFrame, deleted_at: str, physical: bool = False) -> DataFrame:
    """The ledger without some ids: marked as deleted, or gone, and the months they were in numbered densely."""
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    marked = records.join(gone, "id", "left")
    touched = marked.filter(F.col("_gone") & filled("month")).select("month").distinct()
    left = marked.filter(F.col("_gone").isNull()).drop("_gone") if physical else marked.withColumn("deleted_at", F.when(F.col("_gone") & F.col("deleted_at").isNull(), F.lit(deleted_at)).otherwise(F.col("deleted_at"))).drop("_gone")
    places = rank_within(live(left).join(touched, "month", "left_semi").select("id", "month", "sr_no"), ["month"], [F.asc_nulls_first("sr_no"), F.asc("id")], "_sr").select("id", "_sr")
    return left.join(places, "id", "left").withColumn("sr_no", F.coalesce("_sr", "sr_no")).select(*records.columns)


def swap_places(records: DataFrame, a: int, b: int) -> DataFrame:
    """The ledger with the places of two live rows exchanged; unchanged if either isn't there."""
    pair = live(records).filter(F.col("id").isin(a, b)).select("id", "sr_no")
    other = pair.select(F.when(F.col("id") == a, b).otherwise(a).cast("bigint").alias("id"), F.struct(F.col("sr_no").alias("to")).alias("_other"))
    both = pair.agg((F.countDistinct("id") == 2).alias("_both"))
    moved = pair.select("id").join(other, "id").crossJoin(both).filter("_both").select("id", "_other")  # two rows and one
    return records.join(moved, "id", "left").withColumn("sr_no", F.when(F.col("_other").isNotNull(), F.col("_other.to")).otherwise(F.col("sr_no"))).select(*records.columns)


def migrate_dates(records: DataFrame) -> DataFrame:
    """``id, bid_date, month`` of the rows that change: ISO dates are rewritten; others only where the month is wrong."""
    d = V.parse_date("bid_date")
    iso = V.strip("bid_date").rlike(r"^\d{4}-")
    month, text = V.month_key(d), F.date_format(d, "dd-MM-yyyy")
    wrong = d.isNotNull() & (iso | ~F.col("month").eqNullSafe(month))
    return records.filter(wrong).select("id", text.alias("bid_date"), month.alias("month"))


def migrate_slashes(records: DataFrame) -> DataFrame:
    """``id, bid_date, month`` of DD/MM/YYYY dates in canonical form; days that don't exist stay."""
    d = V.parse_date("bid_date")
    return records.filter(F.trim("bid_date").rlike(r"^\d{2}/\d{2}/\d{4}$") & d.isNotNull()).select("id", F.date_format(d, "dd-MM-yyyy").alias("bid_date"), V.month_key(d).alias("month"))


def slash_counts(records: DataFrame) -> DataFrame:
    """One row: DD/MM/YYYY dates that ``migrate_slashes`` rewrites, those it leaves as no day is meant, and those that then remain."""
    slashed = records.filter(F.trim("bid_date").rlike(r"^\d{2}/\d{2}/\d{4}$"))
    bad = F.count_if(V.parse_date("bid_date").isNull())
    return slashed.agg(F.count_if(V.parse_date("bid_date").isNotNull()).alias("updated"), bad.alias("skipped"), bad.alias("remaining"))


def upsert(records: DataFrame, rows: DataFrame, key: str = "sync_id", version: str = "server_rev", expected: str | None = None) -> DataFrame:
    """The table with ``rows`` (one for each key) put in by key; with ``expected`` only where the stored version is that one, null being 0.

    Rows of a null key are kept apart: they match nothing and are never replaced.
    """
    new = rows.withColumn("_new", F.lit(True)).select(F.col(key), F.struct(*[c for c in rows.columns if c != key], "_new").alias("_row"))
    joined = records.withColumn("_old", F.lit(True)).join(new, key, "full")
    use = F.col("_row").isNotNull()
    if expected:
        use = use & (F.col("_old").isNull() | (F.coalesce(F.col(f"_row.{expected}"), F.lit(0)) == F.coalesce(version, F.lit(0))))
    given = set(rows.columns)
    return joined.select(*(F.col(key) if c == key else F.when(use, F.col(f"_row.{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in records.columns))
