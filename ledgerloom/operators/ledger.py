"""Reading the ledger: live rows, search and pages, statistics, calendars, numbering, duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import values as V
from ledgerloom.operators.ranking import rank_within
from ledgerloom.schema import PAGE_HEADINGS

SEARCHED = ("name", "phone", "invoice_no", "bid", "product", "serial_no")
SORTABLE = ("id", "bid_date", "invoice_no", "name", "price", "dp_taken", "di", "month", "created_at")
COUNTED_INVOICE = r"^[0-9]{4}[0-9]+$"


def live(records: DataFrame) -> DataFrame:
    """Rows that aren't deleted; all where the table doesn't know of deletion."""
    return records.filter(F.col("deleted_at").isNull()) if "deleted_at" in records.columns else records


def filled(c: str) -> Column:
    return F.col(c) != ""


# Rows


def newest_first(records: DataFrame) -> DataFrame:
    return live(records).orderBy(F.desc("id"))


def by_id(records: DataFrame, id: int) -> DataFrame:
    """The row of an id, deleted or not."""
    return records.filter(F.col("id") == id)


def month_rows(records: DataFrame, month: str) -> DataFrame:
    return live(records).filter(F.col("month") == month).orderBy("sr_no", "id")


def scheme_candidates(records: DataFrame) -> DataFrame:
    """The eight columns that instalments are derived from, of dated rows with a two-part scheme."""
    return live(records).filter(F.contains("scheme", F.lit("/")) & filled("bid_date")).select("id", "name", "phone", "invoice_no", "product", "emi", "bid_date", "scheme")


def page_columns(records: DataFrame) -> DataFrame:
    """The business fields under the headings of the records page, dates without what follows their first blank."""
    value = lambda f: F.substring_index(F.coalesce("bid_date", F.lit("")), " ", 1) if f == "bid_date" else F.col(f)
    return records.select("id", *(value(f).alias(h) for f, h in PAGE_HEADINGS.items()))


def slash_dated(records: DataFrame) -> DataFrame:
    return records.filter(F.trim("bid_date").rlike(r"^\d{2}/\d{2}/\d{4}$")).select("id", "bid_date")


# Search


def search(records: DataFrame, query: str = "", name: str = "", phone: str = "", date_from: str = "", date_to: str = "", month: str = "", escape: bool = False) -> DataFrame:
    """Live rows that meet all conditions given; blank ones are none.

    Bounds of dates (DD-MM-YYYY, or else as they are) are compared as text with the date's positions put in
    order, as the ledger always did: a date kept in another form compares as whatever stands there.
    """
    def bound(text: str) -> str:
        try:
            d, m, y = map(int, text.split("-"))
            return date(y, m, d).isoformat()
        except ValueError:
            return text

    conditions = []
    if query:
        conditions.append(V.contains_any(SEARCHED, query, escape))
    if month:
        conditions.append(F.col("month") == month)
    if name:
        conditions.append(F.lower("name").like(f"%{name.strip().lower()}%"))
    if phone:
        conditions.append(F.col("phone").like(f"%{phone.strip()}%") | F.col("alt_phone").like(f"%{phone.strip()}%"))
    if date_from:
        conditions.append(V.positional_iso("bid_date") >= bound(date_from))
    if date_to:
        conditions.append(V.positional_iso("bid_date") <= bound(date_to))
    return reduce(DataFrame.filter, conditions, live(records))


def page(rows: DataFrame, sort_by: str = "id", descending: bool = True, number: int = 1, size: int = 50) -> DataFrame:
    """One page of rows in order; unknown keys sort by id, ties by id in the same direction."""
    keys = [V.positional_iso("bid_date"), F.col("sr_no")] if sort_by == "bid_date" else [F.col(sort_by if sort_by in SORTABLE else "id")]
    order = [k.desc() if descending else k.asc() for k in (*keys, F.col("id"))]
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_with_total(rows: DataFrame, sort_by: str = "id", descending: bool = True, number: int = 1, size: int = 50) -> DataFrame:
    """One page of rows and, beside each, how many rows there are on all pages."""
    return page(rows, sort_by, descending, number, size).crossJoin(rows.agg(F.count("*").alias("total")))  # one row


def page_count(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


# Statistics


def today_stats(records: DataFrame, as_of: date) -> DataFrame:
    """Number and sums of the rows dated today in any of three spellings."""
    spellings = [as_of.strftime(f) for f in ("%d-%m-%Y", "%d/%m/%Y", "%Y-%m-%d")]
    return live(records).filter(F.col("bid_date").isin(spellings)).agg(F.count("*").alias("n"), F.coalesce(V.money_sum("dp_taken"), F.lit(0.0)).alias("total_dp"), F.coalesce(V.money_sum("di"), F.lit(0.0)).alias("total_di"))


def _sums(blank: bool) -> list[Column]:
    xcell = F.sum(V.numeric_prefix("xcell").try_cast("decimal(18,2)")).cast("double")
    return [
        F.count("*").alias("n"),
        F.coalesce(V.money_sum("dp_taken"), F.lit(0.0)).alias("total_dp"),
        F.coalesce(V.money_sum("di"), F.lit(0.0)).alias("total_di"),
        (F.coalesce(xcell, F.lit(0.0)) if blank else xcell).alias("total_xcell"),
    ]


def totals(records: DataFrame, month: str = "") -> DataFrame:
    """Sums over the live rows (of a month); that of xcell is null where there are none."""
    rows = live(records)
    return (rows.filter(F.col("month") == month) if month else rows).agg(*_sums(False))


def monthly_cards(records: DataFrame) -> DataFrame:
    """Sums of each month's live rows."""
    return live(records).groupBy("month").agg(*_sums(True))


def monthly_counts(records: DataFrame) -> DataFrame:
    """Rows of each month, blank and null months too."""
    return live(records).groupBy("month").agg(F.count("*").alias("n"))


def daily_counts(records: DataFrame, month: str) -> DataFrame:
    return live(records).filter((F.col("month") == month) & filled("bid_date")).groupBy("bid_date").agg(F.count("*").alias("n"))


def daily_counts_normalised(records: DataFrame, month: str) -> DataFrame:
    """Spellings of a day counted together; texts that aren't dates keep their own count."""
    days = daily_counts(records, month).withColumn("day", V.normalise_date("bid_date"))
    return days.groupBy("day").agg(F.sum("n").alias("n"))


def daily_calendar(records: DataFrame, month: str) -> DataFrame:
    """Every day of a month with its number of rows."""
    spark = records.sparkSession
    days = spark.range(1).select(F.explode(V.days_of_month(V.month_start(F.lit(month)))).alias("d")).select(F.date_format("d", "dd-MM-yyyy").alias("day"))
    return days.join(daily_counts_normalised(records, month), "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def available_months(records: DataFrame, current: str) -> DataFrame:
    """The months there are and the current one, newest first, malformed ones before all."""
    months = live(records).filter(filled("month")).select("month")
    both = months.unionByName(records.sparkSession.range(1).select(F.lit(current).alias("month"))).distinct()
    return by_month(both, newest=True)


def by_month(df: DataFrame, newest: bool = False, month: str = "month") -> DataFrame:
    """In order of month keys; malformed keys count as later than all."""
    at = F.coalesce(V.month_start(month), F.lit("9999-12-31").cast("date"))
    return df.orderBy(at.desc(), F.col(month).desc()) if newest else df.orderBy(at.asc(), F.col(month).asc())


def latest_cards(records: DataFrame, n: int = 4) -> DataFrame:
    """Cards of the newest n months."""
    return by_month(monthly_cards(records).filter(filled("month")), newest=True).limit(n)


def cards_of(months: DataFrame, records: DataFrame) -> DataFrame:
    """The cards of listed months, zeros where there are no rows."""
    zero = {"n": 0, "total_dp": 0.0, "total_di": 0.0, "total_xcell": 0.0}
    return months.join(monthly_cards(records), "month", "left").fillna(zero)


def fingerprint(records: DataFrame) -> DataFrame:
    """Changes whenever the table does, deleted rows included."""
    return records.agg(F.count("*").alias("n"), F.max("id").alias("max_id"), F.max("updated_at").alias("max_updated"))


def row_text(records: DataFrame, columns: Sequence[str]) -> Column:
    """A row's values as one text: amounts to six decimals, times to microseconds in UTC, nulls apart from blanks."""
    def text(f: str) -> Column:
        kind = dict(records.dtypes)[f]
        c = F.col(f)
        if kind in ("double", "float"):
            c = F.when(F.isnan(c), "NaN").otherwise(F.coalesce(c.try_cast("decimal(28,6)").cast("string"), c.cast("string")))
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))

    return F.concat_ws("\x1f", *(text(c) for c in columns))


def checksum(records: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Number of rows and a hash of their contents (all columns by default) that doesn't depend on their order.

    Equal rows count each: the hashes, 60 bits of each row's digest, are added up, not only XORed.
    """
    h = F.conv(F.substring(F.md5(row_text(records, columns or records.columns)), 1, 15), 16, 10).cast("bigint")
    return records.agg(F.count("*").alias("n"), F.bit_xor(h).alias("hash_xor"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"))


# Numbering


def latest_invoice_code(records: DataFrame) -> DataFrame:
    return live(records).filter(F.col("invoice_no").rlike(COUNTED_INVOICE)).agg(F.coalesce(F.max(F.substring("invoice_no", 1, 4)), F.lit("")).alias("code"))


def max_invoice_counter(records: DataFrame, code: str) -> DataFrame:
    """The highest counter among a code's all-digit invoices; those too long for a number don't count."""
    own = live(records).filter(F.col("invoice_no").rlike(COUNTED_INVOICE) & F.col("invoice_no").startswith(code))
    return own.agg(F.coalesce(F.max(F.expr("substring(invoice_no, 5)").try_cast("bigint")), F.lit(0)).cast("bigint").alias("counter"))


def invoice_counters(records: DataFrame) -> DataFrame:
    """The highest counter of each code in one pass."""
    own = live(records).filter(F.col("invoice_no").rlike(COUNTED_INVOICE))
    return own.groupBy(F.substring("invoice_no", 1, 4).alias("code")).agg(F.max(F.expr("substring(invoice_no, 5)").try_cast("bigint")).alias("counter"))


def next_sr_no(records: DataFrame) -> DataFrame:
    """The next place of each month."""
    return live(records).groupBy("month").agg((F.coalesce(F.max("sr_no"), F.lit(0)) + 1).alias("next_sr"))


def renumbered(records: DataFrame) -> DataFrame:
    """Live rows of named months whose place changes when the month is numbered densely by (sr_no, id)."""
    rows = live(records).filter(filled("month")).select("id", "sync_id", "month", "sr_no")
    return rank_within(rows, ["month"], [F.asc_nulls_first("sr_no"), F.asc("id")], "new_sr").filter(~F.col("sr_no").eqNullSafe(F.col("new_sr")))


def neighbours(records: DataFrame) -> DataFrame:
    """Each live row's neighbours up and down in its month: the row at the next place, of several the newest."""
    rows = live(records).filter(filled("month")).select("id", "month", "sr_no")
    at = rows.groupBy("month", "sr_no").agg(F.max("id").alias("other"))
    up, down = (at.select("month", (F.col("sr_no") + step).alias("sr_no"), F.col("other").alias(name)) for step, name in ((1, "above"), (-1, "below")))
    return rows.join(up, ["month", "sr_no"], "left").join(down, ["month", "sr_no"], "left").select("id", "month", "sr_no", "above", "below")


def at_place(records: DataFrame, month: str, sr_no: int) -> DataFrame:
    return live(records).filter((F.col("month") == month) & (F.col("sr_no") == sr_no)).orderBy(F.desc("id")).limit(1)


def recent_invoices(records: DataFrame, n: int) -> DataFrame:
    return live(records).filter(filled("invoice_no")).select("id", "invoice_no").orderBy(F.desc("id")).limit(n)


def suggested_invoices(records: DataFrame, current: str, n: int = 5, among: int = 10) -> DataFrame:
    """The newest ``n`` of the last ``among`` invoices that aren't the current one."""
    return recent_invoices(records, among).filter(F.col("invoice_no") != current).orderBy(F.desc("id")).limit(n)


def last_invoice(records: DataFrame) -> DataFrame:
    """Of the newest row, blank or not."""
    return live(records).select("id", "invoice_no").orderBy(F.desc("id")).limit(1)


# Duplicates


def taken(records: DataFrame, column: str, text: str) -> DataFrame:
    """Whether a live row has this text, case aside; a blank text is never taken."""
    t = text.strip().lower()
    return live(records).agg(F.coalesce(F.bool_or(F.lower(column) == t), F.lit(False)).alias("taken")) if t else records.sparkSession.createDataFrame([(False,)], "taken boolean")


def invoice_owners(records: DataFrame) -> DataFrame:
    """``(invoice, owners, first_owner)``: each filled invoice in normal form and its number of sync_ids, deleted rows included."""
    inv = V.norm_text("invoice_no")
    return records.filter(F.col("sync_id").isNotNull()).select(inv.alias("invoice"), "sync_id").filter(F.col("invoice") != "").groupBy("invoice").agg(F.countDistinct("sync_id").alias("owners"), F.min("sync_id").alias("first_owner"))


def invoice_collisions(records: DataFrame) -> DataFrame:
    """Rows whose invoice other sync_ids have too; grouped, so no pairs are made."""
    own = records.filter(F.col("sync_id").isNotNull()).select("sync_id", V.norm_text("invoice_no").alias("invoice"))
    several = invoice_owners(records).filter("owners > 1")
    return own.distinct().join(several, "invoice").select("sync_id", "invoice", (F.col("owners") - 1).alias("others"))


def import_new(rows: DataFrame, records: DataFrame, order: str = "id") -> DataFrame:
    """Rows of an import that bring a new invoice and a new serial, taken in order.

    A row whose invoice or serial (case aside, blank ones don't count) the ledger or an accepted earlier row has is rejected; a
    rejected row blocks nobody.  Rows are settled in rounds: one that is the first of its undecided rivals on both keys
    is accepted, its rivals are rejected, until all are decided.  Each round is a pair of grouped minima.
    """
    from ledgerloom import storage

    key = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    todo = rows.select(F.col(order).alias("_o"), key("invoice_no").alias("_i"), key("serial_no").alias("_s"))
    for k, c in (("_i", "invoice_no"), ("_s", "serial_no")):
        held = live(records).select(key(c).alias(k)).filter(F.col(k).isNotNull()).distinct()
        todo = todo.join(held, k, "left_anti")
    todo, accepted = storage.cut(todo), []
    while not todo.isEmpty():
        first_i, first_s = (todo.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("_o").alias(f"_f{k}")) for k in ("_i", "_s"))
        ranked = todo.join(first_i, "_i", "left").join(first_s, "_s", "left")
        won = storage.cut(ranked.filter((F.coalesce("_f_i", "_o") == F.col("_o")) & (F.coalesce("_f_s", "_o") == F.col("_o"))).select("_o", "_i", "_s"))
        accepted.append(won.select("_o"))
        todo = todo.join(won.select("_o"), "_o", "left_anti")
        for k in ("_i", "_s"):
            todo = todo.join(won.filter(F.col(k).isNotNull()).select(k), k, "left_anti")
        todo = storage.cut(todo)
    if not accepted:
        return rows.limit(0)
    return rows.join(reduce(DataFrame.unionByName, accepted).withColumnRenamed("_o", order), order, "left_semi")


# Export


def workbook_rows(records: DataFrame) -> DataFrame:
    """Live rows under the month of their date, numbered by (date, digits at the invoice's end)."""
    d = V.parse_date("bid_date")
    rows = live(records).select("id", "invoice_no", "name", "product", "bid_date", F.coalesce(V.month_key(d), F.lit("UNKNOWN")).alias("sheet"), F.coalesce(d, F.lit("0001-01-01").cast("date")).alias("_d"), V.trailing_number("invoice_no").alias("_n"))
    return rank_within(rows, ["sheet"], [F.asc("_d"), F.asc("_n"), F.asc("id")], "sr").drop("_d", "_n")


def column_widths(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each column the width that shows its longest text, between 12 and 45."""
    wide = live(records).agg(*(F.least(F.greatest(F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)) + 2, F.lit(12)), F.lit(45)).alias(c) for c in columns))
    return wide.unpivot([], list(columns), "field", "width").select("field", F.col("width").cast("bigint").alias("width"))
