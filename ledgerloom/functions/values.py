"""Scalar functions of the ledger as Catalyst expressions: texts, amounts, dates, JSON."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def try_number(text: Column) -> Column:
    """A text that is a number and nothing else; letters that only the engine's cast takes (12d, NaN) don't count."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def strip(c: Column | str) -> Column:
    """Without white space at the ends, of any script."""
    return F.regexp_replace(col(c).cast("string"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def clean_amount(c: Column | str) -> Column:
    """Text of an amount without commas; blank for null."""
    return strip(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), ",", ""))


def amount(c: Column | str) -> Column:
    """The number of an amount's text, 0 where there is none."""
    return F.coalesce(try_number(clean_amount(c)), F.lit(0.0))


def format_amount(c: Column | str) -> Column:
    n = try_number(clean_amount(c))
    return F.when(n.isNotNull(), F.format_number(n, 2)).otherwise(F.coalesce(col(c).cast("string"), F.lit("")))


def numeric_prefix(c: Column | str) -> Column:
    """The longest number that a text begins with, commas aside; 0 where it begins with none; null for null."""
    found = F.regexp_extract(F.regexp_replace(col(c), ",", ""), _PREFIX, 1)
    return F.when(col(c).isNotNull(), F.coalesce(found.try_cast("double"), F.lit(0.0)))


def money_sum(c: Column | str) -> Column:
    """A sum that doesn't depend on the order of its terms."""
    return F.sum(col(c).try_cast("decimal(18,2)")).cast("double")


def norm_text(c: Column | str) -> Column:
    """Upper case, white space collapsed; blank for null."""
    return F.upper(F.trim(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"[\s\p{Z}]+", " ")))


def round2(c: Column) -> Column:
    """To two decimals, ties by the exact binary value to the even digit."""
    return F.regexp_replace(F.format_number(c, 2), ",", "").cast("double")


def norm_number(c: Column | str) -> Column:
    return round2(try_number(clean_amount(c)))


def _built(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")


def _dated(text: Column) -> Column:
    """Day-month-year with dashes or slashes, or year-month-day; null for others and for days that don't exist."""
    day_first, year_first = r"^(\d{1,2})([-/])(\d{1,2})\2(\d{4})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    part = lambda p, i: F.regexp_extract(text, p, i)
    return F.when(text.rlike(day_first), _built(part(day_first, 4), part(day_first, 3), part(day_first, 1))).when(text.rlike(year_first), _built(part(year_first, 1), part(year_first, 2), part(year_first, 3)))


def parse_date(c: Column | str) -> Column:
    """The date of a text's first word."""
    return _dated(F.substring_index(strip(c), " ", 1))


def parse_date_whole(c: Column | str) -> Column:
    """The date of a text that is nothing but a date."""
    return _dated(col(c))


def normalise_date(c: Column | str) -> Column:
    """DD-MM-YYYY where the text can be read, else the text, blank for null."""
    return F.coalesce(F.date_format(parse_date(c), "dd-MM-yyyy"), col(c), F.lit(""))


def norm_date(c: Column | str) -> Column:
    """ISO date of a text's first ten characters, else the text in normal form; for comparing."""
    s = strip(c)
    return F.coalesce(F.date_format(_dated(F.substring(s, 1, 10)), "yyyy-MM-dd"), norm_text(c))


def month_key(date: Column) -> Column:
    """AUGUST_2026 of a date."""
    return F.upper(F.date_format(date, "MMMM_yyyy"))


def month_of(c: Column | str) -> Column:
    """Month key of a date's text as compared; blank where it can't be read."""
    return F.coalesce(month_key(_dated(F.substring(strip(c), 1, 10))), F.lit(""))


def month_start(c: Column | str) -> Column:
    """First day of a month key; null where it isn't one."""
    c = col(c)
    names = F.array(*(F.lit(m) for m in ("JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER")))
    shape = r"^([A-Za-z]+)_(\d{4})$"
    place = F.array_position(names, F.upper(F.regexp_extract(c, shape, 1)))
    return F.when(c.rlike(shape) & (place > 0), F.concat_ws("-", F.regexp_extract(c, shape, 2), F.lpad(place.cast("string"), 2, "0"), F.lit("01")).try_cast("date"))


def month_label(c: Column | str) -> Column:
    """Aug 2026 of AUGUST_2026; other keys in title case."""
    return F.coalesce(F.date_format(month_start(c), "MMM yyyy"), F.initcap(F.regexp_replace(col(c), "_", " ")))


def days_of_month(first: Column) -> Column:
    return F.sequence(first, F.last_day(first))


def first_of_month_after(date: Column, months: Column | int) -> Column:
    return F.add_months(F.trunc(date, "MM"), months)


def two_parts(c: Column | str) -> Column:
    """``struct(first, second)`` of whole numbers with one slash between; null for all else."""
    parts = F.split(col(c), "/")
    number = lambda i: F.trim(F.get(parts, F.lit(i)))
    fine = (F.size(parts) == 2) & number(0).rlike(r"^[+-]?\d+$") & number(1).rlike(r"^[+-]?\d+$")
    return F.when(fine, F.struct(number(0).try_cast("int").alias("first"), number(1).try_cast("int").alias("second")))


def utc_text(at: Column) -> Column:
    """ISO text of an instant in UTC."""
    return F.date_format(F.convert_timezone(None, F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def age(at: Column, now: Column) -> Column:
    """How long ago an instant was, in words; null for null."""
    s = F.unix_timestamp(now) - F.unix_timestamp(at)
    words = lambda n, unit: F.concat(n.cast("bigint").cast("string"), F.lit(f" {unit}"), F.when(n.cast("bigint") == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(s < 60, "just now").when(s < 3600, words(s / 60, "minute")).when(s < 86_400, words(s / 3600, "hour")).when(s >= 86_400, words(s / 86_400, "day"))


def positional_iso(c: Column | str) -> Column:
    """Year, month and day by place in a DD-MM-YYYY text, whatever stands there; compared as text."""
    c = col(c)
    return F.concat(F.substring(c, 7, 4), F.lit("-"), F.substring(c, 4, 2), F.lit("-"), F.substring(c, 1, 2))


def display(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def safe_name(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[^A-Za-z0-9_-]+", "_")


def trailing_number(c: Column | str) -> Column:
    """Digits at a text's end as a number, 0 where there are none."""
    return F.coalesce(F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(\d+)$", 1).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))


def padded_counter(n: Column) -> Column:
    """At least two digits, any number of more."""
    return F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))


def sql_literal(c: Column | str, numeric: bool = False) -> Column:
    text = col(c).cast("string")
    return F.coalesce(text if numeric else F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def as_deleted(c: Column | str) -> Column:
    c = col(c)
    return F.when(~F.lower(F.trim(c)).isin("", "null", "none"), c)


def canonical_json(fields: Sequence[str]) -> Column:
    """Sorted keys, no blanks, nulls kept."""
    return F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})


def json_list(c: Column | str) -> Column:
    """Texts of a JSON list; none where it isn't one."""
    return F.coalesce(F.from_json(col(c), "array<string>"), F.array().cast("array<string>"))


def label(c: Column | str, names: dict[str, str]) -> Column:
    c = col(c)
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.try_element_at(known, c), F.initcap(F.regexp_replace(c, "_", " ")))


def contains_any(columns: Sequence[str], text: str, escape: bool = False) -> Column:
    """Whether any column holds a text, case aside. ``%`` and ``_`` stand for others unless ``escape``."""
    text = text.strip().lower()
    return reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(text)) if escape else F.lower(c).like(f"%{text}%") for c in columns))


def sha256_rows(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


# The words of numbers.
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()


def spell(n: int) -> str:
    """A whole number in words."""
    if n < 0:
        return "minus " + spell(-n)
    if n < 20:
        return _ONES[n]
    if n < 100:
        return _TENS[n // 10] + (f"-{_ONES[n % 10]}" if n % 10 else "")
    if n < 1000:
        return _ONES[n // 100] + " hundred" + (f" and {spell(n % 100)}" if n % 100 else "")
    for size, word in ((10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (1000, "thousand")):
        if n >= size:
            rest = n % size
            return f"{spell(n // size)} {word}" + ((" and " if rest < 100 else ", ") + spell(rest) if rest else "")
    raise AssertionError


@F.pandas_udf(StringType())
def amount_words(n: pd.Series) -> pd.Series:
    """Whole amounts in words, in title case; null for null."""
    return n.map(lambda x: None if pd.isna(x) or abs(x) >= 1e15 else spell(int(x)).title())
