"""Timestamps typed in many ways made one: a dictionary of distinct raw strings, each parsed once.

``TimestampDictionary`` keeps ``(raw, tz) -> (instant, day)`` as Parquet runs in the shared folder.
``extend`` takes the distinct pairs of a table, drops those already held, parses the rest once and
appends them as a run; ``join`` lays the results beside the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from threading import Lock
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import storage

# Abbreviations in use where the zone's own rules have none (or not all), as minutes east of UTC. GMT is UTC
# in every zone.
ABBREVIATIONS = {"Asia/Dubai": {"GST": 240}, "Europe/London": {"WET": 0}}
MONTHS = {m: i for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)}
LONG_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

EPOCH, WORKBOOK = datetime(1970, 1, 1), datetime(1899, 12, 30)
#: A number under this many days is a workbook day, under this many seconds a count of seconds, else of milliseconds.
MOST_DAYS, MOST_SECONDS = 2_958_466, 100_000_000_000

_WORD = r"(?P<mon>[A-Za-z]{3,9})\.?"
_DATES = [
    re.compile(p)
    for p in (
        r"(?P<y>\d{4})(?P<sep>[-/.])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})",
        r"(?P<d>\d{1,2})(?P<sep>[-/.])(?P<m>\d{1,2})(?P=sep)(?P<y>\d{4}|\d{2})(?!\d)",
        r"(?P<y>\d{4})(?P<m>\d\d)(?P<d>\d\d)(?=T|$|\s)",
        rf"(?P<d>\d{{1,2}})(?:st|nd|rd|th)?[-\s/.]\s*{_WORD}[-\s/.,]\s*(?P<y>\d{{4}}|\d{{2}})(?!\d)",
        rf"{_WORD}\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})",
        rf"(?P<y>\d{{4}})[-\s/]{_WORD}[-\s/](?P<d>\d{{1,2}})",
    )
]
_WEEKDAY = re.compile(r"(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun)[a-z]*\.?,?\s+", re.I)
_TIME = re.compile(r"(?P<h>\d{1,2}):(?P<mi>\d\d)(?::(?P<s>\d\d)(?:[.,](?P<f>\d{1,12}))?)?(?:\s*(?P<ap>[AaPp]\.?[Mm]\.?)(?![A-Za-z]))?|(?P<h2>\d\d)(?P<mi2>\d\d)(?P<s2>\d\d)(?:[.,](?P<f2>\d{1,12}))?")
#: As C libraries print a time: month, day, clock, perhaps a zone, year.
_YEAR_LAST = re.compile(rf"{_WORD}\s+(?P<d>\d{{1,2}})\s+(?P<t>\d{{1,2}}:\d\d(?::\d\d(?:[.,]\d{{1,12}})?)?)(?:\s+(?P<z>[A-Za-z+][\w+:/-]*))?\s+(?P<y>\d{{4}})")
_BRACKETED = re.compile(r"(.*?)\s*\[([^\]]+)\]")
_OFFSET = re.compile(r"(?:UTC|GMT)?(?P<sg>[+-])(?P<oh>\d{1,2}):?(?P<om>\d\d)?")
_NUMBER = re.compile(r"\d+(?:\.\d+)?")


@lru_cache(64)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


@lru_cache(64)
def abbreviations(tz: str) -> dict[str, int]:
    """Minutes east of UTC of each abbreviation that a zone's clocks have gone by since 1970, the latest meaning."""
    zone, out = _zone(tz), {}
    if zone is not None:
        for month in range(0, 12 * 70):
            at = datetime(1970 + month // 12, month % 12 + 1, 1, tzinfo=zone)
            if (name := at.tzname()) and name.isalpha():
                out[name.upper()] = int(at.utcoffset().total_seconds()) // 60
    return out | ABBREVIATIONS.get(tz, {})


def _micros(d: timedelta) -> int:
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def _instant(local: datetime, zone: ZoneInfo) -> int:
    """Microseconds since 1970 in UTC of a clock time: of two the first; a skipped one by the offset before."""
    offset = local.replace(tzinfo=zone, fold=0).utcoffset()
    return _micros(local - EPOCH - offset)


def _day(micros: int, zone: ZoneInfo) -> str:
    at = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)
    return at.astimezone(zone).date().isoformat()


def _number(text: str, zone: ZoneInfo | None) -> tuple[int | None, str | None]:
    whole, _, part = text.partition(".")
    n = int(whole)
    if n < MOST_DAYS:  # workbook days on the counter's clock, to the nearest second
        seconds = round((n + (int(part) / 10 ** len(part) if part else 0)) * 86_400)
        local = WORKBOOK + timedelta(seconds=seconds)
        return (None if zone is None else _instant(local, zone)), local.date().isoformat()
    if n < MOST_SECONDS:
        micros = n * 1_000_000 + int((part + "000000")[:6])
    else:
        micros = n * 1_000 + int((part + "000")[:3])
    return micros, (None if zone is None else _day(micros, zone))


def utc_text(micros: int | None) -> str | None:
    """``2026-01-31T09:05:00.000000Z`` of microseconds since 1970."""
    if micros is None:
        return None
    try:
        return (EPOCH + timedelta(microseconds=micros)).isoformat(timespec="microseconds") + "Z"
    except OverflowError:
        return None


def parse(raw: str | None, tz: str | None) -> tuple[int | None, str | None]:
    """``(microseconds since 1970 in UTC, calendar day in zone tz)`` of a text; nulls where it can't be read.

    Without zone or offset a time is by the clock of ``tz``; where that is null or unknown, only the
    day can be told.
    """
    if raw is None:
        return None, None
    text = " ".join(raw.split()).strip(" '\"")
    if not text:
        return None, None
    zone = _zone(tz) if tz else None
    try:
        if _NUMBER.fullmatch(text) and not (len(text) == 8 and text.isdigit()):
            return _number(text, zone)
        text = _WEEKDAY.sub("", text, count=1) if _WEEKDAY.match(text) else text
        if c := _YEAR_LAST.fullmatch(text):
            text = f"{c['d']} {c['mon']} {c['y']} {c['t']} {c['z'] or ''}".rstrip()
        for shape in _DATES:
            m = shape.match(text)
            if m:
                break
        else:
            return None, None
        g = m.groupdict()
        if g.get("mon"):
            word = g["mon"].lower()
            if word not in MONTHS and word not in LONG_MONTHS and word != "sept":
                return None, None
            month = MONTHS[word[:3]]
        else:
            month = int(g["m"])
        year = int(g["y"]) + (2000 if len(g["y"]) == 2 else 0)
        day = date(year, month, int(g["d"]))
        rest = text[m.end() :].lstrip()
        if rest[:1] in ("T", "t", ",") or rest.startswith("at "):
            rest = rest[1:].lstrip() if rest[:1] in ("T", "t", ",") else rest[3:]
        local, extra = datetime(day.year, day.month, day.day), 0
        if rest:
            t = _TIME.match(rest)
            if not t:
                return None, None
            h, mi, s, f = (int(t["h"] or t["h2"]), int(t["mi"] or t["mi2"]), int(t["s"] or t["s2"] or 0), (t["f"] or t["f2"] or ""))
            if t["ap"]:
                if not 1 <= h <= 12:
                    return None, None
                h = h % 12 + (12 if t["ap"][0] in "Pp" else 0)
            if h == 24 and mi == 0 and s == 0:
                h, extra = 0, 1
            local = datetime(day.year, day.month, day.day, h, mi, min(s, 59) if s == 60 else s, int((f + "000000")[:6])) + timedelta(days=extra, seconds=1 if s == 60 else 0)
            rest = rest[t.end() :].strip(" ()")
            if named := _BRACKETED.fullmatch(rest):  # an offset stands before its zone's name
                rest = named[1] or named[2]
        if not rest:
            return (None if zone is None else _instant(local, zone)), local.date().isoformat()
        if rest in ("Z", "z", "UTC", "GMT"):
            micros = _micros(local - EPOCH)
        elif o := _OFFSET.fullmatch(rest):
            minutes = int(o["oh"]) * 60 + int(o["om"] or 0)
            if minutes > 18 * 60 or int(o["om"] or 0) > 59:
                return None, None
            micros = _micros(local - EPOCH) - (1 if o["sg"] == "+" else -1) * minutes * 60_000_000
        elif "/" in rest and (named := _zone(rest)):
            micros = _instant(local, named)
        elif tz and (minutes := abbreviations(tz).get(rest.upper())) is not None:
            micros = _micros(local - EPOCH) - minutes * 60_000_000
        else:
            return None, None
        return micros, (None if zone is None else _day(micros, zone))
    except (ValueError, OverflowError):
        return None, None


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [parse(r, z) for r, z in zip(b["raw"].to_pylist(), b["tz"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b["raw"], b["tz"], pa.array([utc_text(x) for x, _ in found], pa.string()), pa.array([d for _, d in found], pa.string())], ["raw", "tz", "instant", "day"]
        )


class TimestampDictionary:
    """Distinct ``(raw, tz)`` pairs and what they mean, kept as runs of Parquet under ``path``."""

    SCHEMA = "raw string, tz string, instant string, day string"
    _lock = Lock()

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def runs(self) -> list[str]:
        return [f"{self.path}/{n}" for n in storage.children(self.spark, self.path) if n.startswith("run-") and storage.exists(self.spark, f"{self.path}/{n}/_SUCCESS")]

    def entries(self) -> DataFrame:
        runs = self.runs()
        return self.spark.read.schema(self.SCHEMA).parquet(*runs) if runs else self.spark.createDataFrame([], self.SCHEMA)

    def extend(self, pairs: DataFrame) -> None:
        """Parses those of the distinct pairs ``(raw, tz)`` that aren't held yet and appends them as a run; none if all are.

        A run that was cut short has no success mark and doesn't count.  Calls of one driver follow one another; drivers
        that run at once need dictionaries of their own.
        """
        with self._lock:
            self._extend(pairs.select("raw", "tz"))

    def _extend(self, new: DataFrame) -> None:
        if self.runs():
            new = new.join(self.entries().select("raw", "tz"), ["raw", "tz"], "left_anti")
            if new.isEmpty():
                return
        runs = storage.children(self.spark, self.path)
        new.mapInArrow(_parse_batches, self.SCHEMA).write.parquet(f"{self.path}/run-{len(runs):06d}")

    def join(self, rows: DataFrame, hot: DataFrame) -> DataFrame:
        """``rows`` (with raw and tz) and their instant and day; ``hot``: the pairs, few, that hold many rows.

        The hot pairs' entries are broadcast, so no task gets all rows of one string; the others are
        joined by hash.
        """
        few = [(r["raw"], r["tz"]) for r in hot.select("raw", "tz").collect()]
        if not few:
            return rows.join(self.entries(), ["raw", "tz"], "left")
        parsed = [(r, z, utc_text(parse(r, z)[0]), parse(r, z)[1]) for r, z in few]
        dictionary = self.spark.createDataFrame(parsed, "raw string, tz string, _instant string, _day string").withColumn("_hot", F.lit(True))
        marked = rows.join(F.broadcast(dictionary), ["raw", "tz"], "left")
        rest = marked.filter("_hot IS NULL").drop("_instant", "_day", "_hot").join(self.entries(), ["raw", "tz"], "left")
        own = marked.filter("_hot").withColumnsRenamed({"_instant": "instant", "_day": "day"}).drop("_hot")
        return rest.unionByName(own)


def normalise(rows: DataFrame, zones: DataFrame, fields: dict[str, str], dictionary: TimestampDictionary, key: str = "id", place: str = "counter_id", hot_pairs: int = 2000) -> DataFrame:
    """``(key, field, norm)`` for each readable text of ``fields`` (field -> "instant" or "day").

    ``zones`` has ``place`` and ``tz``, one row for each place (the first by zone name if it has more); rows of
    an unknown place are read without a clock: only what has its own zone or needs none can be read.  The
    clock joined on isn't broadcast by hand: whether ``zones`` is small enough is the planner's to tell.

    Each distinct ``(raw, tz)`` is parsed once.  Strings that hold more than one in ``hot_pairs`` of all
    texts are fewer than ``hot_pairs``; their entries alone are broadcast.
    """
    clock = zones.groupBy(F.col(place).alias("_place")).agg(F.min("tz").alias("tz"))
    stack = ", ".join(f"'{f}', cast(`{f}` as string)" for f in fields)
    texts = (
        rows.select(F.col(key).alias("_key"), F.col(place).alias("_place"), *(F.col(f) for f in fields))
        .selectExpr("_key", "_place", f"stack({len(fields)}, {stack}) as (field, raw)")
        .filter("raw IS NOT NULL")
        .join(clock, "_place", "left")
        .select("_key", "field", "raw", F.coalesce("tz", F.lit("")).alias("tz"))
    )
    pairs = storage.cut(texts.groupBy("raw", "tz").count())
    dictionary.extend(pairs)
    total = pairs.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()["n"]
    hot = pairs.filter(F.col("count") > max(1000, total // hot_pairs))
    norm = F.when(F.col("field").isin([f for f, kind in fields.items() if kind == "day"]), F.col("day")).otherwise(F.col("instant"))
    return dictionary.join(texts, hot).select(F.col("_key").alias(key), "field", norm.alias("norm")).filter("norm IS NOT NULL")
