"""SQLite files as a Spark data source, opened for reading only."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_TYPES = (("INT", "bigint"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BLOB", "binary"))


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def tables(path: str) -> dict[str, list[tuple[str, str]]]:
    """Tables of a file and their columns with Spark's types."""
    with _open(path) as c:
        names = [n for (n,) in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        return {n: [(r[1], next((t for k, t in _TYPES if k in (r[2] or "").upper()), "string")) for r in c.execute(f'PRAGMA table_info("{n}")')] for n in names}


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_file").option("table", t).load(path)``, split by rowid into ``partitions`` tasks."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def schema(self) -> str:
        return ", ".join(f"`{c}` {t}" for c, t in tables(self.options["path"])[self.options["table"]])

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options, [(f.name, f.dataType.simpleString()) for f in schema])


class SqliteReader(DataSourceReader):
    def __init__(self, options, columns: list[tuple[str, str]]):
        self.path, self.table, self.columns = options["path"], options["table"], columns
        self.n = int(options.get("partitions", "4"))

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as c:
            lo, hi = c.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.table}"').fetchone()
        step = max(1, -(-(hi - lo + 1) // self.n))
        return [InputPartition((a, a + step)) for a in range(lo, hi + 1, step)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        a, b = partition.value
        make = {"bigint": int, "double": float, "string": str, "binary": bytes}
        kinds = [make[t] for _, t in self.columns]
        with _open(self.path) as c:
            names = ", ".join(f'"{n}"' for n, _ in self.columns)
            for row in c.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (a, b)):
                yield tuple(None if v is None else k(v) for v, k in zip(row, kinds, strict=True))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)
