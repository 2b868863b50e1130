"""Exports and backups: partitioned files, SQL text, JSON, workbooks, settings, and snapshots with a pointer."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import storage
from ledgerloom.functions import values as V
from ledgerloom.operators.ledger import by_month, checksum, workbook_rows
from ledgerloom.sources.workbook import write_workbook


def export_months(records: DataFrame, path: str, form: str = "csv") -> None:
    """One folder of files for each month, rows numbered as in the workbook."""
    rows = workbook_rows(records)
    rows.repartitionByRange("sheet", "sr").sortWithinPartitions("sheet", "sr").write.partitionBy("sheet").format(form).option("header", "true").mode("overwrite").save(path)


def export_workbook(records: DataFrame, path: str) -> None:
    """A workbook with a sheet for each month, newest first; rows stream through the driver, one sheet after another."""
    rows = storage.cut(workbook_rows(records))
    months = [r["sheet"] for r in by_month(rows.select("sheet").distinct(), newest=True, month="sheet").collect()]
    columns = [c for c in rows.columns if c != "sheet"]

    def sheets() -> Iterator[tuple[str, Sequence[str], Iterator[Sequence]]]:
        for m in months:
            yield m, columns, (tuple(r) for r in rows.filter(F.col("sheet") == m).orderBy("sr").select(*columns).toLocalIterator())

    write_workbook(path, sheets())


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """``value``: one INSERT for each row, quotes doubled, nulls as NULL, numbers bare."""
    numeric = {f.name for f in df.schema if f.dataType.typeName() in ("long", "integer", "double", "float", "decimal")}
    cells = [V.sql_literal(c, c in numeric) for c in df.columns]
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("), F.concat_ws(", ", *cells), F.lit(");")).alias("value"))


def backup(df: DataFrame, path: str, table: str, at: datetime | None = None) -> dict:
    """The table as SQL text and as JSON lines, and a manifest of what was read back from these: rows, checksum, whether both are the table's."""
    insert_statements(df, table).write.mode("overwrite").text(f"{path}/sql")
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/json")
    spark = df.sparkSession
    own, again = (checksum(t, df.columns).first() for t in (df, spark.read.schema(df.schema).json(f"{path}/json")))
    statements = spark.read.text(f"{path}/sql", wholetext=False, lineSep=";\n").count()
    manifest = {"created_at_utc": (at or datetime.now(timezone.utc)).isoformat(timespec="seconds"), "table": table, "rows": again["n"], "statements": statements, "checksum": f"{own['hash_xor']:x}-{own['hash_sum']}", "verified": own == again}
    storage.put(spark, f"{path}/manifest.json", json.dumps(manifest, indent=2))
    return manifest


def backup_invoices(df: DataFrame, path: str, invoice: str = "invoice_no") -> None:
    """A folder of JSON for each invoice."""
    df.withColumn("invoice", V.safe_name(F.coalesce(F.nullif(F.col(invoice), F.lit("")), F.lit("none")))).repartition("invoice").write.partitionBy("invoice").mode("overwrite").option("ignoreNullFields", "false").json(path)


def settings(path: str, defaults: dict) -> dict:
    """A JSON file laid over defaults; the defaults alone where it can't be read."""
    try:
        return defaults | json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return dict(defaults)


class Snapshots:
    """Versions of a table under a folder; a version counts once it is complete, readers take the newest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        return [int(n[1:]) for n in storage.children(self.spark, self.path) if n.startswith("v") and storage.exists(self.spark, f"{self.path}/{n}/_SUCCESS")]

    def commit(self, df: DataFrame, expected: int | None = None) -> int:
        """Writes the next version; refuses if ``expected`` isn't the newest."""
        newest = max(self.versions(), default=0)
        if expected is not None and expected != newest:
            raise ValueError(f"the newest version is {newest}, not {expected}")
        df.write.parquet(f"{self.path}/v{newest + 1:06d}")
        return newest + 1

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{version or max(self.versions()):06d}")

    def restore(self, version: int) -> int:
        return self.commit(self.read(version))


def append_log(spark: SparkSession, path: str, kind: str, details: str, at: datetime | None = None) -> None:
    line = f"[{kind}] {(at or datetime.now(timezone.utc)).isoformat(timespec='seconds')}: {details}"
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)
