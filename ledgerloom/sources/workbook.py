"""Workbooks (.xlsx) as a Spark data source, read with the standard library, and written one sheet for each month."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(path: str, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The cells of a sheet (the first one if none is named) as texts, row by row."""
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for _, e in ElementTree.iterparse(f):
                    if e.tag == f"{_NS}si":
                        shared.append("".join(t.text or "" for t in e.iter(f"{_NS}t")))
                        e.clear()
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), targets[s.get(f"{_REL}id")]) for s in book.iter(f"{_NS}sheet")]
        target = next(t for n, t in sheets if sheet is None or n == sheet)
        with z.open("xl/" + target.lstrip("/").removeprefix("xl/")) as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag != f"{_NS}row":
                    continue
                row: list[str | None] = []
                for c in e.iter(f"{_NS}c"):
                    at = _column(c.get("r")) if c.get("r") else len(row)
                    row += [None] * (at + 1 - len(row))
                    v = c.find(f"{_NS}v")
                    if c.get("t") == "inlineStr":
                        row[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                    elif v is not None and v.text is not None:
                        row[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
                yield row
                e.clear()


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").option("columns", "a,b,c").load(path)``: one task for each path given.

    Columns are by position, all texts; the first row is a header; rows with nothing in them are left out.
    Options: columns (required unless a schema is given), sheet, paths (several, by commas).
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return ", ".join(f"`{c.strip()}` string" for c in self.options["columns"].split(","))

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(self.options, len(schema))


class WorkbookReader(DataSourceReader):
    def __init__(self, options, width: int):
        self.paths = (options.get("paths") or options["path"]).split(",")
        self.sheet, self.width = options.get("sheet"), width

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = sheet_rows(partition.value, self.sheet)
        next(rows, None)
        for r in rows:
            r = (r + [None] * self.width)[: self.width]
            if any(v not in (None, "") for v in r):
                yield tuple(r)


def write_workbook(path: str, sheets: Iterator[tuple[str, Sequence[str], Iterator[Sequence]]]) -> None:
    """Writes sheets ``(name, headers, rows)`` as they come; rows aren't held."""
    names = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, headers, rows in sheets:
            names.append(name[:31])
            with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as f:
                f.write(b'<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                f.write(_row(headers).encode())
                for r in rows:
                    f.write(_row(r).encode())
                f.write(b"</sheetData></worksheet>")
        n = range(1, len(names) + 1)
        z.writestr("xl/workbook.xml", '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(s)}" sheetId="{i}" r:id="r{i}"/>' for i, s in zip(n, names, strict=True)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n) + "</Types>")


def _row(values: Sequence) -> str:
    cells = (f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for v in values)
    return "<row>" + "".join(cells) + "</row>"


def import_rows(rows: DataFrame) -> DataFrame:
    """Rows of a workbook with their amounts as numbers; rows with other text for an amount are left out."""
    from ledgerloom.functions import values as V

    amounts = [c for c in ("price", "emi", "di", "dp_taken", "given_prod_price") if c in rows.columns]
    blank = lambda c: V.clean_amount(c) == ""
    readable = F.lit(True)
    for c in amounts:
        readable = readable & (blank(c) | V.try_number(V.clean_amount(c)).isNotNull())
    return rows.filter(readable).withColumns({c: V.amount(c) for c in amounts})


def import_defaults(rows: DataFrame, order: str) -> DataFrame:
    """Rows of an import with the keys they lack: a blank place is the row's number in order, a blank invoice IMP- and this number."""
    from ledgerloom.operators.ranking import rank_within

    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    ranked = rank_within(rows, [], [F.asc(order)], "_n")
    number = F.when(F.col("_n") < 1000, F.lpad(F.col("_n").cast("string"), 3, "0")).otherwise(F.col("_n").cast("string"))
    return ranked.withColumns({"sr_no": F.when(blank("sr_no"), F.col("_n")).otherwise(F.col("sr_no")), "invoice_no": F.when(blank("invoice_no"), F.concat(F.lit("IMP-"), number)).otherwise(F.col("invoice_no"))}).drop("_n")


def import_counts(rows: DataFrame, imported: DataFrame) -> DataFrame:
    """One row: how many rows of an import came in, and how many were left out."""
    return rows.agg(F.count("*").alias("_all")).crossJoin(imported.agg(F.count("*").alias("imported"))).select("imported", (F.col("_all") - F.col("imported")).alias("skipped"))  # one row each


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)
