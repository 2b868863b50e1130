"""The ledger's fields, their classes, and the labels they are shown under."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

# The business fields of a row in order, and the classes that decide how they are merged.
BUSINESS_FIELDS = (
    "sr_no", "bid_date", "invoice_no", "name", "xcell", "product", "serial_no", "price", "emi", "di", "bid", "dp_taken", "scheme", "actual_product", "given_prod_price", "phone", "alt_phone", "month", "remarks",
)
FINANCIAL_FIELDS = ("price", "emi", "di", "dp_taken", "given_prod_price")
SAFE_FIELDS = ("name", "phone", "alt_phone", "product", "actual_product", "xcell", "remarks", "bid_date")
UNMERGED_FIELDS = ("sr_no", "invoice_no", "month")
MONTHS = ("JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER")

SYNC_COLUMNS = {"sync_id": "string", "server_rev": "bigint", "row_rev": "bigint", "base_json": "string", "deleted_at": "string"}
# What kinds of conflict are called.
KIND_LABELS = {"field": "Field conflict", "financial": "Amount conflict", "serial": "Serial conflict", "sr_ordering": "Order conflict", "invoice_collision": "Invoice collision", "delete_edit": "Deleted and edited"}
# The headings of the records page in order, and the labels of fields read from a delivery order.
PAGE_HEADINGS = {f: f.upper().replace("_", " ") for f in BUSINESS_FIELDS}
EXTRACTED_LABELS = {"name": "Customer Name", "product": "Product", "price": "Price", "mobile": "Phone", "address": "Address", "bid": "BID / DO ID", "bid_date": "BID Date", "emi": "EMI", "di": "DI", "scheme": "Scheme"}
FIELD_LABELS = {"sr_no": "SR No", "bid_date": "Date", "invoice_no": "Invoice", "serial_no": "Serial", "di": "Disbursed", "emi": "EMI", "dp_taken": "Down payment", "bid": "DO ID"}

FIELD_TYPES = {f: "bigint" if f == "sr_no" else "double" if f in FINANCIAL_FIELDS else "string" for f in BUSINESS_FIELDS}
BUSINESS_STRUCT = T.StructType([T.StructField(f, {"bigint": T.LongType(), "double": T.DoubleType()}.get(t, T.StringType())) for f, t in FIELD_TYPES.items()])


def ensure_columns(df: DataFrame, columns: dict[str, str] = SYNC_COLUMNS, defaults: dict[str, object] | None = None) -> tuple[DataFrame, list[str]]:
    """The table with those of ``columns`` that it lacks, and their names; what is there stays as it is."""
    defaults = {"server_rev": 0, "row_rev": 0} | (defaults or {})
    added = [c for c in columns if c not in df.columns]
    return df.withColumns({c: F.lit(defaults.get(c)).cast(columns[c]) for c in added}) if added else df, added
