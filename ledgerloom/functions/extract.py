"""Fields of a delivery order's text by patterns, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The labels that delivery orders carry.
PATTERNS = {
    "name": r"(?is)loan\s*application\s*of\s*Mr/Miss/Mrs\.\s*(.*?)\s*(?:has|been)",
    "price": r"(?i)Product\s*Price:?\s*([\d,]+(?:\.\d+)?)",
    "mobile": r"Mobile\s*Number\s*:\s*(\d+)",
    "bid": r"DO\s*ID\s*:\s*([A-Z0-9]+)",
    "bid_date": r"Date\s*:\s*(\d{2}/\d{2}/\d{4})",
    "emi": r"Total\s*EMI.*?([\d,]+)",
    "di": r"Net\s*Disbursement.*?([\d,]+)",
    "scheme": r"\((\d+/\d+)\)",
}
WITHOUT_COMMAS = ("emi", "di")
ADDRESS_LABEL, ADDRESS_END = r"(?i)(?:Address of the customer for delivery|Delivery Address)\s*:", "On the delivery of the product"


def field(text: Column, name: str) -> Column:
    found = F.coalesce(F.regexp_extract(text, PATTERNS[name], 1), F.lit(""))
    return F.regexp_replace(found, ",", "") if name in WITHOUT_COMMAS else found


def product(text: Column) -> Column:
    """Lines between the first "Model" and the first "EAN Number", without quotes and commas, joined by dashes."""
    start, end = F.locate("Model", text), F.locate("EAN Number", text)
    between = F.regexp_replace(F.substring(text, start + 5, F.greatest(end - start - 5, F.lit(0))), '[",]', "")
    lines = F.filter(F.transform(F.split(between, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.when((start > 0) & (end > start), F.upper(F.array_join(lines, " - "))).otherwise("")


def address(text: Column) -> Column:
    """After the last address label (case aside), up to the closing words or a near mobile number; white space collapsed."""
    parts = F.split(text, ADDRESS_LABEL)
    after = F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("")
    end = F.locate(ADDRESS_END, after)
    part = F.when(end > 0, F.substring(after, F.lit(1), end - 1)).otherwise(after)
    mobile = F.locate("mobile number:", F.translate(part, "MOBILENUR", "mobilenur"))
    part = F.when((mobile > 0) & (mobile <= 500), F.substring(part, F.lit(1), mobile - 1)).otherwise(part)
    return F.coalesce(F.trim(F.regexp_replace(part, r"\s+", " ")), F.lit(""))


def extract_fields(texts: DataFrame, text: str = "text") -> DataFrame:
    """The table with the fields found in each text, blank where there is none. A null text has none."""
    t = F.col(text)
    return texts.withColumns({n: field(t, n) for n in PATTERNS} | {"product": product(t), "address": address(t)})


def extracted_labels(fields: DataFrame, key: str, labels: dict[str, str]) -> DataFrame:
    """``(key, field, value)``: extracted fields one below the other under their labels, blank for null."""
    shown = fields.select(key, *(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(label) for f, label in labels.items()))
    return shown.unpivot([key], list(labels.values()), "field", "value")


def missing_fields(*names: str) -> Column:
    """Those of the named fields that are blank."""
    return F.filter(F.array(*(F.when(F.trim(F.coalesce(F.col(n).cast("string"), F.lit(""))) == "", F.lit(n)) for n in names)), lambda x: x.isNotNull())
