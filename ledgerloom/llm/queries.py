"""The queries of this package over whole tables, and the SQL they can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import copies, names, packing, splitting, tokens

SALE_KEYS = ["invoice_no", "serial_no", "bid"]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies.formatting_copies(_table(spark, folder, "records"), SALE_KEYS, least=2)


def p1_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Every sale once, with the number of its copies."""
    return copies.formatting_copies(_table(spark, folder, "records"), SALE_KEYS)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.variant_pairs(names.same_buyer(_table(spark, folder, "records"), _table(spark, folder, "given_names")))


def p3_buyers(spark: SparkSession, folder: str) -> DataFrame:
    """Each record's buyer: the lowest id among that buyer's records."""
    return names.same_buyer(_table(spark, folder, "records"), _table(spark, folder, "given_names")).select("id", "buyer")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_ids(_table(spark, folder, "documents"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(tokens.token_counts(_table(spark, folder, "documents")))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.container_fill(p7_containers(spark, folder))


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_long(_table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that were split."""
    return p8_pieces(spark, folder).filter(F.col("piece") == 0).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_sales, p3_found, p3_buyers, p6_ids, p7_containers, p7_fill, p8_found, p8_pieces)}


_PLAIN = r"regexp_replace(lower(coalesce({}, '')), '[\p{{P}}\p{{Z}}\s\x0B\x1C-\x1F\x{{85}}]+', '', 'g')"
_COPIES = f"""
SELECT min(id) AS first_id, count(*) AS copies
FROM (SELECT id, list_sort([{", ".join(_PLAIN.format(c) for c in SALE_KEYS)}]) AS k FROM records)
GROUP BY k"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _COPIES + " HAVING count(*) > 1", "p1_sales": _COPIES}
