"""The queries on records' copies, timestamps and changes over whole tables, with SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import storage
from ledgerloom.operators import changelog, table_diff, timestamps
from ledgerloom.schema import FIELD_TYPES
from ledgerloom.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    fields = {"server_rev": F.col("server_rev"), "invoice_no": table_diff.text_form(F.col("invoice_no")), "price": table_diff.cents_form(F.col("price"))}
    return table_diff.table_diff(table(spark, folder, "records"), table(spark, folder, "records_online"), "sync_id", fields, ["server_rev", "row_rev"], ("records", "online"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The dictionary stays for as long as the application runs: a later call parses only texts not met before."""
    dictionary = timestamps.TimestampDictionary(spark, storage.kept(spark, "timestamps"))
    return timestamps.normalise(table(spark, folder, "records"), table(spark, folder, "counters"), {"bid_date": "day", "created_at": "instant"}, dictionary)


#: Deliveries arrive in so many batches by id, each a run; so many runs of a level are compacted.
BATCHES, FAN_IN = 3, 2


def _replayed(spark: SparkSession, folder: str) -> DataFrame:
    """The outbox as it arrived (all at once where no ids tell), batch after batch: runs appended, compacted as they pile up,
    the rest merged on read."""
    log, outbox = changelog.ChangeLog(spark, storage.scratch(spark, "changes"), FAN_IN), table(spark, folder, "outbox")
    low, high = outbox.agg(F.min("id"), F.max("id")).first() if "id" in outbox.columns else (None, None)
    batches = [outbox]
    if low is not None:
        step = (high - low) // BATCHES + 1
        bounds = [F.col("id").between(low + n * step, low + (n + 1) * step - 1) for n in range(BATCHES)]
        batches = [outbox.filter(b | F.col("id").isNull() if n == 0 else b) for n, b in enumerate(bounds)]
    for b in batches:
        log.append(changelog.outbox_changes(b))
        log.compact()
    return log.read()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _replayed(spark, folder).select(F.col("key").alias("sync_id"), "value.op_id")


def _rebuilt(spark: SparkSession, folder: str, fields: Iterable[str]) -> DataFrame:
    ddl = ", ".join(f"{f} {FIELD_TYPES[f]}" for f in fields)
    return _replayed(spark, folder).select(F.col("key").alias("sync_id"), F.from_json("value.payload", ddl).alias("p")).select("sync_id", "p.*")


def p5_state(spark: SparkSession, folder: str) -> DataFrame:
    """Eight of each sync_id's final business fields; p5_rows has them all."""
    return _rebuilt(spark, folder, ("sr_no", "bid_date", "invoice_no", "name", "price", "bid", "phone", "month"))


def p5_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows themselves: all of each sync_id's final business fields."""
    return _rebuilt(spark, folder, FIELD_TYPES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p4_found, p5_found, p5_state, p5_rows)}


_INVOICE = r"lower(regexp_replace(invoice_no, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))"
_CHANGES = """
WITH ops AS (
  SELECT sync_id, op_id, lower(trim(op_type)) = 'delete' AS gone, payload_json, base_rev,
         CAST(payload_json ->> '$.local_row_rev' AS BIGINT) AS local_row_rev
  FROM outbox
  WHERE sync_id IS NOT NULL AND CASE WHEN json_valid(payload_json) THEN json_type(payload_json) = 'OBJECT' ELSE false END
), last AS (
  SELECT *, row_number() OVER (PARTITION BY sync_id ORDER BY base_rev DESC, local_row_rev DESC, op_id DESC) AS n FROM ops
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""
WITH a AS (SELECT DISTINCT sync_id, server_rev, {_INVOICE} AS invoice_no, round(price, 2) AS price FROM records WHERE sync_id IS NOT NULL),
b AS (SELECT DISTINCT sync_id, server_rev, {_INVOICE} AS invoice_no, round(price, 2) AS price FROM records_online WHERE sync_id IS NOT NULL),
j AS (SELECT a.*, b.server_rev AS r2, b.invoice_no AS i2, b.price AS p2 FROM a JOIN b ON a.sync_id = b.sync_id)
SELECT sync_id, 'only_records' AS diff FROM a WHERE sync_id NOT IN (SELECT sync_id FROM b)
UNION ALL SELECT sync_id, 'only_online' FROM b WHERE sync_id NOT IN (SELECT sync_id FROM a)
UNION ALL SELECT sync_id, 'server_rev' FROM j WHERE server_rev IS DISTINCT FROM r2
UNION ALL SELECT sync_id, 'invoice_no' FROM j WHERE invoice_no IS DISTINCT FROM i2
UNION ALL SELECT sync_id, 'price' FROM j WHERE price IS DISTINCT FROM p2""",
        "p5_found": _CHANGES + "SELECT sync_id, op_id FROM last WHERE n = 1 AND NOT gone",
        "p5_state": _CHANGES
        + """SELECT sync_id, CAST(payload_json ->> '$.payload.sr_no' AS BIGINT) AS sr_no, payload_json ->> '$.payload.bid_date' AS bid_date,
 payload_json ->> '$.payload.invoice_no' AS invoice_no, payload_json ->> '$.payload.name' AS name, CAST(payload_json ->> '$.payload.price' AS DOUBLE) AS price,
 payload_json ->> '$.payload.bid' AS bid, payload_json ->> '$.payload.phone' AS phone, payload_json ->> '$.payload.month' AS month
FROM last WHERE n = 1 AND NOT gone""",
        "p5_rows": _CHANGES
        + "SELECT sync_id, "
        + ", ".join(f"CAST(payload_json ->> '$.payload.{f}' AS {t}) AS {f}" for f, t in FIELD_TYPES.items()).replace("AS string)", "AS VARCHAR)")
        + " FROM last WHERE n = 1 AND NOT gone",
    }
