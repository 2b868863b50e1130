"""The ledger's queries over the whole tables, each with the SQL it is held against.

Parameters (month, clock, words searched) are constants here and arguments of the operators.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import extract as X
from ledgerloom.functions import values as V
from ledgerloom.operators import ledger as L
from ledgerloom.operators import merge as M
from ledgerloom.operators import mutations as U
from ledgerloom.operators import outbox as O
from ledgerloom.operators import replication as R
from ledgerloom.schema import FIELD_TYPES, UNMERGED_FIELDS
from ledgerloom.sources.sinks import insert_statements
from ledgerloom.sources.tables import table
from ledgerloom.streaming.oplog import event_windows

MONTH, AS_OF, CODE, WORD = "AUGUST_2025", date(2025, 8, 15), "2508", "pro"
SHARED = ("bid_date", "name", "product", "serial_no", "price", "emi", "di", "bid", "phone", "invoice_no", "sr_no", "month")

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def note(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return note


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "records")


# SQL fragments

_STRIP = r"regexp_replace(CAST({0} AS VARCHAR), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _strip(c: str) -> str:
    return _STRIP.format(c)


def _dated(t: str) -> str:
    day, iso = r"^(\d{1,2})[-](\d{1,2})[-](\d{4})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    slash = day.replace("[-]", "[/]")

    def built(p: str, y: int, d: int) -> str:
        g = lambda i: f"regexp_extract({t}, '{p}', {i})"
        return f"TRY_CAST({g(y)} || '-' || lpad({g(2)}, 2, '0') || '-' || lpad({g(d)}, 2, '0') AS DATE)"

    return f"CASE WHEN regexp_matches({t}, '{day}') THEN {built(day, 3, 1)} WHEN regexp_matches({t}, '{slash}') THEN {built(slash, 3, 1)} WHEN regexp_matches({t}, '{iso}') THEN {built(iso, 1, 3)} END"


def _date(c: str) -> str:
    return _dated(f"split_part({_strip(c)}, ' ', 1)")


_NORM = r"upper(trim(regexp_replace(coalesce(CAST({0} AS VARCHAR), ''), '[\s\p{{Z}}]+', ' ', 'g')))"
_CLEAN = r"regexp_replace(replace(coalesce(CAST({0} AS VARCHAR), ''), ',', ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_NUMBER = r"CASE WHEN regexp_matches({0}, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN TRY_CAST({0} AS DOUBLE) END"
_MONEY = "CAST(sum(TRY_CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"
_PREFIX = r"coalesce(TRY_CAST(regexp_extract(replace(xcell, ',', ''), '^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1) AS DOUBLE), 0)"
_XCELL = f"CAST(sum(CASE WHEN xcell IS NOT NULL THEN TRY_CAST({_PREFIX} AS DECIMAL(18,2)) END) AS DOUBLE)"
_LIVE = "records WHERE deleted_at IS NULL"
_POSITIONAL = "substr(bid_date, 7, 4) || '-' || substr(bid_date, 4, 2) || '-' || substr(bid_date, 1, 2)"
_MONTH_START = "TRY_CAST(try_strptime(CASE WHEN regexp_matches({0}, '^[A-Za-z]+_[0-9]{{4}}$') THEN {0} END, '%B_%Y') AS DATE)"
_OBJECT = "CASE WHEN json_valid(payload_json) THEN json_type(payload_json) = 'OBJECT' ELSE false END"
_OPS = f"(SELECT id, op_id, sync_id, lower(regexp_replace(op_type, '[\\s\\p{{Z}}]+', '', 'g')) AS op_type, base_rev, status, payload_json FROM outbox WHERE sync_id IS NOT NULL AND {_OBJECT})"


def _norm(c: str) -> str:
    return _NORM.format(c)


def _sums(blank: bool) -> str:
    x = f"coalesce({_XCELL}, 0)" if blank else _XCELL
    return f"count(*) AS n, coalesce({_MONEY.format('dp_taken')}, 0) AS total_dp, coalesce({_MONEY.format('di')}, 0) AS total_di, {x} AS total_xcell"


# Rows and predicates


@query(f"SELECT id, sr_no, invoice_no, name, price FROM {_LIVE}")
def live_rows(spark, folder):
    return L.newest_first(records(spark, folder)).select("id", "sr_no", "invoice_no", "name", "price")


@query("SELECT id, name, deleted_at FROM records WHERE id = 1001")
def record_by_id(spark, folder):
    return L.by_id(records(spark, folder), 1001).select("id", "name", "deleted_at")


@query(f"SELECT id, sr_no, name FROM {_LIVE} AND month = '{MONTH}'")
def month_rows(spark, folder):
    return L.month_rows(records(spark, folder), MONTH).select("id", "sr_no", "name")


@query(f"SELECT id, name, phone, invoice_no, product, emi, bid_date, scheme FROM {_LIVE} AND scheme LIKE '%/%' AND bid_date <> ''")
def scheme_candidates(spark, folder):
    return L.scheme_candidates(records(spark, folder))


@query(r"SELECT id, bid_date FROM records WHERE regexp_matches(trim(bid_date), '^\d{2}/\d{2}/\d{4}$')")
def slash_dates(spark, folder):
    return L.slash_dated(records(spark, folder))


@query(f"SELECT count(*) AS n FROM {_LIVE}")
def record_count(spark, folder):
    return L.live(records(spark, folder)).agg(F.count("*").alias("n"))


_SEARCH = "(" + " OR ".join(f"lower({c}) LIKE '%{WORD}%'" for c in L.SEARCHED) + ")"


@query(f"SELECT count(*) AS n FROM {_LIVE} AND {_SEARCH} AND month = '{MONTH}'")
def search_count(spark, folder):
    return L.search(records(spark, folder), WORD, month=MONTH).agg(F.count("*").alias("n"))


@query(f"SELECT id, invoice_no, name, bid_date FROM {_LIVE} AND {_SEARCH} ORDER BY {_POSITIONAL} DESC NULLS LAST, sr_no DESC NULLS LAST, id DESC LIMIT 50 OFFSET 50")
def search_page(spark, folder):
    return L.page(L.search(records(spark, folder), WORD), "bid_date", True, 2, 50).select("id", "invoice_no", "name", "bid_date")


@query(f"SELECT id, name, phone FROM {_LIVE} AND lower(name) LIKE '%mohan%' AND (phone LIKE '%52%' OR alt_phone LIKE '%52%')")
def name_and_phone(spark, folder):
    return L.search(records(spark, folder), name="mohan", phone="52").select("id", "name", "phone")


@query(f"SELECT id, bid_date FROM {_LIVE} AND {_POSITIONAL} >= '2025-08-01' AND {_POSITIONAL} <= '2025-08-31'")
def date_window(spark, folder):
    return L.search(records(spark, folder), date_from="01-08-2025", date_to="31-08-2025").select("id", "bid_date")


@query("SELECT id, name, server_rev, deleted_at FROM records_online WHERE server_rev > 5000")
def pull_since(spark, folder):
    return R.pull(table(spark, folder, "records_online"), 5000).select("id", "name", "server_rev", "deleted_at")


@query(f"""SELECT id, op_id, sync_id, op_type, payload_json ->> '$.payload.name' AS name, CAST(payload_json ->> '$.payload.price' AS DOUBLE) AS price, CAST(payload_json ->> '$.local_row_rev' AS BIGINT) AS local_row_rev
FROM {_OPS} WHERE status IN ('pending', 'failed')""")
def outbox_rows(spark, folder):
    ops = R.decode_ops(table(spark, folder, "outbox")).filter(F.col("status").isin("pending", "failed"))
    return ops.select("id", "op_id", "sync_id", "op_type", F.col("payload.name").alias("name"), F.col("payload.price").alias("price"), "local_row_rev")


@query("SELECT id, sync_id, kind, field_name FROM conflicts WHERE status = 'open'")
def open_conflicts(spark, folder):
    return R.open_conflicts(table(spark, folder, "conflicts")).select("id", "sync_id", "kind", "field_name")


# Statistics


@query(f"SELECT count(*) AS n, coalesce({_MONEY.format('dp_taken')}, 0) AS total_dp, coalesce({_MONEY.format('di')}, 0) AS total_di FROM {_LIVE} AND bid_date IN ('15-08-2025', '15/08/2025', '2025-08-15')")
def today_stats(spark, folder):
    return L.today_stats(records(spark, folder), AS_OF)


@query(f"SELECT {_sums(False)} FROM {_LIVE}")
def dashboard_totals(spark, folder):
    return L.totals(records(spark, folder))


@query(f"SELECT {_sums(False)} FROM {_LIVE} AND month = 'NO_SUCH'")
def dashboard_totals_empty(spark, folder):
    return L.totals(records(spark, folder), "NO_SUCH")


@query(f"SELECT month, {_sums(True)} FROM {_LIVE} GROUP BY month")
def monthly_cards(spark, folder):
    return L.monthly_cards(records(spark, folder))


@query(f"SELECT month, count(*) AS n FROM {_LIVE} GROUP BY month")
def monthly_counts(spark, folder):
    return L.monthly_counts(records(spark, folder))


@query(f"SELECT bid_date, count(*) AS n FROM {_LIVE} AND month = '{MONTH}' AND bid_date <> '' GROUP BY bid_date")
def daily_counts(spark, folder):
    return L.daily_counts(records(spark, folder), MONTH)


_DAILY = f"SELECT coalesce(strftime({_date('bid_date')}, '%d-%m-%Y'), bid_date) AS day, count(*) AS n FROM {_LIVE} AND month = '{MONTH}' AND bid_date <> '' GROUP BY 1"


@query(_DAILY)
def daily_counts_normalised(spark, folder):
    return L.daily_counts_normalised(records(spark, folder), MONTH)


@query(f"SELECT strftime(d, '%d-%m-%Y') AS day, coalesce(n, 0) AS n FROM generate_series(DATE '2025-08-01', DATE '2025-08-31', INTERVAL 1 DAY) AS s(d) LEFT JOIN ({_DAILY}) x ON x.day = strftime(d, '%d-%m-%Y')")
def daily_calendar(spark, folder):
    return L.daily_calendar(records(spark, folder), MONTH)


@query(f"SELECT DISTINCT month FROM {_LIVE} AND month <> '' UNION SELECT 'OCTOBER_2026' AS month")
def available_months(spark, folder):
    return L.available_months(records(spark, folder), "OCTOBER_2026")


@query(f"SELECT month, {_sums(True)} FROM {_LIVE} AND month <> '' GROUP BY month ORDER BY coalesce({_MONTH_START.format('month')}, DATE '9999-12-31') DESC, month DESC LIMIT 4")
def latest_cards(spark, folder):
    return L.latest_cards(records(spark, folder))


@query(f"SELECT DISTINCT month, coalesce(strftime({_MONTH_START.format('month')}, '%b %Y'), '') AS label FROM {_LIVE} AND {_MONTH_START.format('month')} IS NOT NULL")
def month_labels(spark, folder):
    return L.live(records(spark, folder)).filter(V.month_start("month").isNotNull()).select("month", V.month_label("month").alias("label")).distinct()


@query("SELECT count(*) AS n, max(id) AS max_id, CAST(max(updated_at) AS VARCHAR)[:19] AS max_updated FROM records")
def fingerprint(spark, folder):
    return L.fingerprint(records(spark, folder)).withColumn("max_updated", F.date_format("max_updated", "yyyy-MM-dd HH:mm:ss"))


_COLUMNS = {f: "bigint" for f in ("id", "sr_no", "server_rev", "row_rev")} | {f: "double" for f in ("price", "emi", "di", "dp_taken", "given_prod_price")} | {"updated_at": "timestamp"}
_ALL = "id sr_no bid_date invoice_no name xcell product serial_no price emi di bid dp_taken scheme actual_product given_prod_price phone alt_phone month created_at updated_at remarks sync_id server_rev row_rev base_json deleted_at counter_id".split()


def _row_text(columns) -> str:
    kinds = {"double": "CASE WHEN isnan({0}) THEN 'NaN' ELSE coalesce(CAST(TRY_CAST({0} AS DECIMAL(28,6)) AS VARCHAR), CAST({0} AS VARCHAR)) END", "timestamp": "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"}
    return " || chr(31) || ".join(f"coalesce('=' || CAST({kinds.get(_COLUMNS.get(c), '{0}').format(c)} AS VARCHAR), '-')" for c in columns)


@query(f"SELECT count(*) AS n, bit_xor(h) AS hash_xor, CAST(sum(h) AS VARCHAR) AS hash_sum FROM (SELECT CAST('0x' || substr(md5({_row_text(_ALL)}), 1, 15) AS BIGINT) AS h FROM records)")
def table_checksum(spark, folder):
    return L.checksum(records(spark, folder).select(*_ALL)).withColumn("hash_sum", F.col("hash_sum").cast("string"))


# Numbering and duplicates

_COUNTED = "regexp_matches(invoice_no, '^[0-9]{4}[0-9]+$')"


@query(f"SELECT coalesce(max(substr(invoice_no, 1, 4)), '') AS code FROM {_LIVE} AND {_COUNTED}")
def latest_invoice_code(spark, folder):
    return L.latest_invoice_code(records(spark, folder))


@query(f"SELECT coalesce(max(TRY_CAST(substr(invoice_no, 5) AS BIGINT)), 0) AS counter FROM {_LIVE} AND {_COUNTED} AND invoice_no LIKE '{CODE}%'")
def max_invoice_counter(spark, folder):
    return L.max_invoice_counter(records(spark, folder), CODE)


@query(f"SELECT substr(invoice_no, 1, 4) AS code, max(TRY_CAST(substr(invoice_no, 5) AS BIGINT)) AS counter FROM {_LIVE} AND {_COUNTED} GROUP BY 1")
def invoice_counters(spark, folder):
    return L.invoice_counters(records(spark, folder))


@query(f"SELECT month, coalesce(max(sr_no), 0) + 1 AS next_sr FROM {_LIVE} GROUP BY month")
def next_sr_no(spark, folder):
    return L.next_sr_no(records(spark, folder))


_RENUMBER = f"SELECT id, sync_id, month, sr_no, row_number() OVER (PARTITION BY month ORDER BY sr_no NULLS FIRST, id) AS new_sr FROM {_LIVE} AND month <> ''"


@query(f"SELECT * FROM ({_RENUMBER}) WHERE sr_no IS DISTINCT FROM new_sr")
def renumber(spark, folder):
    return L.renumbered(records(spark, folder))


@query(f"""WITH r AS (SELECT id, month, sr_no FROM {_LIVE} AND month <> ''), place AS (SELECT month, sr_no, max(id) AS other FROM r GROUP BY ALL)
SELECT r.id, r.month, r.sr_no, u.other AS above, d.other AS below FROM r LEFT JOIN place u ON u.month = r.month AND u.sr_no = r.sr_no - 1 LEFT JOIN place d ON d.month = r.month AND d.sr_no = r.sr_no + 1""")
def month_neighbours(spark, folder):
    return L.neighbours(records(spark, folder))


@query(f"SELECT id, sr_no FROM {_LIVE} AND month = '{MONTH}' AND sr_no = 3 ORDER BY id DESC LIMIT 1")
def row_at_place(spark, folder):
    return L.at_place(records(spark, folder), MONTH, 3).select("id", "sr_no")


@query(f"SELECT id, invoice_no FROM {_LIVE} AND invoice_no <> '' ORDER BY id DESC LIMIT 20")
def recent_invoices(spark, folder):
    return L.recent_invoices(records(spark, folder), 20)


@query(f"SELECT id, invoice_no FROM {_LIVE} ORDER BY id DESC LIMIT 1")
def last_invoice(spark, folder):
    return L.last_invoice(records(spark, folder))


@query(f"SELECT coalesce(bool_or(lower(invoice_no) = '25083526'), false) AS taken FROM {_LIVE}")
def duplicate_invoice(spark, folder):
    return L.taken(records(spark, folder), "invoice_no", " 25083526 ")


@query(f"SELECT coalesce(bool_or(lower(serial_no) = 'sn4qu5nvq'), false) AS taken FROM {_LIVE}")
def duplicate_serial(spark, folder):
    return L.taken(records(spark, folder), "serial_no", "SN4QU5NVQ")


_OWNERS = f"SELECT {_norm('invoice_no')} AS invoice, count(DISTINCT sync_id) AS owners, min(sync_id) AS first_owner FROM records WHERE sync_id IS NOT NULL AND {_norm('invoice_no')} <> '' GROUP BY 1"


@query(_OWNERS)
def invoice_owners(spark, folder):
    return L.invoice_owners(records(spark, folder))


@query(f"SELECT DISTINCT r.sync_id, o.invoice, o.owners - 1 AS others FROM records r JOIN ({_OWNERS}) o ON {_norm('r.invoice_no')} = o.invoice WHERE o.owners > 1 AND r.sync_id IS NOT NULL")
def invoice_collisions(spark, folder):
    return L.invoice_collisions(records(spark, folder))


@query()
def import_new(spark, folder):
    """The server's rows as an import into the ledger; held against a sequential fold in the tests."""
    return L.import_new(table(spark, folder, "records_online"), records(spark, folder)).select("id", "invoice_no", "serial_no")


# Derivations


@query(f"SELECT id, coalesce(strftime({_date('bid_date')}, '%d-%m-%Y'), bid_date, '') AS day, coalesce(upper(strftime({_dated('substr(' + _strip('bid_date') + ', 1, 10)')}, '%B_%Y')), '') AS month_key FROM records")
def normalised_dates(spark, folder):
    return records(spark, folder).select("id", V.normalise_date("bid_date").alias("day"), V.month_of("bid_date").alias("month_key"))


@query(rf"""SELECT id, {_CLEAN.format('xcell')} AS clean, coalesce({_NUMBER.format(_CLEAN.format('xcell'))}, 0) AS amount, CASE WHEN xcell IS NOT NULL THEN {_PREFIX} END AS prefix, {_norm('name')} AS norm_name,
coalesce(phone, '') AS shown, regexp_replace(invoice_no, '[^A-Za-z0-9_-]+', '_', 'g') AS file_name, coalesce(TRY_CAST(regexp_extract(coalesce(invoice_no, ''), '([0-9]+)\n?$', 1) AS DECIMAL(38,0)), 0)::VARCHAR AS last_number,
CASE WHEN lower(trim(deleted_at)) NOT IN ('', 'null', 'none') THEN deleted_at END AS deleted,
CASE WHEN length(split_part(scheme, '/', 1)) > 0 AND len(string_split(scheme, '/')) = 2 THEN TRY_CAST(CASE WHEN regexp_matches(trim(split_part(scheme, '/', 1)), '^[+-]?[0-9]+$') THEN trim(split_part(scheme, '/', 1)) END AS INTEGER) END AS total_parts
FROM records""")
def scalar_functions(spark, folder):
    parts = F.split("scheme", "/")
    first = F.trim(F.get(parts, F.lit(0)))
    return records(spark, folder).select(
        "id", V.clean_amount("xcell").alias("clean"), V.amount("xcell").alias("amount"), V.numeric_prefix("xcell").alias("prefix"), V.norm_text("name").alias("norm_name"), V.display("phone").alias("shown"),
        V.safe_name("invoice_no").alias("file_name"), V.trailing_number("invoice_no").cast("string").alias("last_number"), V.as_deleted("deleted_at").alias("deleted"),
        F.when((F.size(parts) == 2) & first.rlike(r"^[+-]?[0-9]+$"), first.try_cast("int")).alias("total_parts"),
    )


_XF = {n: p.replace("'", "''") for n, p in X.PATTERNS.items()}


@query("SELECT doc_id, " + ", ".join((f"replace({e}, ',', '')" if n in X.WITHOUT_COMMAS else e) + f" AS {n}" for n, p in _XF.items() for e in [f"coalesce(regexp_extract(text, '{p}', 1), '')"]) + " FROM documents")
def extract_fields(spark, folder):
    docs = X.extract_fields(table(spark, folder, "documents"))
    return docs.select("doc_id", *X.PATTERNS)


_PRODUCT = r"""CASE WHEN strpos(text, 'Model') > 0 AND strpos(text, 'EAN Number') > strpos(text, 'Model') THEN
 upper(array_to_string(list_filter(list_transform(string_split(regexp_replace(substr(text, strpos(text, 'Model') + 5, greatest(strpos(text, 'EAN Number') - strpos(text, 'Model') - 5, 0)), '[",]', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' - ')) ELSE '' END"""
_AFTER = r"CASE WHEN len(regexp_split_to_array(text, '(?i)(?:Address of the customer for delivery|Delivery Address)\s*:')) > 1 THEN regexp_split_to_array(text, '(?i)(?:Address of the customer for delivery|Delivery Address)\s*:')[-1] ELSE '' END"


_MISSING = "concat_ws(',', " + ", ".join(f"CASE WHEN trim(coalesce(regexp_extract(text, '{_XF[n]}', 1), '')) = '' THEN '{n}' END" for n in ("name", "price", "mobile")) + ")"


@query(rf"""WITH a AS (SELECT doc_id, {_PRODUCT} AS product, {_AFTER} AS after FROM documents), b AS (SELECT doc_id, product, CASE WHEN strpos(after, 'On the delivery of the product') > 0 THEN substr(after, 1, strpos(after, 'On the delivery of the product') - 1) ELSE after END AS part FROM a),
c AS (SELECT doc_id, product, CASE WHEN strpos(lower(part), 'mobile number:') BETWEEN 1 AND 500 THEN substr(part, 1, strpos(lower(part), 'mobile number:') - 1) ELSE part END AS part FROM b)
SELECT doc_id, product, coalesce(trim(regexp_replace(part, '\s+', ' ', 'g')), '') AS address, {_MISSING} AS missing FROM c JOIN documents USING (doc_id)""")
def extract_blocks(spark, folder):
    """Products and addresses of the documents, and which fields they lack."""
    found = X.extract_fields(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "product", "address", F.array_join(X.missing_fields("name", "price", "mobile"), ",").alias("missing"))


_ROW_DATE = f"({_date('bid_date')})"


@query(f"""SELECT id, strftime(d, '%d-%m-%Y') AS bid_date, upper(strftime(d, '%B_%Y')) AS month FROM (SELECT id, bid_date, month, {_ROW_DATE} AS d FROM records)
WHERE d IS NOT NULL AND (regexp_matches({_strip('bid_date')}, '^[0-9]{{4}}-') OR month IS DISTINCT FROM upper(strftime(d, '%B_%Y')))""")
def migrate_dates(spark, folder):
    return U.migrate_dates(records(spark, folder))


@query(rf"SELECT id, strftime(d, '%d-%m-%Y') AS bid_date, upper(strftime(d, '%B_%Y')) AS month FROM (SELECT id, bid_date AS b, {_ROW_DATE} AS d FROM records) WHERE d IS NOT NULL AND regexp_matches(trim(b), '^\d{{2}}/\d{{2}}/\d{{4}}$')")
def migrate_slashes(spark, folder):
    return U.migrate_slashes(records(spark, folder))


@query(f"""SELECT id, coalesce(upper(strftime(d, '%B_%Y')), 'UNKNOWN') AS sheet, row_number() OVER (PARTITION BY coalesce(upper(strftime(d, '%B_%Y')), 'UNKNOWN') ORDER BY coalesce(d, DATE '0001-01-01'), coalesce(TRY_CAST(regexp_extract(coalesce(invoice_no, ''), '([0-9]+)\n?$', 1) AS DECIMAL(38,0)), 0), id) AS sr
FROM (SELECT id, invoice_no, {_ROW_DATE} AS d FROM {_LIVE})""")
def export_rows(spark, folder):
    return L.workbook_rows(records(spark, folder)).select("id", "sheet", "sr")


_WIDE = tuple(f for f, t in FIELD_TYPES.items() if t == "string")


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, least(greatest(coalesce(max(length({c})), 0) + 2, 12), 45) AS width FROM {_LIVE}" for c in _WIDE))
def export_widths(spark, folder):
    return L.column_widths(records(spark, folder), _WIDE)


_DUMPED = [c for c in _ALL if c != "updated_at"]


def _literal(c: str) -> str:
    text = f"CAST({c} AS VARCHAR)" if c in _COLUMNS else f"'''' || replace({c}, '''', '''''') || ''''"
    return f"coalesce({text}, 'NULL')"


@query(f"SELECT 'INSERT INTO records ({', '.join(_DUMPED)}) VALUES (' || " + " || ', ' || ".join(map(_literal, _DUMPED)) + " || ');' AS value FROM records")
def sql_dump(spark, folder):
    return insert_statements(records(spark, folder).select(*_DUMPED), "records")


# Replication


@query("SELECT status, count(*) AS n FROM outbox GROUP BY status")
def outbox_status_counts(spark, folder):
    return R.status_counts(table(spark, folder, "outbox"))


@query(f"""WITH w AS (SELECT * FROM {_OPS} WHERE status IN ('pending', 'in_flight') AND op_type = 'upsert')
SELECT sync_id, arg_max(op_id, id) AS op_id, arg_max(payload_json ->> '$.payload.name', id) AS name, arg_min(base_rev, id) AS base_rev, count(*) - 1 AS superseded FROM w GROUP BY sync_id""")
def op_coalesce(spark, folder):
    return R.coalesce_ops(R.decode_ops(table(spark, folder, "outbox"))).select("sync_id", "op_id", F.col("payload.name").alias("name"), "base_rev", "superseded")


@query("SELECT o.id, o.op_id, a.result, a.server_rev_after FROM outbox o JOIN (SELECT op_id, arg_min(result, id) AS result, arg_min(server_rev_after, id) AS server_rev_after FROM applied_ops GROUP BY op_id) a USING (op_id)")
def replayed_ops(spark, folder):
    applied = table(spark, folder, "applied_ops").groupBy("op_id").agg(F.min_by("result", "id").alias("result"), F.min_by("server_rev_after", "id").alias("server_rev_after"))
    return table(spark, folder, "outbox").select("id", "op_id").join(applied, "op_id")


@query("SELECT DISTINCT r.sync_id FROM records_online r WHERE r.server_rev > 5000 AND r.sync_id IS NOT NULL AND r.sync_id NOT IN (SELECT sync_id FROM " + _OPS + " WHERE status IN ('pending', 'in_flight', 'blocked'))")
def pull_without_active(spark, folder):
    ops = R.decode_ops(table(spark, folder, "outbox"))
    return R.pull(table(spark, folder, "records_online"), 5000).filter("sync_id IS NOT NULL").select("sync_id").distinct().join(R.active_ids(ops), "sync_id", "left_anti")


def _triples(spark: SparkSession, folder: str) -> DataFrame:
    """Each row's newest upsert with its base, beside the server's row."""
    ops = R.decode_ops(table(spark, folder, "outbox")).filter("op_type = 'upsert' AND base IS NOT NULL")
    last = ops.groupBy("sync_id").agg(F.max_by("payload", "id").alias("offline"), F.max_by("base", "id").alias("base"))
    server = table(spark, folder, "records_online").filter("sync_id IS NOT NULL").groupBy("sync_id").agg(F.max_by(F.struct(*SHARED), F.struct("server_rev", "id")).alias("online"))
    return last.join(server, "sync_id")


_MERGED = tuple(f for f in SHARED if f not in UNMERGED_FIELDS)


@query()
def merge_actions(spark, folder):
    merged = M.merge_rows(_triples(spark, folder), SHARED)
    return merged.select("sync_id", *(F.col("actions")[f].alias(f"{f}_action") for f in _MERGED))


@query()
def merge_resolved(spark, folder):
    """Merged rows and their conflicts; held against a plain merge of each row in the tests."""
    return M.merge_rows(_triples(spark, folder), SHARED).select("sync_id", "resolved.*", F.size("conflicts").alias("n_conflicts"))


@query()
def merge_conflicts(spark, folder):
    found = M.merge_rows(_triples(spark, folder), SHARED).select("sync_id", F.explode("conflicts").alias("c"))
    return found.select("sync_id", "c.field", "c.kind")


_ALIVE = "SELECT r.sync_id, r.base_json IS NOT NULL AND r.phone IS NOT NULL AS b, r.deleted_at IS NULL AS f, o.deleted_at IS NULL AS n FROM records r JOIN (SELECT sync_id, min(deleted_at) AS deleted_at FROM records_online WHERE sync_id IS NOT NULL GROUP BY sync_id) o USING (sync_id)"


@query(f"SELECT sync_id, CASE WHEN NOT b AND NOT f AND NOT n OR b AND f AND n THEN 'unchanged' WHEN NOT b THEN 'conflict' ELSE 'apply' END AS action, CASE WHEN NOT b AND NOT f AND NOT n THEN 'both_deleted' WHEN NOT b THEN 'resurrect' WHEN f AND n THEN 'alive' WHEN NOT f AND NOT n THEN 'both' WHEN NOT f THEN 'offline' ELSE 'online' END AS why FROM ({_ALIVE})")
def tombstones(spark, folder):
    """Who of the two has deleted rows; those that have a state agreed on and a number stand for rows alive then."""
    online = table(spark, folder, "records_online").filter("sync_id IS NOT NULL").groupBy("sync_id").agg(F.min("deleted_at").alias("od"))
    both = records(spark, folder).select("sync_id", "deleted_at", (F.col("base_json").isNotNull() & F.col("phone").isNotNull()).alias("b")).join(online, "sync_id")
    return both.select("sync_id", M.tombstone_action(F.col("b"), F.col("deleted_at").isNull(), F.col("od").isNull()).alias("t")).select("sync_id", "t.*")


@query()
def pulled_merge(spark, folder):
    """Pulled rows merged into the ledger; held against the rules on a fixture in the tests."""
    ops = R.decode_ops(table(spark, folder, "outbox"))
    pulled = R.newest(table(spark, folder, "records_online").filter("server_rev > 0"))
    return R.merge_pulled(pulled, records(spark, folder), ops, SHARED).select("sync_id", "server_rev", "action", F.size("conflicts").alias("n_conflicts"))


@query()
def apply_outbox(spark, folder):
    """Every op of the outbox applied to the server's rows, in order; held against a sequential fold in the tests."""
    ops = R.decode_ops(table(spark, folder, "outbox"))
    results, _ = R.apply_ops(ops, table(spark, folder, "records_online").filter("sync_id IS NOT NULL"), table(spark, folder, "applied_ops"), table(spark, folder, "conflicts"), SHARED, "2026-11-01T00:00:00+00:00", 1_000_000)
    return results.select("id", "op_id", "sync_id", "result", "reason", "server_rev_after")


@query()
def ordering_plan(spark, folder):
    """What to do with each month's order; held against lists compared on a fixture in the tests."""
    return R.ordering_plan(R.decode_ops(table(spark, folder, "outbox")), table(spark, folder, "records_online"))


@query(f"""SELECT o.id, o.op_id, o.sync_id, o.base_rev, s.r AS server_rev FROM {_OPS} o JOIN (SELECT sync_id, max(server_rev) AS r FROM records_online WHERE sync_id IS NOT NULL GROUP BY 1) s USING (sync_id)
WHERE o.status = 'blocked' AND s.r > o.base_rev AND o.sync_id NOT IN (SELECT sync_id FROM conflicts WHERE status = 'open')""")
def retired_ops(spark, folder):
    return R.retired(R.decode_ops(table(spark, folder, "outbox")), table(spark, folder, "records_online"), table(spark, folder, "conflicts"))


@query(f"""SELECT c.sync_id, count(*) AS n, count(*) FILTER (kind IN ('field', 'financial', 'serial')) AS field_conflicts, count(*) FILTER (kind = 'sr_ordering') AS sr_ordering_conflicts,
count(*) FILTER (kind = 'invoice_collision') AS invoice_collision_conflicts, count(*) FILTER (kind = 'delete_edit') AS delete_edit_conflicts, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, arg_min(c.created_at, c.id) AS created_at,
any_value(coalesce(nullif({_strip('r.name')}, ''), 'Unnamed record')) AS label, any_value(coalesce(nullif({_strip('r.invoice_no')}, ''), nullif({_strip('r.phone')}, ''), '')) AS detail
FROM conflicts c LEFT JOIN records r USING (sync_id) WHERE c.status = 'open' GROUP BY c.sync_id""")
def conflict_views(spark, folder):
    return R.conflict_views(table(spark, folder, "conflicts"), records(spark, folder))


@query()
def resolve_conflicts(spark, folder):
    """All open conflicts resolved for the desktop's value; held against the rules on a fixture in the tests."""
    conflicts = table(spark, folder, "conflicts")
    choices = conflicts.filter("status = 'open'").select("id", F.lit("KEEP_OFFLINE").alias("choice"), F.lit(None).cast("string").alias("value"))
    return R.resolve_fields(conflicts, choices, table(spark, folder, "records_online"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(TRY_CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def event_hours(spark, folder):
    """An addition: events by the hour."""
    hours = event_windows(table(spark, folder, "events").withColumn("value", F.col("value").try_cast("decimal(18,4)")))
    return hours.withColumn("total", F.col("total").cast("double"))


@query("SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'in_flight') AS in_flight, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'blocked') AS blocked, (SELECT count(*) FROM conflicts WHERE status = 'open') AS open_conflicts FROM outbox")
def sync_status(spark, folder):
    return O.sync_status(table(spark, folder, "outbox"), table(spark, folder, "conflicts"))


@query("SELECT id, op_id, (row_number() OVER (ORDER BY id) - 1) // 50 AS batch FROM outbox WHERE status = 'pending'")
def push_batches(spark, folder):
    return O.push_batches(table(spark, folder, "outbox")).select("id", "op_id", "batch")


@query()
def local_changes(spark, folder):
    """The ops that would make the ledger of the server's rows."""
    return O.changes_between(R.newest(table(spark, folder, "records_online")), records(spark, folder), list(SHARED)).select("sync_id", "op_type")
