"""More of the ledger's and its replicas' queries over whole tables, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import extract as X
from ledgerloom.functions import values as V
from ledgerloom.operators import ledger as L
from ledgerloom.operators import mutations as U
from ledgerloom.operators import outbox as O
from ledgerloom.operators import replication as R
from ledgerloom.operators.merge import conflict_kind
from ledgerloom.plans.ledger_queries import _CLEAN, _LIVE, _NUMBER, _OPS, MONTH, SHARED, _dated, _norm, _strip, _sums, records
from ledgerloom.schema import EXTRACTED_LABELS, FIELD_LABELS, FINANCIAL_FIELDS, KIND_LABELS, PAGE_HEADINGS, UNMERGED_FIELDS
from ledgerloom.sources.tables import table
from ledgerloom.sources.workbook import import_counts, import_defaults

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


def online(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "records_online")


def _newest(t: str) -> str:
    return f"(SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY sync_id ORDER BY server_rev DESC NULLS LAST, id DESC) AS _n FROM {t} WHERE sync_id IS NOT NULL) WHERE _n = 1)"


_DAY = _dated("split_part(" + _strip("bid_date") + ", ' ', 1)")
_CURRENT = "OCTOBER_2026"


# Pages

_HEADS = {f: h.replace(" ", "_") for f, h in PAGE_HEADINGS.items()}


@query("SELECT id, " + ", ".join(f"split_part(coalesce(bid_date, ''), ' ', 1) AS {h}" if f == "bid_date" else f"{f} AS {h}" for f, h in _HEADS.items()) + f" FROM {_LIVE}")
def records_page(spark, folder):
    page = L.page_columns(L.live(records(spark, folder)))
    return page.select("id", *(F.col(f"`{h}`").alias(_HEADS[f]) for f, h in PAGE_HEADINGS.items()))


@query(f"SELECT id, name, (SELECT count(*) FROM {_LIVE} AND month = '{MONTH}') AS total FROM {_LIVE} AND month = '{MONTH}' ORDER BY name DESC NULLS LAST, id DESC LIMIT 20")
def page_total(spark, folder):
    return L.page_with_total(L.search(records(spark, folder), month=MONTH), "name", True, 1, 20).select("id", "name", "total")


@query(f"WITH r AS (SELECT id, invoice_no FROM {_LIVE} AND invoice_no <> '' ORDER BY id DESC LIMIT 10) SELECT * FROM r WHERE invoice_no <> (SELECT invoice_no FROM r ORDER BY id DESC LIMIT 1) ORDER BY id DESC LIMIT 5")
def suggested_invoices(spark, folder):
    newest = L.recent_invoices(records(spark, folder), 1).first()
    return L.suggested_invoices(records(spark, folder), newest["invoice_no"] if newest else "")


@query(f"WITH m AS (SELECT DISTINCT month FROM {_LIVE} AND month <> '' UNION SELECT 'JANUARY_1999'), c AS (SELECT month, {_sums(True)} FROM {_LIVE} GROUP BY month) SELECT m.month, coalesce(n, 0) AS n, coalesce(total_dp, 0) AS total_dp, coalesce(total_di, 0) AS total_di, coalesce(total_xcell, 0) AS total_xcell FROM m LEFT JOIN c USING (month)")
def month_cards(spark, folder):
    """Cards of all months there are and of one without rows."""
    months = L.available_months(records(spark, folder), "JANUARY_1999").select("month")
    return L.cards_of(months, records(spark, folder))


_AMOUNT = r"CASE WHEN regexp_matches(replace(trim(xcell), ',', ''), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN TRY_CAST(replace(trim(xcell), ',', '') AS DOUBLE) END"
_AGE = "CAST(epoch(TIMESTAMP '2026-11-01 00:00:00') - epoch(date_trunc('second', updated_at)) AS BIGINT)"


def _words(seconds: int, unit: str) -> str:
    n = f"({_AGE} // {seconds})"
    return f"{n} || ' {unit}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END || ' ago'"


@query(f"""SELECT id, coalesce(format('{{:,.2f}}', {_AMOUNT}), xcell, '') AS shown_xcell,
CASE WHEN {_AGE} < 60 THEN 'just now' WHEN {_AGE} < 3600 THEN {_words(60, 'minute')} WHEN {_AGE} < 86400 THEN {_words(3600, 'hour')} ELSE {_words(86400, 'day')} END AS age,
CASE WHEN updated_at IS NOT NULL THEN strftime(updated_at, '%Y-%m-%dT%H:%M:%S+00:00') END AS updated_utc, CAST(to_json({{'month': month, 'serial_no': serial_no, 'sr_no': sr_no}}) AS VARCHAR) AS json FROM records""")
def shown_values(spark, folder):
    """Amounts, ages and instants as shown, and rows as canonical JSON."""
    now = F.lit("2026-11-01 00:00:00").cast("timestamp")
    return records(spark, folder).select("id", V.format_amount("xcell").alias("shown_xcell"), V.age(F.col("updated_at"), now).alias("age"), V.utc_text(F.col("updated_at")).alias("updated_utc"), V.canonical_json(("sr_no", "month", "serial_no")).alias("json"))


_EXTRACTED = ("bid", "scheme", "di")


@query(" UNION ALL ".join(f"SELECT doc_id, '{EXTRACTED_LABELS[f]}' AS field, coalesce(" + (f"replace({e}, ',', '')" if f in X.WITHOUT_COMMAS else e) + ", '') AS value FROM documents" for f in _EXTRACTED for e in ["regexp_extract(text, '" + X.PATTERNS[f].replace("'", "''") + "', 1)"]))
def extracted_labels(spark, folder):
    """Fields of the documents one below the other under their labels."""
    found = X.extract_fields(table(spark, folder, "documents").select("doc_id", "text"))
    return X.extracted_labels(found, "doc_id", {f: EXTRACTED_LABELS[f] for f in _EXTRACTED})


# Changes of the ledger


@query(f"""WITH n AS (SELECT DISTINCT id, bid_date, name, sync_id FROM records_online), d AS (SELECT *, {_DAY} AS day FROM n), m AS (SELECT *, coalesce(upper(strftime(day, '%B_%Y')), '{_CURRENT}') AS month FROM d)
SELECT (SELECT max(id) FROM records) + row_number() OVER (ORDER BY id) AS id, coalesce((SELECT max(sr_no) FROM {_LIVE} AND month = m.month), 0) + row_number() OVER (PARTITION BY month ORDER BY id) AS sr_no, coalesce(strftime(day, '%d-%m-%Y'), bid_date, '') AS bid_date, month, name FROM m""")
def added_rows(spark, folder):
    """The server's rows added to the ledger as new ones."""
    old = records(spark, folder)
    new = online(spark, folder).select("id", "bid_date", "name", "sync_id").distinct().withColumnRenamed("id", "_seq")
    top = old.agg(F.max("id")).first()[0]
    return U.add(old, new, _CURRENT).filter(F.col("id") > top).select("id", "sr_no", "bid_date", "month", "name")


@query(f"SELECT id, CASE WHEN deleted_at IS NULL THEN upper(name) ELSE name END AS name, CASE WHEN deleted_at IS NULL THEN coalesce(strftime({_DAY}, '%d-%m-%Y'), bid_date, '') ELSE bid_date END AS bid_date, CASE WHEN deleted_at IS NULL THEN coalesce(upper(strftime({_DAY}, '%B_%Y')), '') ELSE month END AS month FROM records")
def updated_rows(spark, folder):
    """Every live row's name put in capitals, its date written anew."""
    old = records(spark, folder)
    return U.update(old, old.select("id", F.upper("name").alias("name"), "bid_date")).select("id", "name", "bid_date", "month")


@query(f"""WITH g AS (SELECT id FROM records WHERE coalesce(trim(invoice_no), '') = ''), l AS (SELECT r.*, g.id IS NOT NULL AS gone FROM records r LEFT JOIN g ON g.id = r.id),
t AS (SELECT DISTINCT month FROM l WHERE gone AND month <> ''), p AS (SELECT id, row_number() OVER (PARTITION BY month ORDER BY sr_no NULLS FIRST, id) AS sr FROM l WHERE NOT gone AND deleted_at IS NULL AND month IN (SELECT month FROM t))
SELECT l.id, coalesce(p.sr, sr_no) AS sr_no, CASE WHEN gone AND deleted_at IS NULL THEN '2026-11-01' ELSE deleted_at END AS deleted_at FROM l LEFT JOIN p ON p.id = l.id""")
def deleted_rows(spark, folder):
    """All rows without an invoice deleted, their months numbered anew."""
    old = records(spark, folder)
    ids = old.filter(F.coalesce(F.trim("invoice_no"), F.lit("")) == "").select("id")
    return U.delete(old, ids, "2026-11-01").select("id", "sr_no", "deleted_at")


_PAIR = f"(SELECT id, sr_no FROM {_LIVE} AND id IN (1001, 1005))"


@query(f"SELECT r.id, CASE WHEN (SELECT count(*) FROM {_PAIR}) = 2 AND r.id IN (1001, 1005) THEN (SELECT max(sr_no) FROM {_PAIR} x WHERE x.id <> r.id) ELSE r.sr_no END AS sr_no FROM records r")
def swapped_places(spark, folder):
    return U.swap_places(records(spark, folder), 1001, 1005).select("id", "sr_no")


@query(rf"SELECT count(*) FILTER ({_DAY} IS NOT NULL) AS updated, count(*) FILTER ({_DAY} IS NULL) AS skipped, count(*) FILTER ({_DAY} IS NULL) AS remaining FROM records WHERE regexp_matches(trim(bid_date), '^\d{{2}}/\d{{2}}/\d{{4}}$')")
def slash_counts(spark, folder):
    return U.slash_counts(records(spark, folder))


@query(f"""WITH s AS {_newest('records_online')}, r AS {_newest('records')} SELECT coalesce(s.sync_id, r.sync_id) AS sync_id, CASE WHEN r.sync_id IS NOT NULL AND (s.sync_id IS NULL OR coalesce(r.row_rev, 0) = coalesce(s.server_rev, 0)) THEN r.name ELSE s.name END AS name FROM s FULL JOIN r ON r.sync_id = s.sync_id""")
def upserted_rows(spark, folder):
    """The ledger's names put into the server's rows where the row's revision here is the server's."""
    mine = R.newest(records(spark, folder)).select("sync_id", "name", F.col("row_rev").alias("expected"))
    return U.upsert(R.newest(online(spark, folder)), mine, expected="expected").select("sync_id", "name")


@query("SELECT sync_id, 9000 + row_number() OVER (ORDER BY sync_id) AS server_rev FROM (SELECT DISTINCT sync_id FROM records WHERE sync_id IS NOT NULL)")
def server_revisions(spark, folder):
    """A revision for each of the ledger's rows, as if all had changed."""
    return O.server_changes(R.newest(records(spark, folder)), ["name", "price"], 9000).select("sync_id", "server_rev")


# The op queue


@query(f"""WITH s AS {_newest('records_online')}, c AS (SELECT r.sync_id, CASE WHEN s.sync_id IS NOT NULL AND r.deleted_at IS NOT NULL AND s.deleted_at IS NULL THEN 'delete' ELSE 'upsert' END AS op_type, coalesce(s.server_rev, 0) AS base_rev
FROM records r LEFT JOIN s USING (sync_id) WHERE r.sync_id IS NOT NULL AND ((s.sync_id IS NOT NULL AND r.deleted_at IS NOT NULL AND s.deleted_at IS NULL) OR (r.deleted_at IS NULL AND (s.sync_id IS NULL OR {_norm('r.name')} <> {_norm('s.name')}))))
SELECT 499 + row_number() OVER (ORDER BY sync_id, op_type) AS id, sync_id, op_type, base_rev, 'pending' AS status FROM c""")
def enqueued_ops(spark, folder):
    """The ops that would give the server the ledger's names, as outbox rows."""
    changes = O.changes_between(R.newest(online(spark, folder)), records(spark, folder), ["name"])
    return O.enqueue(changes, 500, "2026-11-01T00:00:00+00:00").select("id", "sync_id", "op_type", "base_rev", "status")


@query("SELECT o.id, coalesce(a.result, o.status) AS status, o.attempts FROM outbox o LEFT JOIN (SELECT op_id, arg_max(result, id) AS result FROM applied_ops GROUP BY op_id) a USING (op_id)")
def op_states(spark, folder):
    """The outbox with the states that the server's answers leave ops in."""
    events = table(spark, folder, "applied_ops").select("op_id", F.col("id").alias("seq"), F.col("result").alias("status"), F.lit(None).cast("string").alias("last_error"))
    return O.with_states(table(spark, folder, "outbox"), events).select("id", "status", "attempts")


@query("SELECT id, CASE WHEN status = 'in_flight' THEN 'pending' ELSE status END AS status FROM outbox")
def requeued_ops(spark, folder):
    return O.requeued(table(spark, folder, "outbox")).select("id", "status")


@query("SELECT op_id, CASE result WHEN 'applied' THEN 'applied' WHEN 'noop' THEN 'applied' WHEN 'conflict' THEN 'blocked' ELSE 'failed' END AS status FROM applied_ops")
def push_outcomes(spark, folder):
    return O.push_outcomes(table(spark, folder, "applied_ops"))


def _pushed(spark: SparkSession, folder: str) -> DataFrame:
    ops = R.decode_ops(table(spark, folder, "outbox")).filter("status = 'applied'")
    told = F.array(F.struct(F.lit("field").alias("kind"), F.lit("name").alias("field")), F.struct(F.lit("financial").alias("kind"), F.lit("price").alias("field")))
    return ops.select("id", "op_id", "sync_id", "op_type", F.lit("applied").alias("result"), F.lit("").alias("reason"), told.alias("conflicts"), F.col("base_rev").alias("server_rev_after"))


@query(f"""WITH f AS (SELECT op_id, min(id) AS o, arg_min(sync_id, id) AS sync_id, arg_min(base_rev, id) AS rev FROM {_OPS} WHERE status = 'applied' AND op_id NOT IN (SELECT op_id FROM applied_ops WHERE op_id IS NOT NULL) GROUP BY op_id)
SELECT id, op_id, sync_id, server_rev_after FROM applied_ops UNION ALL SELECT (SELECT max(id) FROM applied_ops) + row_number() OVER (ORDER BY o), op_id, sync_id, rev FROM f""")
def applied_after(spark, folder):
    """The ledger of applied ops with the results of those that the outbox calls applied."""
    return O.record_applied(table(spark, folder, "applied_ops"), _pushed(spark, folder), "2026-11-01").select("id", "op_id", "sync_id", "server_rev_after")


@query(f"""WITH f AS (SELECT id AS o, sync_id, unnest(['field', 'financial']) AS kind, unnest(['name', 'price']) AS field_name FROM {_OPS} WHERE status = 'applied')
SELECT id, sync_id, kind, field_name, status FROM conflicts UNION ALL SELECT (SELECT max(id) FROM conflicts) + row_number() OVER (ORDER BY o, field_name), sync_id, kind, field_name, 'open' FROM f""")
def conflicts_after(spark, folder):
    """The conflicts with two more for each op that the outbox calls applied."""
    return O.record_conflicts(table(spark, folder, "conflicts"), _pushed(spark, folder), "2026-11-01").select("id", "sync_id", "kind", "field_name", "status")


# Rows, revisions, orders


@query("SELECT coalesce(max(server_rev), 0) AS revision FROM records_online")
def server_revision(spark, folder):
    return R.revision(online(spark, folder))


@query(f"SELECT coalesce(min(server_rev) - 1, 5000) AS watermark FROM records_online WHERE server_rev > 5000 AND sync_id IN (SELECT sync_id FROM {_OPS} WHERE status IN ('pending', 'in_flight', 'blocked'))")
def pull_watermark(spark, folder):
    """Where the next pull begins when rows that ops wait on are skipped."""
    pulled = R.pull(online(spark, folder), 5000)
    skipped = pulled.join(R.active_ids(R.decode_ops(table(spark, folder, "outbox"))), "sync_id", "left_semi")
    return R.watermark(pulled, skipped, 5000)


@query(f"SELECT name, price, month FROM {_newest('records')} WHERE sync_id = (SELECT min(sync_id) FROM records)")
def local_row(spark, folder):
    first = records(spark, folder).agg(F.min("sync_id")).first()[0]
    return R.business_row(records(spark, folder), first).select("name", "price", "month")


_PLACES = f"""s AS {_newest('records_online')}, r AS {_newest('records')}, t AS (SELECT r.month, r.sync_id, r.id AS base, coalesce(r.sr_no, 0) AS off, coalesce(s.sr_no, 0) AS on_ FROM r JOIN s USING (sync_id) WHERE r.month <> ''),
k AS (SELECT month, row_number() OVER (PARTITION BY month ORDER BY base, sync_id) AS b, row_number() OVER (PARTITION BY month ORDER BY off, sync_id) AS f, row_number() OVER (PARTITION BY month ORDER BY on_, sync_id) AS n FROM t),
e AS (SELECT month, bool_and(f = b) AS fb, bool_and(n = b) AS nb, bool_and(f = n) AS fn FROM k GROUP BY month)"""


@query(f"WITH {_PLACES} SELECT month, CASE WHEN fb AND nb THEN 'unchanged' WHEN nb THEN 'use_offline' WHEN fb THEN 'use_online' WHEN fn THEN 'use_offline' ELSE 'conflict' END AS action FROM e")
def order_actions(spark, folder):
    """Each month's order here and on the server, against that of entry."""
    theirs = R.newest(online(spark, folder)).select("sync_id", F.coalesce("sr_no", F.lit(0)).alias("on"))
    mine = R.newest(records(spark, folder)).filter("month <> ''").select("sync_id", "month", F.col("id").alias("base"), F.coalesce("sr_no", F.lit(0)).alias("off"), F.lit(1).alias("n"))
    return R.order_actions(mine.join(theirs, "sync_id")).select("month", "action")


_MONTH_ROWS = f"(SELECT month, sync_id, id FROM {_newest('records_online')} WHERE deleted_at IS NULL AND month <> '')"


@query(f"SELECT sync_id, month, row_number() OVER (PARTITION BY month ORDER BY id) AS sr_no, 7000 + row_number() OVER (ORDER BY month, id) AS server_rev FROM {_MONTH_ROWS}")
def orders_resolved(spark, folder):
    """Every month of the server ordered as its rows came, chosen over what stands there."""
    live = R.newest(online(spark, folder)).filter("deleted_at IS NULL AND month <> ''")
    lists = live.groupBy("month").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "sync_id"))), lambda x: x["sync_id"]).alias("ids"), F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("sr_no", F.lit(0)), "sync_id"))), lambda x: x["sync_id"]).alias("now"))
    conflicts = lists.select(F.xxhash64("month").alias("id"), "month", F.lit("open").alias("status"), F.lit("sr_ordering").alias("kind"), F.to_json("ids").alias("offline_value"), F.to_json("now").alias("online_value"))
    choices = conflicts.select("id", F.lit("KEEP_OFFLINE").alias("choice"), F.lit(None).cast("string").alias("value"))
    resolution = R.order_resolution(R.order_choices(conflicts, choices), online(spark, folder))
    return O.reordered(online(spark, folder), resolution, ["name", "sr_no", "month"], 7000).select("sync_id", "month", "sr_no", "server_rev")


@query(f"SELECT m.month AS key, row_number() OVER (PARTITION BY m.month ORDER BY m.id) AS pos, m.sync_id, coalesce(nullif({_strip('r.name')}, ''), 'Unnamed record') AS label FROM {_MONTH_ROWS} m LEFT JOIN (SELECT sync_id, arg_min(name, id) AS name FROM records WHERE sync_id IS NOT NULL AND name IS NOT NULL GROUP BY 1) r USING (sync_id)")
def order_labels(spark, folder):
    """Each month's order of rows with the names that the ledger has for them."""
    live = R.newest(online(spark, folder)).filter("deleted_at IS NULL AND month <> ''")
    lists = live.groupBy(F.col("month").alias("key")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("id", "sync_id"))), lambda x: x["sync_id"])).alias("ids"))
    return O.order_view(lists, records(spark, folder).filter("name IS NOT NULL"))


# Conflicts


@query("SELECT id, sync_id, CASE field_name " + " ".join(f"WHEN '{f}' THEN '{x}'" for f, x in FIELD_LABELS.items()) + " ELSE array_to_string(list_transform(string_split(field_name, '_'), lambda x: upper(x[1]) || lower(x[2:])), ' ') END AS field_label, CASE kind " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in KIND_LABELS.items()) + " END AS kind_label, coalesce(base_value, '') AS base, coalesce(offline_value, '') AS offline, coalesce(online_value, '') AS online FROM conflicts WHERE status = 'open' AND sync_id IS NOT NULL AND kind IN ('field', 'financial', 'serial')")
def conflict_items(spark, folder):
    """Open conflicts on fields as shown."""
    return R.conflict_lists(table(spark, folder, "conflicts")).select("sync_id", F.explode("fields").alias("x")).select("x.id", "sync_id", "x.field_label", "x.kind_label", "x.base", "x.offline", "x.online")


@query(f"""WITH s AS {_newest('records_online')}, c AS (SELECT c.*, s.sync_id IS NOT NULL AS here, s.deleted_at IS NOT NULL AS gone, (lower(trim(coalesce(online_value, ''))) NOT IN ('', 'null', 'none')) AS was FROM conflicts c LEFT JOIN s USING (sync_id) WHERE c.status = 'open' AND kind = 'delete_edit')
SELECT id, sync_id, CASE WHEN NOT here THEN 'gone' WHEN gone <> was THEN 'reopened' ELSE 'applied' END AS outcome FROM c""")
def deletes_resolved(spark, folder):
    """Open conflicts of a delete with an edit, resolved for the desktop's side."""
    conflicts = table(spark, folder, "conflicts").filter("kind = 'delete_edit'")
    choices = conflicts.select("id", F.lit("KEEP_OFFLINE").alias("choice"), F.lit(None).cast("string").alias("value"))
    return R.resolve_fields(conflicts, choices, online(spark, folder)).select("id", "sync_id", "outcome")


# Imports


@query("""SELECT id, CASE WHEN sr_no IS NULL THEN n ELSE sr_no END AS sr_no, CASE WHEN coalesce(trim(invoice_no), '') = '' THEN 'IMP-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END ELSE invoice_no END AS invoice_no
FROM (SELECT id, sr_no, invoice_no, row_number() OVER (ORDER BY id) AS n FROM (SELECT DISTINCT id, sr_no, invoice_no FROM records_online))""")
def import_keys(spark, folder):
    """The server's rows as an import, with the keys they lack."""
    return import_defaults(online(spark, folder).select("id", "sr_no", "invoice_no").distinct(), "id")


@query()
def import_outcome(spark, folder):
    """How many of the server's rows an import would take; held against a sequential fold in the tests."""
    rows = online(spark, folder)
    return import_counts(rows, L.import_new(rows, records(spark, folder)))


# SQL of queries in ledger_queries that need several of its fragments


def _form(f: str, c: str) -> str:
    """A text that is the same for values that are equal by the field's class."""
    if f in FINANCIAL_FIELDS:
        n = _NUMBER.format(_CLEAN.format(c))
        return f"coalesce('#' || CAST(round({n}, 2) AS VARCHAR), {_norm(c)})"
    return f"coalesce(strftime({_dated('substr(' + _strip(c) + ', 1, 10)')}, '%Y-%m-%d'), {_norm(c)})" if f == "bid_date" else _norm(c)


def _month(c: str) -> str:
    return f"nullif(upper(strftime({_dated('substr(' + _strip(c) + ', 1, 10)')}, '%B_%Y')), '')"


_MERGED = [f for f in SHARED if f not in UNMERGED_FIELDS]
_typed = lambda f, c: f"TRY_CAST({c} AS DOUBLE)" if f in FINANCIAL_FIELDS else f"TRY_CAST({c} AS BIGINT)" if f == "sr_no" else c


def _three(rows: str) -> str:
    """Rows with b_, o_ and n_ columns of the shared fields, with the action of each merged one."""
    forms = ", ".join(f"{_form(f, s + '_' + f)} AS {s}c_{f}" for f in _MERGED for s in "bon")
    acts = ", ".join(f"CASE WHEN bc_{f} = oc_{f} AND bc_{f} = nc_{f} THEN 'unchanged' WHEN bc_{f} = nc_{f} THEN 'use_offline' WHEN bc_{f} = oc_{f} THEN 'use_online' WHEN oc_{f} = nc_{f} THEN 'converged' ELSE 'conflict' END AS a_{f}" for f in _MERGED)
    return f"(SELECT *, {acts} FROM (SELECT *, {forms} FROM {rows}))"


_JSON = lambda j, f: _typed(f, f"({j} ->> '{f}')")
_CONFLICTS = " + ".join(f"CAST(a_{f} = 'conflict' AS INTEGER)" for f in _MERGED)
_KEPT = {f: f"CASE WHEN a_{f} IN ('use_offline', 'converged') THEN o_{f} WHEN a_{f} = 'use_online' THEN n_{f} WHEN a_{f} = 'unchanged' THEN b_{f} END" for f in _MERGED}
_T = f"""ops AS (SELECT sync_id, arg_max(payload_json, id) AS j FROM {_OPS} WHERE op_type = 'upsert' AND json_type(payload_json -> '$.base') = 'OBJECT' GROUP BY sync_id), srv AS {_newest('records_online')},
t AS (SELECT ops.sync_id, {', '.join(f"{_JSON('j -> ' + repr('$.base'), f)} AS b_{f}, {_JSON('j -> ' + repr('$.payload'), f)} AS o_{f}, srv.{f} AS n_{f}" for f in SHARED)} FROM ops JOIN srv USING (sync_id)), a AS {_three('t')}"""
_sql["merge_actions"] = f"WITH {_T} SELECT sync_id, {', '.join(f'a_{f} AS {f}_action' for f in _MERGED)} FROM a"
_sql["merge_conflicts"] = f"WITH {_T} " + " UNION ALL ".join(f"SELECT sync_id, '{f}' AS field, '{conflict_kind(f)}' AS kind FROM a WHERE a_{f} = 'conflict'" for f in _MERGED)
_sql["local_changes"] = f"""WITH s AS {_newest('records_online')}, c AS (SELECT r.sync_id, s.sync_id IS NOT NULL AS here, r.deleted_at IS NOT NULL AS gone, s.deleted_at IS NOT NULL AS was, {' OR '.join(f"{_form(f, 'r.' + f)} <> {_form(f, 's.' + f)}" for f in SHARED)} AS differs FROM records r LEFT JOIN s USING (sync_id) WHERE r.sync_id IS NOT NULL)
SELECT sync_id, CASE WHEN here AND gone AND NOT was THEN 'delete' ELSE 'upsert' END AS op_type FROM c WHERE (here AND gone AND NOT was) OR (NOT gone AND (NOT here OR differs))"""
_sql["merge_resolved"] = f"""WITH {_T}, r AS (SELECT *, {', '.join(f'{x} AS r_{f}' for f, x in _KEPT.items())} FROM a)
SELECT sync_id, {', '.join(f'r_{f} AS {f}' for f in _MERGED)}, o_sr_no AS sr_no, coalesce({_month('r_bid_date')}, nullif(o_month, ''), nullif(n_month, ''), nullif(b_month, '')) AS month, {_CONFLICTS} AS n_conflicts FROM r"""
_sql["pulled_merge"] = f"""WITH srv AS {_newest('(SELECT * FROM records_online WHERE server_rev > 0)')}, t AS (SELECT srv.sync_id, srv.server_rev, r.sync_id IS NOT NULL AS here, {', '.join(f"CASE WHEN r.base_json IS NULL THEN r.{f} ELSE {_JSON('r.base_json', f)} END AS b_{f}, r.{f} AS o_{f}, srv.{f} AS n_{f}" for f in SHARED)}
FROM srv LEFT JOIN records r ON r.sync_id = srv.sync_id WHERE srv.sync_id NOT IN (SELECT sync_id FROM {_OPS} WHERE status IN ('pending', 'in_flight', 'blocked'))), a AS {_three('t')}
SELECT sync_id, server_rev, CASE WHEN NOT here THEN 'insert' WHEN {_CONFLICTS} > 0 THEN 'attention' ELSE 'update' END AS action, {_CONFLICTS} AS n_conflicts FROM a"""
_NOW = "CASE field_name " + " ".join(f"WHEN '{f}' THEN CAST(s.{f} AS VARCHAR)" for f in SHARED) + " END"
_SAME = f"CASE WHEN field_name IN {FINANCIAL_FIELDS} THEN {_form('price', 'now_')} = {_form('price', 'online_value')} WHEN field_name = 'bid_date' THEN {_form('bid_date', 'now_')} = {_form('bid_date', 'online_value')} ELSE {_norm('now_')} = {_norm('online_value')} END"
_DEAD = "(lower(trim(coalesce({0}, ''))) NOT IN ('', 'null', 'none'))"
_sql["resolve_conflicts"] = f"""WITH s AS {_newest('records_online')}, c AS (SELECT c.*, s.sync_id IS NOT NULL AS here, s.deleted_at IS NOT NULL AS gone, {_NOW} AS now_ FROM conflicts c LEFT JOIN s USING (sync_id) WHERE c.status = 'open'),
d AS (SELECT *, CASE WHEN kind = 'delete_edit' THEN CASE WHEN NOT here THEN 'gone' WHEN gone <> {_DEAD.format('online_value')} THEN 'reopened' ELSE 'applied' END
 WHEN kind NOT IN ('field', 'financial', 'serial') OR field_name NOT IN {SHARED} THEN 'invalid' WHEN NOT here THEN 'gone' WHEN NOT ({_SAME}) THEN 'reopened' ELSE 'applied' END AS outcome FROM c)
SELECT id, sync_id, field_name, outcome, CASE WHEN outcome = 'applied' AND (kind <> 'delete_edit' OR {_DEAD.format('offline_value')}) THEN offline_value END AS value FROM d"""
_ROWMONTH = lambda j: f"coalesce({_month('(' + j + ' ->> ' + repr('bid_date') + ')')}, nullif({j} ->> 'month', ''))"
_PAY, _BASE = "(payload_json -> '$.payload')", "(payload_json -> '$.base')"
_MOVES = f"(SELECT *, {_ROWMONTH(_PAY)} AS m, TRY_CAST({_PAY} ->> 'sr_no' AS BIGINT) AS off_sr, TRY_CAST({_BASE} ->> 'sr_no' AS BIGINT) AS base_sr FROM {_OPS} WHERE op_type = 'upsert' AND json_type({_BASE}) = 'OBJECT')"
_PLAN = f"""mv AS (SELECT * FROM {_MOVES} WHERE off_sr IS DISTINCT FROM base_sr AND m = {_ROWMONTH(_BASE)}), md AS (SELECT sync_id, arg_max(m, id) AS m, arg_max_null(off_sr, id) AS off, arg_min_null(base_sr, id) AS base, count(*) AS n FROM mv GROUP BY sync_id),
lv AS (SELECT sync_id, month, coalesce(sr_no, 0) AS on_ FROM {_newest('records_online')} WHERE deleted_at IS NULL AND month IN (SELECT m FROM md)), th AS (SELECT sync_id, month, n, on_, coalesce(base, on_) AS base, coalesce(off, on_) AS off FROM lv LEFT JOIN md USING (sync_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY base, sync_id) AS b, row_number() OVER (PARTITION BY month ORDER BY off, sync_id) AS f, row_number() OVER (PARTITION BY month ORDER BY on_, sync_id) AS o FROM th),
pl AS (SELECT month, CASE WHEN bool_and(f = b) AND bool_and(o = b) THEN 'unchanged' WHEN bool_and(o = b) THEN 'use_offline' WHEN bool_and(f = b) THEN 'use_online' WHEN bool_and(f = o) THEN 'use_offline' ELSE 'conflict' END AS action, coalesce(sum(n), 0) AS ops FROM rk GROUP BY month)"""
_sql["ordering_plan"] = f"WITH {_PLAN} SELECT month, action, CAST(ops AS BIGINT) AS ops FROM pl"


def _applied() -> str:
    """States before each op by windows over whole rows, then the first condition that holds."""
    cmp = [f for f in SHARED if f != "month"]
    sides = ", ".join(f"{_form(f, f'({j} ->> {f!r})')} AS {s}_{f}" for f in cmp for s, j in (("o", _PAY), ("b", _BASE)))
    based = " OR ".join(f"({_BASE} ->> '{f}') IS NOT NULL" for f in SHARED)
    any_of = lambda form: "(" + " OR ".join(form.format(f=f) for f in cmp) + ")"
    clash = lambda f: f"(b_{f} <> o_{f} AND b_{f} <> c_{f} AND o_{f} <> c_{f})"
    w = "OVER (PARTITION BY sync_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    month = lambda c: f"({_norm('b_month')} <> {_norm(c)})"
    return f"""WITH o AS (SELECT id, op_id, sync_id, op_type, {sides}, ({_PAY} ->> 'month') AS o_month, ({_BASE} ->> 'month') AS b_month, ({_PAY} ->> 'deleted_at') AS o_gone, ({_BASE} ->> 'deleted_at') AS b_gone, coalesce(json_type({_BASE}) = 'OBJECT', false) AS has_base,
 op_type = 'upsert' AND NOT (coalesce(base_rev, 0) <> 0 AND ({based})) AS makes FROM {_OPS}),
l AS (SELECT o.*, a.result AS stored, a.rev AS stored_rev, a.result IS NULL AND coalesce(o.op_id, '') <> '' AND op_type IN ('upsert', 'delete') AS live FROM o LEFT JOIN (SELECT op_id, arg_min(result, id) AS result, arg_min(server_rev_after, id) AS rev FROM applied_ops GROUP BY op_id) a USING (op_id)),
s AS (SELECT sync_id, month, deleted_at, {', '.join(f'{_form(f, f)} AS c_{f}' for f in cmp)} FROM {_newest('records_online')}),
bn AS (SELECT sync_id, min(id) AS born FROM (SELECT sync_id, id FROM l WHERE live AND makes UNION ALL SELECT sync_id, -1 FROM s) GROUP BY 1),
r AS (SELECT l.*, coalesce(born < id, false) AS there, live AND (coalesce(born < id, false) OR makes) AS finds FROM l LEFT JOIN bn USING (sync_id)),
ro AS (SELECT r.*, f.first, CASE WHEN stored IS NOT NULL THEN 'stored' WHEN coalesce(r.op_id, '') = '' THEN 'nameless' WHEN id = f.first THEN 'takes' WHEN id > f.first THEN 'again' WHEN op_type NOT IN ('upsert', 'delete') THEN 'unknown' ELSE 'early' END AS role
 FROM r LEFT JOIN (SELECT op_id, sync_id, min(id) AS first FROM r WHERE finds GROUP BY ALL) f ON f.op_id = r.op_id AND f.sync_id = r.sync_id),
st AS (SELECT *, {', '.join(f"CASE WHEN role = 'takes' AND op_type = 'upsert' AND (NOT there OR o_{f} <> b_{f}) THEN o_{f} END AS set_{f}" for f in cmp)}, role = 'takes' AND there AND (op_type = 'delete' OR o_gone IS NOT NULL) AS dies, false AS holds, CAST(NULL AS VARCHAR) AS own_month FROM ro
 UNION ALL BY NAME SELECT sync_id, -1 AS id, {', '.join(f'c_{f} AS set_{f}' for f in cmp)}, deleted_at IS NOT NULL AS dies, false AS holds, month AS own_month FROM s WHERE sync_id IN (SELECT sync_id FROM ro)
 UNION ALL BY NAME SELECT DISTINCT sync_id, -2 AS id, true AS holds FROM conflicts WHERE status = 'open' AND kind <> 'invoice_collision' AND sync_id IN (SELECT sync_id FROM ro)),
sc AS (SELECT *, {', '.join(f'last_value(set_{f} IGNORE NULLS) {w} AS c_{f}' for f in cmp)}, last_value(CASE WHEN dies THEN true END IGNORE NULLS) {w} AS gone, last_value(CASE WHEN holds THEN true END IGNORE NULLS) {w} AS held FROM st),
sm AS (SELECT *, coalesce(own_month, CASE WHEN role = 'takes' AND op_type = 'upsert' THEN coalesce({_month("CASE WHEN there THEN coalesce(set_bid_date, c_bid_date) ELSE o_bid_date END")}, nullif(o_month, '')) END) AS set_month FROM sc),
s2 AS (SELECT *, last_value(set_month IGNORE NULLS) {w} AS c_month FROM sm), {_PLAN},
v AS (SELECT *, CASE WHEN id < 0 THEN NULL WHEN role = 'stored' THEN stored || '|replayed' WHEN role = 'nameless' THEN 'error|op without id' WHEN role = 'unknown' THEN 'error|unknown op_type' WHEN role = 'again' THEN 'again|' WHEN held THEN 'conflict|open conflict'
 WHEN role = 'early' AND op_type = 'delete' THEN 'error|delete of an unknown row' WHEN role = 'early' THEN 'error|new row with a base' WHEN id IN (SELECT mv.id FROM mv JOIN pl ON pl.month = mv.m WHERE pl.action = 'conflict') THEN 'conflict|month order'
 WHEN op_type = 'delete' AND gone THEN 'noop|already deleted' WHEN op_type = 'delete' AND has_base AND ({any_of('b_{f} <> c_{f}')} OR {month('c_month')}) THEN 'conflict|' WHEN op_type = 'delete' OR NOT there THEN 'applied|'
 WHEN {' OR '.join(clash(f) for f in _MERGED)} THEN 'conflict|' WHEN gone AND o_gone IS NULL AND ({any_of('b_{f} <> o_{f}')} OR {month('o_month')}) THEN 'conflict|' WHEN b_gone IS NOT NULL AND NOT (o_gone IS NOT NULL AND coalesce(gone, false)) THEN 'conflict|'
 WHEN {clash('invoice_no')} OR {clash('sr_no')} THEN 'conflict|' ELSE 'applied|' END AS told FROM s2),
h AS (SELECT *, coalesce(last_value(CASE WHEN told LIKE 'conflict|%' THEN true END IGNORE NULLS) {w}, false) AS stop FROM v),
t AS (SELECT id, op_id, sync_id, role, first, stored_rev, stop, CASE WHEN stop AND role IN ('takes', 'early') THEN 'conflict|open conflict' ELSE told END AS told FROM h WHERE id >= 0),
e AS (SELECT t.*, x.told AS was, CASE WHEN t.role <> 'again' THEN t.told WHEN x.told = 'applied|' THEN 'applied|replayed' WHEN t.stop OR x.told LIKE 'conflict|%' THEN 'conflict|open conflict' ELSE 'noop|already deleted' END AS out FROM t LEFT JOIN t x ON t.role = 'again' AND x.id = t.first AND x.role = 'takes'),
n AS (SELECT id, 1000000 + row_number() OVER (ORDER BY id) AS rev FROM e WHERE role = 'takes' AND out = 'applied|')
SELECT e.id, op_id, sync_id, split_part(out, '|', 1) AS result, split_part(out, '|', 2) AS reason, CASE WHEN out LIKE 'applied|%' THEN coalesce(stored_rev, n.rev) END AS server_rev_after FROM e LEFT JOIN n ON n.id = CASE WHEN out = 'applied|replayed' THEN coalesce(first, e.id) ELSE e.id END"""


_sql["apply_outbox"] = _applied()
