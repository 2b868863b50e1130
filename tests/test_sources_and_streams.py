import json
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom import storage
from ledgerloom.operators.changelog import ChangeLog
from ledgerloom.schema import ensure_columns
from ledgerloom.sources import sinks, sqlite, workbook
from ledgerloom.streaming import oplog


def test_workbook_round_trip(spark, tmp_path):
    rows = [(1, "05-08-2026", "260802", "A & <B>", "P", None), (2, "05-08-2026", "260801", "C", "P", None), (3, "odd", None, None, "P", None), (4, "01-05-2024", "1", "x", "P", "deleted")]
    records = spark.createDataFrame(rows, "id long, bid_date string, invoice_no string, name string, product string, deleted_at string")
    path = str(tmp_path / "out.xlsx")
    sinks.export_workbook(records, path)
    workbook.register(spark)
    read = lambda **o: spark.read.format("workbook").options(columns="id,invoice,name,product,date,sr", **o).load(path).collect()
    assert [(r["id"], r["name"], r["sr"]) for r in read(sheet="AUGUST_2026")] == [("2", "C", "1"), ("1", "A & <B>", "2")]
    assert [r["id"] for r in read()] == ["3"]  # the first sheet: rows without a date
    sinks.export_months(records, str(tmp_path / "months"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "months")).groupBy("sheet").count().count() == 2


def test_import_rows(spark):
    rows = spark.createDataFrame([("a", "1,000"), ("b", "x"), ("c", None)], "name string, price string")
    assert [tuple(r) for r in workbook.import_rows(rows).orderBy("name").collect()] == [("a", 1000.0), ("c", 0.0)]


def test_sqlite_files(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE records (id INTEGER PRIMARY KEY, name TEXT, price REAL)")
        c.execute("CREATE TABLE empty_one (a TEXT)")
        c.executemany("INSERT INTO records VALUES (?, ?, ?)", [(i * 3, f"n{i}" if i % 2 else None, i / 2) for i in range(101)])
    sqlite.register(spark)
    df = spark.read.format("sqlite_file").option("table", "records").load(path)
    assert df.count() == 101 and df.agg(F.sum("price")).first()[0] == sum(i / 2 for i in range(101)) and df.filter("name IS NULL").count() == 51
    assert spark.read.format("sqlite_file").option("table", "empty_one").load(path).count() == 0


def test_snapshots_backup_settings(spark, tmp_path):
    s = sinks.Snapshots(spark, f"file://{tmp_path}/snap")
    df = spark.createDataFrame([(1, "o'x", None), (2, None, 1.5)], "id long, name string, price double")
    assert s.commit(df) == 1 and s.commit(df.filter("id = 1"), expected=1) == 2
    with pytest.raises(ValueError, match="newest"):
        s.commit(df, expected=1)
    assert s.read().count() == 1 and s.restore(1) == 3 and s.read().count() == 2
    sinks.backup(df, f"{tmp_path}/b", "t")
    assert {r[0] for r in spark.read.text(f"{tmp_path}/b/sql").collect()} == {"INSERT INTO t (id, name, price) VALUES (1, 'o''x', NULL);", "INSERT INTO t (id, name, price) VALUES (2, NULL, 1.5);"}
    (tmp_path / "s.json").write_text('{"a": 1}')
    assert sinks.settings(str(tmp_path / "s.json"), {"a": 0, "b": 2}) == {"a": 1, "b": 2} and sinks.settings("/nowhere", {"a": 0}) == {"a": 0}
    sinks.append_log(spark, f"{tmp_path}/log", "EDIT", "row 1", datetime(2026, 1, 1))
    assert spark.read.text(f"{tmp_path}/log").first()[0] == "[EDIT] 2026-01-01T00:00:00: row 1"


def test_added_columns(spark):
    df, added = ensure_columns(spark.createDataFrame([(1, "x")], "id long, sync_id string"))
    assert added == ["server_rev", "row_rev", "base_json", "deleted_at"] and df.first()["server_rev"] == 0 and ensure_columns(df)[1] == []


def _deliver(spark, folder, n, rows):
    schema = "id long, op_id string, sync_id string, op_type string, payload_json string, base_rev long, status string, created_at string"
    spark.createDataFrame([(i, o, s, t, json.dumps({"local_row_rev": r, "payload": {}}), b, "pending", f"2026-01-0{n}T00:00:00+00:00") for i, o, s, t, r, b in rows], schema).coalesce(1).write.mode("append").parquet(folder)
    return schema


def test_stream_follows_restarts_and_skips_done_batches(spark, tmp_path):
    folder, check = str(tmp_path / "in"), str(tmp_path / "check")
    log = ChangeLog(spark, storage.scratch(spark, "log"), fan_in=2)
    schema = _deliver(spark, folder, 1, [(1, "o1", "a", "upsert", 1, 1), (2, "o2", "b", "upsert", 1, 1)])
    start = lambda: oplog.follow(oplog.read_outbox(spark, folder, spark.read.parquet(folder).schema, 1), log, check).awaitTermination()
    start()
    _deliver(spark, folder, 2, [(3, "o3", "a", "delete", 2, 1), (1, "o1", "a", "upsert", 1, 1)])
    start()
    _deliver(spark, folder, 3, [(4, "o4", "c", "upsert", 1, 1)])
    start()
    start()
    assert schema and {r["key"] for r in log.read().collect()} == {"b", "c"}
    counts = oplog.op_counts(oplog.read_outbox(spark, folder, spark.read.parquet(folder).schema))
    q = counts.writeStream.format("memory").queryName("ops").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert q.exception() is None


def test_event_windows(spark):
    events = spark.createDataFrame([(datetime(2024, 1, 1, 0, m), "t", 1.0) for m in (0, 10, 59)] + [(datetime(2024, 1, 1, 1, 0), "t", 2.0)], "ts timestamp, event_type string, value double")
    assert sorted((r["n"], r["total"]) for r in oplog.event_windows(events).collect()) == [(1, 2.0), (3, 3.0)]


def test_backups_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "it's", 1.5, "I/1"), (2, None, None, ""), (2, None, None, "")], "id long, name string, price double, invoice_no string")
    manifest = sinks.backup(df, f"{tmp_path}/b", "t")
    assert (manifest["rows"], manifest["statements"], manifest["verified"]) == (3, 3, True)
    assert json.loads((tmp_path / "b" / "manifest.json").read_text()) == manifest
    sinks.backup_invoices(df, f"{tmp_path}/i")
    assert sorted(p.name for p in (tmp_path / "i").glob("invoice=*")) == ["invoice=I_1", "invoice=none"]


def test_results_are_kept_until_their_table_changes(spark):
    from ledgerloom import storage
    from ledgerloom.operators.cache import VersionedCache

    built = []

    def build(t):
        built.append(1)
        return t.groupBy().count()

    cache = VersionedCache(spark, storage.scratch(spark, "cache"))
    table = lambda n: spark.range(n).selectExpr("id", "timestamp '2026-01-01' AS updated_at")
    assert [cache.get("n", table(n), build).first()[0] for n in (3, 3, 4, 3)] == [3, 3, 4, 3] and len(built) == 3
    cache.forget()
    assert cache.get("n", table(3), build).first()[0] == 3 and len(built) == 4


def test_imports_without_keys(spark):
    from ledgerloom.sources.workbook import import_counts, import_defaults

    rows = spark.createDataFrame([(5, None, " "), (7, 9, "I7"), (6, None, None)], "id long, sr_no long, invoice_no string")
    keyed = import_defaults(rows, "id")
    assert [(r["id"], r["sr_no"], r["invoice_no"]) for r in keyed.orderBy("id").collect()] == [(5, 1, "IMP-001"), (6, 2, "IMP-002"), (7, 9, "I7")]
    assert tuple(import_counts(rows, keyed.limit(1)).first()) == (1, 2)
