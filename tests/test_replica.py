import json

from ledgerloom import storage
from ledgerloom.streaming.oplog import read_outbox
from ledgerloom.streaming.replica import Replica

FIELDS = ["sr_no", "name", "price", "bid_date", "month"]
ROW = {"sr_no": 1, "name": "A", "price": 1.0, "bid_date": "05-08-2026", "month": "AUGUST_2026"}


def test_batches_make_versions_once(spark, tmp_path):
    replica = Replica(spark, storage.scratch(spark, "replica"), FIELDS)
    rows = spark.createDataFrame([("a", 1, "A", 1.0, "05-08-2026", "AUGUST_2026", None, 7)], "sync_id string, sr_no long, name string, price double, bid_date string, month string, deleted_at string, server_rev long")
    applied = spark.createDataFrame([], "id long, op_id string, sync_id string, op_type string, result string, server_rev_after long, conflict_json string, applied_at string")
    conflicts = spark.createDataFrame([], "id long, sync_id string, kind string, field_name string, status string, created_at string")
    replica.commit({"rows": rows, "applied": applied, "conflicts": conflicts}, -1)
    folder = str(tmp_path / "in")

    def deliver(*ops):
        env = lambda s, p, b: json.dumps({"sync_id": s, "payload": p, "base": b, "local_row_rev": 1})
        spark.createDataFrame([(i, o, s, "upsert", env(s, p, b), r, "pending") for i, o, s, p, b, r in ops], "id long, op_id string, sync_id string, op_type string, payload_json string, base_rev long, status string").coalesce(1).write.mode("append").parquet(folder)

    def run():
        replica.follow(read_outbox(spark, folder, spark.read.parquet(folder).schema), str(tmp_path / "check"), "now").awaitTermination()

    deliver((1, "o1", "a", ROW | {"name": "B"}, ROW, 7), (2, "o2", "n", ROW, None, 0), (3, "o1", "a", ROW | {"name": "B"}, ROW, 7))
    run()
    deliver((4, "o1", "a", ROW | {"name": "B"}, ROW, 7), (5, "o3", "a", ROW | {"name": "C"}, ROW, 7))
    run()
    run()
    state = {r["sync_id"]: (r["name"], r["server_rev"]) for r in replica.read("rows").collect()}
    assert state == {"a": ("B", 8), "n": ("A", 9)}
    assert sorted(r["op_id"] for r in replica.read("applied").collect()) == ["o1", "o2"]
    assert [(r["sync_id"], r["field_name"]) for r in replica.read("conflicts").collect()] == [("a", "name")]
    assert replica.versions() == [1, 2, 3]
    replica.apply(spark.read.parquet(folder), replica.last_batch(), "now")  # delivered again
    assert replica.versions() == [1, 2, 3]
    spark.range(1).write.parquet(f"{replica.path}/v000004/rows")  # broke off before its marker
    assert replica.versions() == [1, 2, 3] and replica.read("rows").count() == 2


def test_deltas_and_whole_versions_read_alike(spark, tmp_path):
    """Versions hold what changed; a whole one follows now and then; an invoice that another row has opens an advisory conflict."""
    fields = [*FIELDS, "invoice_no"]
    row = ROW | {"invoice_no": "I1"}
    schema = "sync_id string, server_rev long, sr_no long, name string, price double, bid_date string, month string, invoice_no string, deleted_at string, kept string"
    rows = spark.createDataFrame([("a", 1, 1, "A", 1.0, "05-08-2026", "AUGUST_2026", "I1", None, "x"), ("b", 2, 1, "A", 1.0, "05-08-2026", "AUGUST_2026", "I2", None, "y"), (None, 3, 1, "lost", 1.0, "", "", "", None, "z")], schema)
    applied = spark.createDataFrame([], "id long, op_id string, sync_id string, op_type string, result string, server_rev_after long, conflict_json string, applied_at string")
    conflicts = spark.createDataFrame([], "id long, sync_id string, kind string, field_name string, status string, created_at string")
    states = []
    for fan_in in (2, 100):
        replica = Replica(spark, storage.scratch(spark, "replica"), fields, fan_in)
        replica.commit({"rows": rows, "applied": applied, "conflicts": conflicts}, -1)
        base = row
        for n in range(3):
            new = base | {"name": f"N{n}", "invoice_no": "I2" if n == 2 else "I1"}
            ops = [(n + 1, f"o{n}", "a", "upsert", json.dumps({"payload": new, "base": base, "local_row_rev": 1}), 1, "pending")]
            replica.apply(spark.createDataFrame(ops, "id long, op_id string, sync_id string, op_type string, payload_json string, base_rev long, status string"), n, "now")
            base = new
        states.append(sorted(map(str, replica.read("rows").collect())))
        assert {r["sync_id"]: (r["name"], r["server_rev"], r["kept"]) for r in replica.read("rows").collect()} == {"a": ("N2", 6, "x"), "b": ("A", 2, "y"), None: ("lost", 3, "z")}
        assert replica.read("applied").count() == 3 and [(r["sync_id"], r["kind"]) for r in replica.read("conflicts").collect()] == [("a", "invoice_collision")]
        assert spark.read.parquet(replica._at(2, "rows")).count() == 1
    assert states[0] == states[1]
