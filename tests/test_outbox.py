import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import outbox as O
from ledgerloom.operators import replication as R

FIELDS = ["sr_no", "name", "price", "bid_date", "month"]
SCHEMA = "sync_id string, sr_no long, name string, price double, bid_date string, month string, deleted_at string, server_rev long"


def rows(spark, *r):
    return spark.createDataFrame([(s, 1, n, p, "05-08-2026", "AUGUST_2026", d, rev) for s, n, p, d, rev in r], SCHEMA)


@pytest.fixture
def queue(spark):
    before = rows(spark, ("a", "A", 1.0, None, 5), ("b", "B", 1.0, None, 6), ("c", "C", 1.0, None, 7), ("d", "D", 1.0, "t0", 8), (None, "N", 1.0, None, 0))
    after = rows(spark, ("a", " a ", 1.001, None, 5), ("b", "B", 2.0, None, 6), ("c", "C", 1.0, "t1", 7), ("d", "D", 1.0, "t0", 8), ("e", "E", 1.0, None, 0), (None, "N2", 1.0, None, 0))
    return O.enqueue(O.changes_between(before, after, FIELDS), 11, "2026-01-01T00:00:00+00:00")


def test_ops_from_changes_read_back(queue):
    ops = {r["sync_id"]: r for r in R.decode_ops(queue).collect()}
    assert {k: (v["id"], v["op_type"], v["base_rev"]) for k, v in ops.items()} == {"b": (11, "upsert", 6), "c": (12, "delete", 7), "e": (13, "upsert", 0)}
    assert ops["b"]["payload"]["price"] == 2.0 and ops["b"]["base"]["price"] == 1.0 and ops["e"]["base"] is None and ops["c"]["payload"]["deleted_at"] == "t1"
    text = queue.filter("sync_id = 'e'").first()["payload_json"]
    assert "deleted_at" in json.loads(text)["payload"] and json.loads(text)["base"] is None


def test_rows_without_identity_are_refused(spark):
    with pytest.raises(Exception, match="without sync_id"):
        O.server_changes(rows(spark, (None, "A", 1.0, None, 1)), FIELDS, 1).collect()


def test_states_batches_outcomes(queue, spark):
    events = spark.createDataFrame([(r["op_id"], s, st, e) for r in queue.collect() for s, st, e in ((1, "failed", "x"), (2, "in_flight", None)) if r["sync_id"] == "b"], "op_id string, seq int, status string, last_error string")
    now = O.with_states(queue, events)
    b = now.filter("sync_id = 'b'").first()
    assert (b["status"], b["attempts"], b["last_error"]) == ("in_flight", 1, None) and now.filter("status = 'pending'").count() == 2
    assert O.requeued(now).filter("status = 'pending'").count() == 3
    assert [(r["id"], r["batch"]) for r in O.push_batches(queue, 2).orderBy("id").collect()] == [(11, 0), (12, 0), (13, 1)]
    results = spark.createDataFrame([("1", "applied"), ("2", "noop"), ("3", "conflict"), ("4", "error")], "op_id string, result string")
    assert [r["status"] for r in O.push_outcomes(results).orderBy("op_id").collect()] == ["applied", "applied", "blocked", "failed"]
    assert tuple(O.sync_status(now, spark.createDataFrame([("open",), ("resolved",)], "status string")).first()) == (2, 1, 0, 0, 1)


def test_ledgers_grow_once(spark):
    schema = "id long, op_id string, sync_id string, op_type string, result string, reason string, conflicts array<struct<kind: string, field: string>>, server_rev_after long"
    results = spark.createDataFrame([(5, "o5", "a", "upsert", "applied", "", [], 9), (3, "o3", "a", "upsert", "conflict", "", [("field", "name"), ("financial", "price")], None), (4, "o4", "a", "upsert", "applied", "replayed", [], 2), (6, "o6", "b", "delete", "noop", "", [], None)], schema)
    applied = spark.createDataFrame([(7, "o4", "a", "upsert", "applied", 2, None, "t")], "id long, op_id string, sync_id string, op_type string, result string, server_rev_after long, conflict_json string, applied_at string")
    once = O.record_applied(applied, results, "now")
    assert {(r["id"], r["op_id"]) for r in once.collect()} == {(7, "o4"), (8, "o5")} and O.record_applied(once, results, "now").count() == 2
    conflicts = spark.createDataFrame([(2, "x", "field", "name", "open", "t")], "id long, sync_id string, kind string, field_name string, status string, created_at string")
    assert {(r["id"], r["kind"], r["field_name"]) for r in O.record_conflicts(conflicts, results, "now").collect()} == {(2, "field", "name"), (3, "field", "name"), (4, "financial", "price")}


def test_settling_and_convergence(spark):
    server = rows(spark, ("a", "A", 1.0, None, 5), ("b", "B", 1.0, "t", 6))
    resolved = spark.createDataFrame([("a", "price", "applied", "7.5"), ("a", "bid_date", "applied", "01-05-2024"), ("b", "name", "reopened", None)], "sync_id string, field_name string, outcome string, value string")
    out = O.settled(server, resolved, FIELDS, 100).collect()
    assert [(r["sync_id"], r["price"], r["month"], r["server_rev"], r["row_rev"]) for r in out] == [("a", 7.5, "MAY_2024", 101, 0)] and json.loads(out[0]["base_json"])["price"] == 7.5
    base = json.dumps({"sr_no": 1, "name": "A", "price": 1.0, "bid_date": "05-08-2026", "month": "AUGUST_2026"})
    local = rows(spark, ("a", "mine", 9.0, None, 1), ("b", "mine", 1.0, None, 1), ("w", "mine", 1.0, None, 1)).withColumn("base_json", F.lit(base))
    remote = rows(spark, ("a", "A", 7.5, None, 8), ("b", "A", 1.0, "t", 9), ("w", "A", 1.0, None, 9))
    got = {r["sync_id"]: (r["row"]["name"], r["row"]["price"]) for r in O.converged(local, remote, spark.createDataFrame([("w",)], "sync_id string"), FIELDS).collect()}
    assert got == {"a": ("mine", 7.5), "b": ("A", 1.0)}


def test_order_view(spark):
    records = spark.createDataFrame([(1, "s1", "One"), (2, "s2", " ")], "id long, sync_id string, name string")
    seq = spark.createDataFrame([("k", '["s2","s1","s9"]'), ("bad", "x"), ("none", None)], "key string, ids string")
    assert [(r["pos"], r["sync_id"], r["label"]) for r in O.order_view(seq, records).orderBy("pos").collect()] == [(1, "s2", "Unnamed record"), (2, "s1", "One"), (3, "s9", "Unnamed record")]


def test_choices_on_one_field_and_deletes(spark):
    """The newest choice counts; a settled delete sets or clears the time of deletion; a deleted row stays so otherwise."""
    server = rows(spark, ("a", "A", 1.0, None, 5), ("b", "B", 1.0, "t", 6), ("c", "C", 1.0, None, 7))
    done = [(1, "a", "name", "applied", "old"), (2, "a", "name", "applied", "new"), (3, "b", "name", "applied", "B2"), (4, "c", "deleted_at", "applied", "2026"), (5, "b", "price", "reopened", "9")]
    out = O.settled(server, spark.createDataFrame(done, "id long, sync_id string, field_name string, outcome string, value string"), FIELDS, 100).collect()
    assert {r["sync_id"]: (r["name"], r["deleted_at"]) for r in out} == {"a": ("new", None), "b": ("B2", "t"), "c": ("C", "2026")}
    alive = O.settled(server, spark.createDataFrame([(1, "b", "deleted_at", "applied", None)], "id long, sync_id string, field_name string, outcome string, value string"), FIELDS, 100).first()
    assert (alive["sync_id"], alive["deleted_at"]) == ("b", None)


def test_deletes_against_edits_and_typed_values(spark):
    from ledgerloom.operators import replication as R

    server = rows(spark, ("a", "A", 6971.0, None, 5), ("b", "B", 1.0, "t", 6))
    schema = "id long, sync_id string, kind string, field_name string, offline_value string, online_value string, status string"
    found = [(1, "a", "delete_edit", "deleted_at", "2026", None, "open"), (2, "b", "delete_edit", "deleted_at", None, "t0", "open"), (3, "b", "delete_edit", "deleted_at", None, "null", "open"), (4, "a", "financial", "price", "7", "6,971", "open"), (5, "a", "sr_ordering", "sr_no", "[]", "[]", "open")]
    choices = spark.createDataFrame([(i, "KEEP_OFFLINE", None) for i in range(1, 6)], "id long, choice string, value string")
    got = {r["id"]: (r["outcome"], r["value"]) for r in R.resolve_fields(spark.createDataFrame(found, schema), choices, server).collect()}
    assert got == {1: ("applied", "2026"), 2: ("applied", None), 3: ("reopened", None), 4: ("applied", "7"), 5: ("invalid", None)}


def test_a_stored_null_version_is_zero(spark):
    from ledgerloom.operators.mutations import upsert

    table = spark.createDataFrame([("a", None, "old"), ("b", None, "old"), ("c", 3, "old")], "sync_id string, server_rev long, name string")
    new = spark.createDataFrame([("a", 5, "new"), ("b", 0, "new"), ("c", 3, "new"), ("d", 9, "new")], "sync_id string, expected long, name string")
    assert {r["sync_id"]: r["name"] for r in upsert(table, new, expected="expected").collect()} == {"a": "old", "b": "new", "c": "new", "d": "new"}
