import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom import storage
from ledgerloom.operators.changelog import ChangeLog, outbox_changes, whole_object

COLUMNS = "id long, op_id string, sync_id string, op_type string, payload_json string, base_rev long, key string, seq string"


def payload(rev, **more):
    return json.dumps({"local_row_rev": rev, "payload": {"name": "x"} | more})


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], COLUMNS)


def final(log):
    return {r["key"]: r["value"]["op_id"] for r in log.read().collect()}


def test_whole_objects(spark):
    cases = {
        '{"a":1}': True, '  {"a":{"b":[1,"}"]}}  ': True, '{"a":1,"a":2}': True, "{}": True, '{"a":null}': True,
        '{"a":1': False, '{"a":1} x': False, '{"a":1}{"b":2}': False, '{"a":1},"b":{}': False, '{"a":1}}': False, "[]": False, "null": False, "": False, " ": False, "12": False, '"x"': False, "{'a':1}": False, '{"a":1,}': False, '{"sync': False,
    }
    df = spark.createDataFrame([(k,) for k in cases], "j string")
    assert {r["j"]: r["w"] for r in df.select("j", whole_object(F.col("j")).alias("w")).collect()} == cases
    assert spark.sql("SELECT CAST(NULL AS STRING) AS j").select(whole_object(F.col("j")).alias("w")).first()["w"] is False


def test_order_repeats_damage_and_tombstones(spark):
    rows = [
        (1, "o2", "a", "upsert", payload(2), 5), (2, "o1", "a", " UPSERT ", payload(1), 5), (3, "o2", "a", "Upsert", payload(2), 5), (4, "o3", "a", "delete", payload(9), 4),
        (5, "p1", "b", "upsert", payload(1), 1), (6, "p2", "b", "DELETE", payload(1), 2), (7, "p3", "b", "upsert", '{"local_row_rev":1', 3),
        (8, "q1", "c", "delete", payload(1), 1), (9, "q2", "c", "upsert", payload(2), 1), (10, "r1", None, "upsert", payload(1), 1), (11, "s1", "d", "rename", payload(1), 1), (12, "t1", "e", "upsert", None, 1),
        (13, "u1", "f", "upsert", payload(10), 1), (14, "u2", "f", "upsert", payload(9), 1),
    ]
    log = ChangeLog(spark, storage.scratch(spark, "c"))
    log.append(outbox_changes(table(spark, rows)))
    assert final(log) == {"a": "o2", "c": "q2", "f": "u1"}


def test_empty_feed(spark):
    log = ChangeLog(spark, storage.scratch(spark, "c"))
    log.append(outbox_changes(table(spark, [])))
    assert final(log) == {}
    with pytest.raises(ValueError, match="no runs"):
        ChangeLog(spark, storage.scratch(spark, "c")).read()


def test_runs_merge_and_compact_to_the_same_state(spark):
    r = random.Random(3)
    ops = [(i, f"o{i}", "hot" if r.random() < 0.4 else f"k{r.randrange(60)}", r.choice(["upsert", "upsert", "delete"]), payload(r.randrange(50)), r.randrange(20)) for i in range(900)]
    ops = [o for o in {(o[2], o[5], o[4]): o for o in ops}.values()]
    last = {}
    for o in ops:
        at = (o[5], json.loads(o[4])["local_row_rev"])
        if o[2] not in last or at > last[o[2]][0]:
            last[o[2]] = (at, o)
    want = {k: o[1] for k, (_, o) in last.items() if o[3] == "upsert"}
    r.shuffle(ops)
    log = ChangeLog(spark, storage.scratch(spark, "c"), fan_in=3)
    for i in range(0, len(ops), 150):
        log.append(outbox_changes(table(spark, ops[i : i + 150])))
        log.compact()
    assert log.read().count() == len(want)
    assert len(log.runs()) <= 3 and max(level for level, _ in log.runs()) >= 1
    assert final(log) == want
    assert log.compact(every=True) and len(log.runs()) == 1
    assert final(log) == want
    late = (9999, "late", next(k for k, (_, o) in last.items() if o[3] == "delete"), "upsert", payload(0), -1)
    log.append(outbox_changes(table(spark, [late])))  # older than a tombstone that was kept
    assert final(log) == want


def test_a_run_without_success_mark_does_not_count(spark):
    log = ChangeLog(spark, storage.scratch(spark, "c"))
    log.append(outbox_changes(table(spark, [(1, "o1", "a", "upsert", payload(1), 1)])))
    log.append(outbox_changes(table(spark, [(2, "o2", "a", "upsert", payload(2), 1)])))
    storage.remove(spark, log.runs()[-1][1] + "/_SUCCESS")
    assert final(log) == {"a": "o1"}


def test_rebuilt_rows_have_every_field(spark, tmp_path):
    from ledgerloom.plans import record_queries
    from ledgerloom.schema import FIELD_TYPES

    row = {f: 7 if t == "bigint" else 1.5 if t == "double" else f"a {f}" for f, t in FIELD_TYPES.items()}
    deliveries = [("s", f"o{n}", "upsert", json.dumps({"payload": row | {"remarks": f"r{n}"}, "local_row_rev": n}), 1) for n in (2, 1)]
    spark.createDataFrame(deliveries, "sync_id string, op_id string, op_type string, payload_json string, base_rev long").write.parquet(f"{tmp_path}/outbox.parquet")
    assert [r.asDict() for r in record_queries.p5_rows(spark, str(tmp_path)).collect()] == [{"sync_id": "s"} | row | {"remarks": "r2"}]


def test_runs_are_merged_without_a_shuffle(spark):
    log = ChangeLog(spark, storage.scratch(spark, "c"), buckets=3)
    for rev in (1, 2, 3):
        log.append(outbox_changes(table(spark, [(rev, f"o{rev}", "a", "upsert", payload(rev), rev), (9, f"p{rev}", f"b{rev}", "upsert", payload(rev), rev)])))
    state = log.read()
    assert "Exchange" not in state._jdf.queryExecution().executedPlan().toString()
    assert final(log) == {"a": "o3", "b1": "p1", "b2": "p2", "b3": "p3"} and log.read().count() == 4
    again = ChangeLog(spark, log.path)
    assert final(again) == final(log) and again.buckets == 3
