import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import merge as M
from ledgerloom.operators import replication as R

FIELDS = ("bid_date", "name", "product", "serial_no", "price", "phone", "invoice_no", "sr_no", "month")
BASE = {"sr_no": 1, "bid_date": "01-08-2026", "invoice_no": "INV-1", "name": "AA", "product": "P1", "serial_no": "SN1", "price": 1000.0, "phone": "1", "month": "AUGUST_2026"}


def struct_of(fields):
    return "struct<" + ", ".join(f"{f}: {R.FIELD_TYPES[f]}" for f in fields) + ">"


def merged(spark, base, off, on):
    s = struct_of(FIELDS)
    df = spark.createDataFrame([(base, off, on)], f"base {s}, offline {s}, online {s}")
    return M.merge_rows(df, FIELDS).first()


@pytest.mark.parametrize(
    ("off", "on", "action", "value"),
    [({}, {}, "unchanged", "AA"), ({"name": "BB"}, {}, "use_offline", "BB"), ({}, {"name": "CC"}, "use_online", "CC"), ({"name": "BB"}, {"name": " bb "}, "converged", "BB"), ({"name": "BB"}, {"name": "CC"}, "conflict", None), ({"name": " aa "}, {}, "unchanged", "AA")],
)
def test_field_merge(spark, off, on, action, value):
    r = merged(spark, BASE, BASE | off, BASE | on)
    assert r["actions"]["name"] == action and r["resolved"]["name"] == value
    assert [c["field"] for c in r["conflicts"]] == (["name"] if action == "conflict" else [])


def test_merge_of_classes(spark):
    r = merged(spark, BASE, BASE | {"price": 2.0, "serial_no": "X", "bid_date": "2026-08-01"}, BASE | {"price": 3.0, "serial_no": "Y", "bid_date": "01/08/2026"})
    assert {(c["kind"], c["field"]) for c in r["conflicts"]} == {("financial", "price"), ("serial", "serial_no")}
    assert r["actions"]["bid_date"] == "unchanged" and r["resolved"]["month"] == "AUGUST_2026"
    r = merged(spark, None, BASE, BASE | {"bid_date": "odd", "month": ""})
    assert r["actions"]["name"] == "converged" and r["actions"]["bid_date"] == "conflict" and r["resolved"]["month"] == "AUGUST_2026"
    r = merged(spark, BASE | {"price": None}, BASE | {"price": 0.0}, BASE | {"price": None})
    assert r["actions"]["price"] == "use_offline"


def test_tombstones_and_orders(spark):
    df = spark.createDataFrame(list(itertools.product([True, False], repeat=3)), "b boolean, f boolean, n boolean")
    got = {tuple(r)[:3]: tuple(r["t"]) for r in df.withColumn("t", M.tombstone_action(F.col("b"), F.col("f"), F.col("n"))).collect()}
    assert got[True, True, True] == ("unchanged", "alive") and got[True, False, False] == ("apply", "both") and got[True, False, True] == ("apply", "offline") and got[True, True, False] == ("apply", "online")
    assert got[False, False, False] == ("unchanged", "both_deleted") and all(got[False, f, n] == ("conflict", "resurrect") for f, n in ((True, True), (True, False), (False, True)))
    seq = {tuple(r)[:3]: r["a"] for r in df.withColumn("a", M.sequence_action(F.col("b"), F.col("f"), F.col("n"))).collect()}
    assert seq[True, True, True] == "unchanged" and seq[False, True, False] == "use_offline" and seq[True, False, False] == "use_online" and seq[False, False, True] == "use_offline" and seq[False, False, False] == "conflict"


def op(id, sync_id, payload, base=BASE, op_type="upsert", base_rev=1, op_id=None, status="pending"):
    env = {"sync_id": sync_id, "op_type": op_type, "payload": payload, "base": base, "base_rev": base_rev, "local_row_rev": id, "created_at": "x"}
    return (id, op_id or f"o{id}", sync_id, op_type, json.dumps(env), base_rev, status)


class World:
    def __init__(self, spark):
        self.spark = spark
        self.outbox, self.server, self.applied, self.conflicts = [], [("a", 1, BASE, None), ("b", 2, BASE | {"invoice_no": "INV-B"}, None), ("z", 3, BASE, "2026")], [], []

    def ops(self):
        df = self.spark.createDataFrame(self.outbox, "id long, op_id string, sync_id string, op_type string, payload_json string, base_rev long, status string")
        return R.decode_ops(df)

    def table(self):
        names = ", ".join(f"{f} {R.FIELD_TYPES[f]}" for f in FIELDS)
        return self.spark.createDataFrame([(s, rev, *(r[f] for f in FIELDS), d) for s, rev, r, d in self.server], f"sync_id string, server_rev long, {names}, deleted_at string")

    def run(self, **kw):
        applied = self.spark.createDataFrame(self.applied, "id long, op_id string, result string, server_rev_after long")
        conflicts = self.spark.createDataFrame(self.conflicts, "id long, sync_id string, kind string, status string")
        results, changed = R.apply_ops(self.ops(), self.table(), applied, conflicts, FIELDS, "now", 100, **kw)
        self.changed = {r["sync_id"]: r for r in changed.collect()}
        return {r["id"]: (r["result"], r["reason"], r["server_rev_after"]) for r in results.collect()}


@pytest.fixture
def world(spark):
    return World(spark)


def test_apply_in_order(world):
    world.outbox = [
        op(1, "a", BASE | {"name": "N1"}), op(2, "a", BASE | {"name": "N1", "phone": "2"}, BASE | {"name": "N1"}), op(3, "b", BASE | {"invoice_no": "INV-1"}, BASE | {"invoice_no": "INV-B"}), op(4, "new", BASE, None, base_rev=0),
        op(5, "z", BASE | {"name": "late"}), op(6, "z", BASE, op_type="delete"), op(7, "none", BASE, op_type="delete"), op(8, "odd", BASE, base_rev=4), op(9, "new", BASE | {"deleted_at": "t"}, BASE, op_type="delete"),
    ]
    got = world.run()
    assert got[1] == ("applied", "", 101) and got[2] == ("applied", "", 102) and got[3] == ("applied", "", 103) and got[4] == ("applied", "", 104) and got[9] == ("applied", "", 105)
    assert got[5][0] == "conflict" and got[6] == ("conflict", "open conflict", None) and got[7][0] == "error" and got[8][0] == "error"
    assert world.changed["a"]["row"]["phone"] == "2" and world.changed["a"]["server_rev"] == 102 and world.changed["new"]["deleted_at"] == "t"
    assert set(world.changed) == {"a", "b", "new"}


def test_replay_freeze_and_cut_off(world):
    world.applied, world.conflicts = [(1, "o1", "applied", 50)], [(1, "b", "field", "open"), (2, "a", "invoice_collision", "open")]
    world.outbox = [op(1, "a", BASE | {"name": "ignored"}), op(2, "b", BASE | {"invoice_no": "INV-B", "name": "held"}, BASE | {"invoice_no": "INV-B"}), op(3, "gone", BASE, op_type="delete"), op(4, "a", BASE | {"name": "after"})]
    got = world.run()
    assert got[1] == ("applied", "replayed", 50) and got[2] == ("conflict", "open conflict", None) and got[3][0] == "error" and got[4] == ("applied", "", 101)
    assert set(world.run(stop_at_error=True)) == {1, 2} and world.changed == {}


def test_an_op_delivered_again_is_replayed(world):
    """Within the outbox, for the same row, after a later op of it, and for another row."""
    one = BASE | {"name": "N1"}
    world.outbox = [op(1, "a", one, op_id="x"), op(2, "a", one, op_id="x"), op(3, "a", one | {"name": "N3"}, one), op(4, "a", one, op_id="x"), op(5, "a", one | {"name": "N3", "phone": "5"}, one | {"name": "N3"})]
    world.outbox += [op(6, "b", BASE | {"invoice_no": "INV-B", "name": "M"}, BASE | {"invoice_no": "INV-B"}, op_id="x"), op(7, "none", BASE, op_type="delete", op_id="y"), op(8, "new", BASE, None, base_rev=0, op_id="y"), op(9, "b", BASE | {"invoice_no": "INV-B", "name": "K"}, BASE | {"invoice_no": "INV-B"}, op_id="y")]
    got = world.run()
    assert [got[i] for i in (1, 2, 3, 4, 5, 6)] == [("applied", "", 101), ("applied", "replayed", 101), ("applied", "", 102), ("applied", "replayed", 101), ("applied", "", 103), ("applied", "replayed", 101)]
    assert got[7][0] == "error" and got[8] == ("applied", "", 104) and got[9] == ("applied", "replayed", 104)
    assert (world.changed["a"]["row"]["name"], world.changed["a"]["row"]["phone"]) == ("N3", "5") and set(world.changed) == {"a", "new"}


def test_a_conflict_holds_back_what_follows(world):
    world.server[0] = ("a", 1, BASE | {"price": 1111.0}, None)
    world.outbox = [op(1, "a", BASE | {"price": 3333.0}), op(2, "a", BASE | {"name": "fine"})]
    assert {k: v[0] for k, v in world.run().items()} == {1: "conflict", 2: "conflict"} and world.changed == {}


def test_long_history_of_one_row_against_a_plain_fold(world):
    r, row, base = random.Random(4), dict(BASE), dict(BASE)
    for i in range(1, 400):
        new = base | {r.choice(["name", "phone", "product"]): str(r.randrange(9))}
        world.outbox.append(op(i, "a", new, base))
        base = new
    world.outbox.append(op(400, "b", BASE | {"invoice_no": "INV-B"}, BASE | {"invoice_no": "INV-B"}))
    got = world.run()
    assert {v[0] for v in got.values()} == {"applied"} and [got[i][2] for i in range(1, 401)] == list(range(101, 501))
    assert {f: world.changed["a"]["row"][f] for f in FIELDS} == base and row == BASE


def test_coalescing(world):
    world.outbox = [op(1, "a", BASE | {"name": "1"}), op(2, "a", BASE | {"name": "2"}, BASE | {"name": "1"}, base_rev=7), op(3, "a", BASE, op_type="delete"), op(4, "a", BASE | {"name": "4"}, status="applied"), op(5, "b", BASE)]
    got = {r["sync_id"]: r for r in R.coalesce_ops(world.ops()).collect()}
    assert (got["a"]["op_id"], got["a"]["payload"]["name"], got["a"]["base"]["name"], got["a"]["base_rev"], got["a"]["superseded"]) == ("o2", "2", "AA", 1, 1) and got["b"]["superseded"] == 0


def test_watermarks(world, spark):
    t = world.table()
    assert R.watermark(t, t.limit(0), 1).first()[0] == 3 and R.watermark(t, t.filter("server_rev = 2"), 0).first()[0] == 1 and R.watermark(t.limit(0), t.limit(0), 9).first()[0] == 9


def test_pulled_rows(world, spark):
    local = world.table().withColumn("base_json", F.lit(json.dumps(BASE))).withColumn("name", F.when(F.col("sync_id") == "a", "mine").otherwise(F.col("name")))
    pulled = world.table().withColumn("name", F.lit("theirs")).unionByName(world.table().filter("sync_id = 'b'").withColumn("sync_id", F.lit("n"))).withColumn("id", F.lit(1))
    world.outbox = [op(1, "b", BASE)]
    got = {r["sync_id"]: r for r in R.merge_pulled(pulled, local, world.ops(), FIELDS).collect()}
    assert {k: v["action"] for k, v in got.items()} == {"a": "attention", "z": "update", "n": "insert"} and got["z"]["resolved"]["name"] == "theirs"


def test_month_orders(world):
    rows = {"sA": 1, "sB": 2, "sC": 3}
    world.server = [(s, 1, BASE | {"sr_no": n}, None) for s, n in rows.items()]
    move = lambda i, s, to: op(i, s, BASE | {"sr_no": to}, BASE | {"sr_no": rows[s]})
    world.outbox = [move(1, "sB", 1), move(2, "sC", 2), move(3, "sA", 3)]
    assert [tuple(r) for r in R.ordering_plan(world.ops(), world.table()).collect()] == [("AUGUST_2026", "use_offline", 3)]
    world.server = [(s, 1, BASE | {"sr_no": n}, None) for s, n in {"sC": 1, "sA": 2, "sB": 3}.items()]
    assert R.ordering_plan(world.ops(), world.table()).first()["action"] == "conflict"
    world.server = [(s, 1, BASE | {"sr_no": n}, None) for s, n in {"sB": 1, "sC": 2, "sA": 3}.items()]
    assert R.ordering_plan(world.ops(), world.table()).first()["action"] == "use_offline"
    spark = world.spark
    chosen = spark.createDataFrame([("AUGUST_2026", ["sC", "sB", "sA"])], "month string, sequence array<string>")
    assert {r["sync_id"]: r["sr_no"] for r in R.order_resolution(chosen, world.table()).collect()} == {"sC": 1, "sB": 2, "sA": 3}
    for bad in (["sC", "sB"], ["sC", "sB", "sB", "sA"], ["sC", "sB", "sA", "sX"]):
        assert R.order_resolution(spark.createDataFrame([("AUGUST_2026", bad)], "month string, sequence array<string>"), world.table()).isEmpty()


def test_an_order_that_moved_since_is_reopened(world, spark):
    world.server = [(s, 1, BASE | {"sr_no": n}, None) for s, n in {"sA": 1, "sB": 2, "sC": 3}.items()]
    chosen = ["sC", "sB", "sA"]
    for online, want in ((["sA", "sB", "sC"], {("sC", 1, "applied"), ("sB", 2, "applied"), ("sA", 3, "applied")}), (["sB", "sA", "sC"], {(None, None, "reopened")}), (["sA", "sB"], {(None, None, "reopened")})):
        conflict = spark.createDataFrame([("AUGUST_2026", chosen, online)], "month string, sequence array<string>, online array<string>")
        assert {(r["sync_id"], r["sr_no"], r["outcome"]) for r in R.order_resolution(conflict, world.table()).collect()} == want


def test_resolutions(world, spark):
    rows = [(1, "a", "field", "name", "mine", "AA", "open", "m"), (2, "a", "field", "phone", "9", "old", "open", "m"), (3, "a", "invoice_collision", "invoice_no", "x", "y", "open", "m"), (4, "nobody", "field", "name", "x", "y", "open", "m"), (5, "b", "field", "name", "x", "AA", "resolved", "m"), (6, "b", "financial", "price", "7", "1000.0", "open", "m")]
    conflicts = spark.createDataFrame(rows, "id long, sync_id string, kind string, field_name string, offline_value string, online_value string, status string, month string")
    choices = spark.createDataFrame([(i, c, v) for i, c, v in ((1, "KEEP_OFFLINE", None), (2, "KEEP_OFFLINE", None), (3, "KEEP_ONLINE", None), (4, "KEEP_ONLINE", None), (5, "KEEP_ONLINE", None), (6, "MERGE", "8"))], "id long, choice string, value string")
    got = {r["id"]: (r["outcome"], r["value"]) for r in R.resolve_fields(conflicts, choices, world.table()).collect()}
    assert got == {1: ("applied", "mine"), 2: ("reopened", None), 3: ("invalid", None), 4: ("gone", None), 6: ("applied", "8")}


def plain_fold(outbox, rows, held, now="now", first_rev=100):
    """Ops applied one after another, for values whose plain forms are these: text upper case, anything else itself."""
    form = lambda v: "" if v is None else v.strip().upper() if isinstance(v, str) else v
    differ = lambda a, b: [f for f in FIELDS if form(a.get(f)) != form(b.get(f))]
    rows, held, stored, out, rev = {k: (dict(r), d) for k, (r, d) in rows.items()}, set(held), {}, {}, first_rev

    def one(s, kind, pay, base, base_rev):
        row, dead = rows.get(s, (None, None))
        if s in held:
            return "conflict"
        if kind == "delete":
            if row is None:
                return "error"
            if dead:
                return "noop"
            if base is not None and differ(base, row):
                return "conflict"
            rows[s] = (row, pay.get("deleted_at") or now)
            return "applied"
        known = base or {}
        if row is None:
            if base_rev and any(known.get(f) is not None for f in FIELDS):
                return "error"
            rows[s] = ({f: pay.get(f) for f in FIELDS}, None)
            return "applied"
        mine, theirs = set(differ(known, pay)) - {"month"}, set(differ(known, row)) - {"month"}
        if any(f in theirs and form(pay.get(f)) != form(row.get(f)) for f in mine):
            return "conflict"
        if dead and not pay.get("deleted_at") and differ(known, pay) or known.get("deleted_at") and not (pay.get("deleted_at") and dead):
            return "conflict"
        new = {f: pay.get(f) if f in mine and (f not in theirs or f not in ("sr_no", "invoice_no")) else row[f] if f in theirs or f in ("sr_no", "invoice_no") else known.get(f) for f in FIELDS}
        rows[s] = (new | {"month": pay.get("month") or row["month"]}, pay.get("deleted_at") or dead)
        return "applied"

    for id, op_id, s, kind, j, base_rev, _ in sorted(outbox):
        e = json.loads(j)
        if not op_id:
            out[id] = ("error", None)
        elif op_id in stored:
            out[id] = ("applied", stored[op_id])
        elif kind not in ("upsert", "delete"):
            out[id] = ("error", None)
        else:
            result = one(s, kind, e["payload"] or {}, e["base"], base_rev)
            if result == "applied":
                rev += 1
                stored[op_id] = rev
            held |= {s} if result == "conflict" else set()
            out[id] = (result, rev if result == "applied" else None)
    return out, rows


@pytest.mark.parametrize("hot_rows", [2, 100_000])
def test_many_ops_against_a_plain_fold(spark, hot_rows):
    """Stale and fresh bases, rows made and deleted, ops delivered again, before their row is there, for other rows, and of unknown types."""
    r = random.Random(11)
    fresh = lambda: BASE | {"name": r.choice("AB"), "phone": r.choice("12"), "price": r.choice([1.0, 2.0]), "invoice_no": r.choice(["I", "J"]), "bid_date": "odd", "month": "M", "sr_no": 1}
    world = World(spark)
    keys = [f"k{i}" for i in range(60)]
    rows = {k: (fresh(), "2026" if r.random() < 0.1 else None) for k in keys if r.random() < 0.6}
    held = [k for k in keys if r.random() < 0.05]
    world.server = [(k, 1, row, d) for k, (row, d) in rows.items()]
    world.conflicts = [(i, k, "field", "open") for i, k in enumerate(held)]
    seen = {k: row for k, (row, _) in rows.items()}
    for i in range(1, 700):
        k = r.choice(keys[:6] if r.random() < 0.3 else keys)
        if world.outbox and r.random() < 0.15:
            world.outbox.append((i, *r.choice(world.outbox)[1:]))
            continue
        base = r.choice([seen.get(k), seen.get(k), fresh(), None])
        new = (base or fresh()) | ({r.choice(["name", "phone", "invoice_no"]): r.choice(["A", "b ", "2", "J"])} if r.random() < 0.9 else {})
        kind = r.choice(["upsert"] * 7 + ["delete", "rename"])
        if kind == "delete" or r.random() < 0.03:
            new = new | {"deleted_at": "t"}
        again = r.choice(world.outbox)[1] if world.outbox and r.random() < 0.02 else "" if r.random() < 0.01 else None
        world.outbox.append(op(i, k, new, base, kind, r.choice([0, 3]), again) if again != "" else (*op(i, k, new, base, kind)[:1], "", *op(i, k, new, base, kind)[2:]))
        if kind == "upsert" and r.random() < 0.7:
            seen[k] = {f: new.get(f) for f in FIELDS}
    want, after = plain_fold(world.outbox, rows, held)
    got = world.run(hot_rows=hot_rows)
    assert {i: (x[0], x[2]) for i, x in got.items()} == want
    assert {x for x, _ in want.values()} == {"applied", "conflict", "error", "noop"}
    changed = {k for k, v in after.items() if v != (rows.get(k, (None, None))) }
    assert {k: ({f: x["row"][f] for f in FIELDS}, x["deleted_at"]) for k, x in world.changed.items() if k in changed} == {k: after[k] for k in changed}


def test_ops_against_a_month_order_are_parked(world):
    """One ordering conflict for the month; its ops are conflicts and hold back their rows; others go on."""
    rows = {"sA": 1, "sB": 2, "sC": 3}
    world.server = [(s, 1, BASE | {"sr_no": n}, None) for s, n in {"sC": 1, "sA": 2, "sB": 3}.items()] + [("z", 1, BASE | {"month": "MAY_2026", "bid_date": "01-05-2026"}, None)]
    world.outbox = [op(i, s, BASE | {"sr_no": to}, BASE | {"sr_no": rows[s]}) for i, (s, to) in enumerate((("sB", 1), ("sC", 2), ("sA", 3)), 1)]
    world.outbox += [op(4, "sA", BASE | {"sr_no": 2, "name": "later"}, BASE | {"sr_no": 2}), op(5, "z", BASE | {"month": "MAY_2026", "bid_date": "01-05-2026", "name": "free"}, BASE | {"month": "MAY_2026", "bid_date": "01-05-2026"})]
    got = world.run()
    assert [got[i][:2] for i in (1, 2, 3)] == [("conflict", "month order")] * 3 and got[4] == ("conflict", "open conflict", None) and got[5] == ("applied", "", 101)
    applied = world.spark.createDataFrame([], "id long, op_id string, result string, server_rev_after long")
    none = world.spark.createDataFrame([], "id long, sync_id string, kind string, status string, month string")
    results, _ = R.apply_ops(world.ops(), world.table(), applied, none, FIELDS, "now", 100)
    assert [(c["kind"], c["field"]) for x in results.collect() for c in x["conflicts"] if c["kind"] == "sr_ordering"] == [("sr_ordering", "sr_no")]


def test_rows_that_come_twice_and_ops_of_unknown_type(world):
    """Of several rows of a sync_id the one of the highest revision counts."""
    world.server = [("a", 5, BASE | {"name": "NEW"}, None), ("a", 1, BASE, None)]
    world.outbox = [op(1, "a", BASE | {"name": "N1"}, BASE | {"name": "NEW"}), op(2, "a", BASE, op_type="rename")]
    got = world.run()
    assert got[1] == ("applied", "", 101) and got[2] == ("error", "unknown op_type", None)
