import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ledger as L
from ledgerloom.operators import mutations as U
from ledgerloom.operators.ranking import rank_within

COLUMNS = "id long, sr_no long, bid_date string, invoice_no string, name string, xcell string, product string, serial_no string, price double, di double, bid string, dp_taken double, scheme string, phone string, alt_phone string, month string, deleted_at string, sync_id string, emi double, updated_at string, created_at string"


def row(id, **kw):
    base = {"sr_no": id, "bid_date": "05-08-2026", "invoice_no": f"2608{id:02d}", "name": "ORIG", "month": "AUGUST_2026", "price": 1.0, "di": 2.0, "dp_taken": 3.0, "xcell": "1", "sync_id": f"s{id}"}
    return {"id": id} | base | kw


@pytest.fixture
def make(spark):
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def table(*rows):
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], COLUMNS)

    return table


def ids(df):
    return [r["id"] for r in df.collect()]


def test_search_conditions_and_pages(make):
    t = make(row(1, name="100% Cotton"), row(2, phone="98"), row(3, deleted_at="x"), row(4, bid_date="2026-08-05"), row(5, name=None, bid_date=None))
    assert ids(L.page(L.search(t))) == [5, 4, 2, 1]
    assert ids(L.search(t, " cotton ")) == [1]
    assert sorted(ids(L.search(t, "o%t"))) == [1] and ids(L.search(t, "o%t", escape=True)) == []
    assert ids(L.search(t, phone="98")) == [2]
    assert sorted(ids(L.search(t, date_from="01-08-2026", date_to="31-08-2026"))) == [1, 2]
    assert sorted(ids(L.search(t, date_from="01-08-2026"))) == [1, 2, 4]  # a date in another form compares by its places
    assert ids(L.page(L.search(t), "nonsense", False, 2, 3)) == [5]
    assert ids(L.page(L.search(t), "bid_date", False, 1, 2)) == [5, 1]
    assert [L.page_count(n, 50) for n in (0, 50, 51)] == [1, 1, 2]


def test_sums_of_nothing(make):
    t = make(row(1, deleted_at="x"))
    assert tuple(L.totals(t).first()) == (0, 0.0, 0.0, None)
    assert L.monthly_cards(t).count() == 0
    assert tuple(L.today_stats(t, date(2026, 8, 5)).first()) == (0, 0.0, 0.0)
    assert L.max_invoice_counter(t, "2608").first()[0] == 0 and L.latest_invoice_code(t).first()[0] == ""


def test_tables_without_deletion(make):
    assert L.live(make(row(1, deleted_at="x")).drop("deleted_at")).count() == 1


def test_cards_calendar_months(make):
    t = make(row(1, xcell="1,250"), row(2, xcell="12abc", bid_date="5/8/2026"), row(3, xcell=None, bid_date="odd"), row(4, month="MAY_2024"), row(5, month=""), row(6, month="BAD"))
    cards = {r["month"]: tuple(r)[1:] for r in L.monthly_cards(t).collect()}
    assert cards["AUGUST_2026"] == (3, 9.0, 6.0, 1262.0) and set(cards) == {"AUGUST_2026", "MAY_2024", "", "BAD"}
    assert [r["month"] for r in L.available_months(t, "JUNE_2025").collect()] == ["BAD", "AUGUST_2026", "JUNE_2025", "MAY_2024"]
    days = {r["day"]: r["n"] for r in L.daily_calendar(t, "AUGUST_2026").collect()}
    assert len(days) == 31 and days["05-08-2026"] == 2 and sum(days.values()) == 2
    assert {r["month"]: r["n"] for r in L.cards_of(t.sparkSession.createDataFrame([("MAY_2024",), ("X_1",)], "month string"), t).collect()} == {"MAY_2024": 1, "X_1": 0}


def test_invoice_numbers(make):
    t = make(row(1, invoice_no="260801"), row(2, invoice_no="2608100"), row(3, invoice_no="2608"), row(4, invoice_no="26A801"), row(5, invoice_no=" 260899"), row(6, invoice_no="2609" + "9" * 30), row(7, invoice_no=None))
    assert L.latest_invoice_code(t).first()[0] == "2609"
    assert L.max_invoice_counter(t, "2608").first()[0] == 100 and L.max_invoice_counter(t, "2609").first()[0] == 0


def test_rank_within_spreads_a_hot_group(spark):
    r = random.Random(1)
    rows = [(i, "hot" if r.random() < 0.5 else r.choice(["a", "b", None]), r.randrange(50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, g string, v int")
    got = {x["id"]: x["n"] for x in rank_within(df, ["g"], [F.asc("v"), F.asc("id")], "n").collect()}
    want = {}
    for g in ("hot", "a", "b", None):
        want |= {x[0]: k for k, x in enumerate(sorted((x for x in rows if x[1] == g), key=lambda x: (x[2], x[0])), 1)}
    assert got == want
    every = {x["id"]: x["n"] for x in rank_within(df, [], [F.desc("id")], "n").collect()}
    assert every == {i: 2000 - i for i in range(2000)}
    assert rank_within(df.limit(0), ["g"], [F.asc("v")], "n").count() == 0


def test_renumbering_and_neighbours(make):
    t = make(row(1, sr_no=1), row(2, sr_no=4), row(3, sr_no=4), row(4, sr_no=2, deleted_at="x"), row(5, sr_no=9, month=""), row(6, sr_no=None))
    assert {(r["id"], r["new_sr"]) for r in L.renumbered(t).collect()} == {(6, 1), (1, 2), (2, 3)}
    near = {r["id"]: (r["above"], r["below"]) for r in L.neighbours(make(row(1, sr_no=1), row(2, sr_no=2), row(7, sr_no=2), row(3, sr_no=3))).collect()}
    assert near == {1: (None, 7), 2: (1, 3), 7: (1, 3), 3: (7, None)}


def test_imports_follow_the_order_of_rows(make):
    r = random.Random(2)
    for _ in range(4):
        held = make(row(1, invoice_no="A0", serial_no="S0"))
        new = [row(i, invoice_no=r.choice(["a0", "b", "C", "d", "", None, "e"]), serial_no=r.choice(["s0", "t", "U", "v ", None, ""])) for i in range(10, 30)]
        seen_i, seen_s, want = {"a0"}, {"s0"}, []
        for x in new:
            i, s = ((x[c] or "").strip().lower() for c in ("invoice_no", "serial_no"))
            if i in seen_i or s in seen_s:
                continue
            want.append(x["id"])
            seen_i |= {i} - {""}
            seen_s |= {s} - {""}
        assert sorted(ids(L.import_new(make(*new), held))) == want
    assert ids(L.import_new(make().limit(0), held)) == []


def test_taken(make):
    t = make(row(1, invoice_no="Inv-1"))
    assert [L.taken(t, "invoice_no", x).first()[0] for x in (" inv-1 ", "inv", " ")] == [True, False, False]


def test_mutations(make, spark):
    t = make(row(1, sr_no=1), row(2, sr_no=2), row(3, sr_no=3), row(4, sr_no=1, month="MAY_2024", bid_date="01-05-2024"))
    gone = {r["id"]: (r["sr_no"], r["deleted_at"]) for r in U.delete(t, spark.createDataFrame([(2,), (99,)], "id long"), "now").collect()}
    assert gone == {1: (1, None), 2: (2, "now"), 3: (2, None), 4: (1, None)}
    assert sorted(ids(U.delete(t, spark.createDataFrame([(2,)], "id long"), "now", physical=True))) == [1, 3, 4]
    assert {r["id"]: r["sr_no"] for r in U.swap_places(t, 1, 3).collect()} == {1: 3, 2: 2, 3: 1, 4: 1}
    assert {r["id"]: r["sr_no"] for r in U.swap_places(t, 1, 99).collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    changed = U.update(t, spark.createDataFrame([(1, "2024-05-06", "N"), (77, "x", "y")], "id long, bid_date string, name string"))
    assert {(r["id"], r["bid_date"], r["month"], r["name"], r["sr_no"]) for r in changed.filter("id = 1").collect()} == {(1, "06-05-2024", "MAY_2024", "N", 1)} and changed.count() == 4
    more = U.add(t, spark.createDataFrame([(1, "5/8/2026", "A"), (2, "odd", "B"), (3, "6-8-2026", "C")], "_seq long, bid_date string, name string"), "JUNE_2025")
    assert {(r["id"], r["sr_no"], r["month"], r["bid_date"]) for r in more.filter("id > 4").collect()} == {(5, 4, "AUGUST_2026", "05-08-2026"), (6, 1, "JUNE_2025", "odd"), (7, 5, "AUGUST_2026", "06-08-2026")}


def test_upserts_are_guarded(make, spark):
    t = make(row(1), row(2, sync_id=None)).withColumn("server_rev", F.lit(5).cast("bigint"))
    new = spark.createDataFrame([("s1", "X", 6, 5), ("s9", "Y", 7, 0)], "sync_id string, name string, server_rev long, seen long")
    got = {r["sync_id"]: (r["name"], r["server_rev"]) for r in U.upsert(t, new, expected="seen").collect()}
    assert got == {"s1": ("X", 6), None: ("ORIG", 5), "s9": ("Y", 7)}
    stale = new.withColumn("seen", F.lit(4).cast("bigint")).filter("sync_id = 's1'")
    assert {r["sync_id"]: r["name"] for r in U.upsert(t, stale, expected="seen").collect()} == {"s1": "ORIG", None: "ORIG"}


def test_checksum_tells_changes_and_repeats(make):
    a, b, c = make(row(1), row(2)), make(row(2), row(1)), make(row(1), row(2, name="x"))
    sums = [tuple(L.checksum(t, ["id", "name"]).first()) for t in (a, b, c, a.union(a))]
    assert sums[0] == sums[1] != sums[2] and sums[3][2] == 2 * sums[0][2]
