import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import extract as X
from ledgerloom.functions import values as V


def over(spark, texts, expr, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    return [r["v"] for r in df.select("i", expr(F.col("t")).alias("v")).orderBy("i").collect()]


def test_dates(spark):
    texts = ["05-08-2026", "5-8-2026", "05/08/2026", "2026-08-05", "2026-08-05 00:00:00", "31-02-2026", "", None, "garbage", "05-08-26"]
    good = "05-08-2026"
    assert over(spark, texts, V.normalise_date) == [good, good, good, good, good, "31-02-2026", "", "", "garbage", "05-08-26"]
    assert over(spark, texts, V.month_of) == ["AUGUST_2026"] * 5 + [""] * 5


def test_amounts(spark):
    texts = ["1,250", "", None, " 12.5 ", "12abc", "12d", "nan", "0", "-3", "1e3"]
    assert over(spark, texts, V.amount) == [1250.0, 0, 0, 12.5, 0, 0, 0, 0, -3.0, 1000.0]
    assert over(spark, texts, V.numeric_prefix) == [1250.0, 0, None, 12.5, 12.0, 12.0, 0, 0, -3.0, 1000.0]
    assert over(spark, ["1234.5", "x", None], V.format_amount) == ["1,234.50", "x", ""]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6).map(lambda x: round(x, 3)), min_size=20, max_size=50))
def test_rounding_is_by_the_binary_value(spark, xs):
    assert over(spark, xs + [0.125, 2.675, 1.005], V.round2, "double") == [round(x, 2) + 0.0 for x in xs] + [0.12, 2.67, 1.0]


def test_texts(spark):
    assert over(spark, ["  inv-1 \t x ", None, ""], V.norm_text) == ["INV-1 X", "", ""]
    assert over(spark, ["26A09", "x", None, "9" * 30], V.trailing_number) == [9, 0, 0, int("9" * 30)]
    assert over(spark, ["AUGUST_2026", "odd_key"], V.month_label) == ["Aug 2026", "Odd Key"]
    assert over(spark, ["o'x", None], V.sql_literal) == ["'o''x'", "NULL"]
    assert over(spark, ["none", "", None, "2026"], V.as_deleted) == [None, None, None, "2026"]
    assert over(spark, ['["a","b"]', "bad", None], V.json_list) == [["a", "b"], [], []]
    assert over(spark, [5, 99, 100], V.padded_counter, "int") == ["05", "99", "100"]


def test_parts_ages_months(spark):
    assert [r and tuple(r) for r in over(spark, ["12/4", " 6 / 2 ", "10", "1/2/3", "a/b", None, "3/-5", "9" * 20 + "/1"], V.two_parts)] == [(12, 4), (6, 2), None, None, None, None, (3, -5), (None, 1)]
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    texts = ["2026-01-01 23:59:30", "2026-01-01 23:58:50", "2026-01-01 21:00:00", "2025-12-30 00:00:00", None]
    assert over(spark, texts, lambda c: V.age(c.cast("timestamp"), now)) == ["just now", "1 minute ago", "3 hours ago", "3 days ago", None]
    assert over(spark, ["2026-12-24"], lambda c: V.first_of_month_after(c.cast("date"), 2).cast("string")) == ["2027-02-01"]
    assert over(spark, ["2026-12-24 01:02:03"], lambda c: V.utc_text(c.cast("timestamp"))) == ["2026-12-24T01:02:03+00:00"]


@pytest.mark.parametrize(("n", "words"), [(0, "zero"), (21, "twenty-one"), (105, "one hundred and five"), (1234, "one thousand, two hundred and thirty-four"), (1_000_001, "one million and one")])
def test_words(n, words):
    assert V.spell(n) == words


def test_amount_words(spark):
    assert over(spark, [None, 21.0], V.amount_words, "double") == [None, "Twenty-One"]


DOCUMENT = """DELIVERY ORDER
Date : 15/09/2024
DO ID : DO123
We confirm that the loan application of Mr/Miss/Mrs. Asha Rao has been approved.
Model
"TV X20",
EAN Number 001
Product Price: 4,293.50
Total EMI (12/4) Rs. 1,250
Net Disbursement\t4,000
Delivery Address : old
Mobile Number : 555
Delivery Address : Plot 1,
 Lane 2 Mobile Number: 9
On the delivery of the product, sign."""


def test_extraction(spark):
    df = X.extract_fields(spark.createDataFrame([(DOCUMENT,), ("",), (None,), ("Model only " * 5000,)], "text string"))
    rows = df.select(*X.PATTERNS, "product", "address", X.missing_fields("name", "price", "mobile").alias("missing")).collect()
    assert rows[0].asDict() == {"name": "Asha Rao", "price": "4,293.50", "mobile": "555", "bid": "DO123", "bid_date": "15/09/2024", "emi": "12", "di": "4000", "scheme": "12/4", "product": "TV X20", "address": "Plot 1, Lane 2", "missing": []}
    for r in rows[1:]:
        assert all(r[c] == "" for c in (*X.PATTERNS, "product", "address")) and r["missing"] == ["name", "price", "mobile"]


def test_addresses_in_any_case(spark):
    from ledgerloom.functions import extract as X

    texts = ["DELIVERY ADDRESS : 12 Main St\nmobile number: 55", "Delivery Address: old\nAddress of the Customer for delivery: 7  Hill\nOn the delivery of the product x", "no label", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r["address"] for r in X.extract_fields(df).collect()] == ["12 Main St", "7 Hill", "", ""]
