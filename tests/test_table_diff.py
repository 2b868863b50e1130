import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators.table_diff import PresenceBitmap, cents_form, table_diff, text_form

SCHEMA = "sync_id string, server_rev long, invoice_no string, price double, _side string, diff string"


def fields():
    return {"server_rev": F.col("server_rev"), "invoice_no": text_form(F.col("invoice_no")), "price": cents_form(F.col("price"))}


def run(spark, a, b, **more):
    frames = [spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA) for rows in (a, b)]
    return sorted(map(tuple, table_diff(*frames, "sync_id", fields(), ["server_rev"], ("a", "b"), **more).collect()))


def test_cases(spark):
    a = [("k1", 1, "INV-1", 10.0), ("k2", 1, None, None), ("k3", 2, " inv ", 5.001), ("k4", None, "", 1.0), (None, 1, "x", 1.0), ("k5", 1, "A", 1.0), ("k5", 1, "A", 1.0)]
    b = [("k1", 2, "inv-1  ", 10.004), ("k2", 1, "", 0.0), ("k3", 2, "INV", 5.0), ("k4", None, None, 1.0), (None, 1, "x", 1.0), ("k6", 1, "B", 1.0)]
    assert run(spark, a, b) == [("k1", "server_rev"), ("k2", "invoice_no"), ("k2", "price"), ("k4", "invoice_no"), ("k5", "only_a"), ("k6", "only_b")]


def test_empty_sides(spark):
    one = [("k", 1, "x", 1.0)]
    assert run(spark, [], []) == []
    assert run(spark, one, []) == [("k", "only_a")]
    assert run(spark, [], one) == [("k", "only_b")]


def test_several_rows_of_a_key_compare_by_the_newest(spark):
    assert run(spark, [("k", 1, "old", 1.0), ("k", 3, "new", 1.0)], [("k", 3, "new", 1.0)]) == []


@pytest.mark.parametrize("bucket_keys", [1, 7, 1 << 15])
def test_against_plain_comparison_with_a_hot_key(spark, bucket_keys):
    r = random.Random(5)
    a, b = ({f"k{r.randrange(400)}": (r.randrange(3), r.choice(["A", "a ", None]), r.choice([1.0, 1.001, None])) for _ in range(300)} for _ in range(2))
    rows = lambda t: [(k, *v) for k, v in t.items()]
    hot = [("hot", 1, "A", 1.0)] * 500
    want = [(k, "only_a") for k in a.keys() - b.keys()] + [(k, "only_b") for k in b.keys() - a.keys()]
    for k in a.keys() & b.keys():
        (r1, i1, p1), (r2, i2, p2) = a[k], b[k]
        same = [r1 == r2, (i1 and i1.strip().lower()) == (i2 and i2.strip().lower()), (p1 and round(p1, 2)) == (p2 and round(p2, 2))]
        want += [(k, f) for f, ok in zip(("server_rev", "invoice_no", "price"), same) if not ok]
    assert run(spark, rows(a) + hot, rows(b) + hot[:3], bucket_keys=bucket_keys) == sorted(want)


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 200_000), max_size=200), st.sets(st.integers(0, 200_000), max_size=200), st.integers(0, 9000), st.integers(0, 9000))
def test_bitmaps(a, b, dense_a, dense_b):
    a, b = a | set(range(dense_a)), b | set(range(dense_b // 2, dense_b))
    x, y = (PresenceBitmap.of(np.array(sorted(s), np.int64)) for s in (a, b))
    assert x.and_not(y).ordinals().tolist() == sorted(a - b)
    assert x.intersect(y).ordinals().tolist() == sorted(a & b)
