import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.copies import CountingTrie, formatting_copies, radix_buckets

SCHEMA = "id long, invoice_no string, serial_no string, bid string, first_id string, copies string, _text string"
FIELDS = ["invoice_no", "serial_no", "bid"]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)
    return sorted(map(tuple, formatting_copies(df, FIELDS, **kw).collect()), key=str)


def test_what_counts_as_alike(spark):
    rows = [
        (1, "INV-01", "sn 5", "DO/7"), (2, "do7", "#inv\xa001.", "SN 5\n"), (3, "INV01", "SN5", None), (4, "inv 01", "", "s-n-5"), (5, "INV01SN5", None, None), (6, None, None, None), (7, " ", "-", "\t"), (8, "ÀB", "x", "y"), (9, "àb", "X", "(y)"), (10, "ΣIGMA", "q", "r"), (11, "σigma", "Q", "R"), (12, "中文。", None, None), (13, "中文", None, None),
    ]
    assert run(spark, rows, least=2) == sorted([(1, 2), (3, 2), (6, 2), (8, 2), (10, 2), (12, 2)], key=str)
    assert len(run(spark, rows)) == 7


def test_null_ids_and_empty_tables(spark):
    assert run(spark, [(None, "a", "b", "c"), (5, "A", "b", "c"), (3, "b", "a", "c")]) == [(3, 3)]
    assert run(spark, [(None, "a", "b", "c")]) == [(None, 1)]
    assert run(spark, []) == []


@pytest.mark.parametrize("bucket_entries", [1, 3, 40, 50_000])
def test_against_plain_grouping(spark, bucket_entries):
    r = random.Random(bucket_entries)
    key = lambda: r.choice(["", "0", "00", "001", "0012", "0013" + str(r.randrange(40)), "x" * 60 + str(r.randrange(30)), "0013", None])
    rows = [(i, key(), key(), key()) for i in range(600)] + [(1000 + i, "HOT", "hot-" + "y" * 5000, "") for i in range(300)]
    groups = defaultdict(list)
    for i, *k in rows:
        groups[tuple(sorted((x or "").lower().replace("-", "") for x in k))].append(i)
    assert run(spark, rows, bucket_entries=bucket_entries) == sorted(((min(g), len(g)) for g in groups.values()), key=str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=200), st.integers(1, 8))
def test_trie_counts(texts, burst):
    trie, want = CountingTrie(burst), defaultdict(int)
    for i, t in enumerate(texts):
        trie.add(t, i, 1)
        want[t] += 1
    assert sorted(trie.terminals()) == sorted((texts.index(t), n) for t, n in want.items())


@pytest.mark.parametrize("literals", [0, 2, 4096])
def test_no_bucket_of_several_strings_is_larger_than_its_limit(spark, literals):
    """However many prefixes must be split, and whether they are literals or a table."""
    r = random.Random(7)
    texts = sorted({"".join(r.choices("ab", k=r.randrange(0, 9))) for _ in range(400)})
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = radix_buckets(rows, "t", 3, literals=literals).collect()
    assert sorted(x["t"] for x in got) == texts and all(x["t"].encode().startswith(bytes(x["_bucket"])) for x in got)
    sizes = defaultdict(list)
    for x in got:
        sizes[bytes(x["_bucket"])].append(x["t"])
    assert all(len(v) <= 3 for v in sizes.values())
