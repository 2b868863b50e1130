import base64
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.packing import container_fill, pack, sum_of_squares
from ledgerloom.llm.splitting import Splitter, split_long
from ledgerloom.llm.tokens import PATTERN, VOCABULARY, encoder, token_counts, token_ids

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def plain():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


pieces = st.sampled_from(["don't", "'s", "'ll", " ", "  ", "\n", "\n\n", "\t", "\xa0", " ", "　", "\x1c", "की", "डिलीवरी", "🙏🙏", "a", "Zq", "12", "९", "!?", "'", "’", "<|endoftext|>", "VELTROLEDTVS-300", "é", "‍", "中文", "...", "\r\n", "\x85", "ſ", "x" * 30])


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, max_size=40), st.integers(1, 60))
def test_fragments_encode_as_the_whole(plain, parts, size):
    text = "".join(parts)
    e = encoder(VOCABULARY)
    assert "".join(e.fragments(text, size)) == text
    assert e.encode(text, size).tolist() == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200), st.integers(1, 20))
def test_any_text(plain, text, size):
    text = text.encode("utf-8", "ignore").decode()
    assert encoder(VOCABULARY).encode(text, size).tolist() == plain(text)


def test_cuts_are_between_tokens():
    e = encoder(VOCABULARY)
    data = ("The serial number on the carton. की डिलीवरी " * 50).encode()
    ends = set(np.cumsum(e.lengths[e.encode(data.decode())]).tolist())
    cuts = e.certain_cuts(data).tolist()
    assert len(cuts) > 200 and set(cuts) <= ends


def test_rows_of_every_kind(spark, plain):
    texts = [None, "", " ", "hello", "hello", "x" * 200_000, "a b " * 50_000, "<|endoftext|>"]
    df = spark.createDataFrame([(i if i < 7 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = token_ids(df).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in rows if r["doc_id"] is not None) == [(i, plain(t) if t else []) for i, t in enumerate(texts[:7])]
    assert [r["ids"] for r in rows if r["doc_id"] is None] == [plain(texts[7])]
    assert sorted(r["tokens"] for r in token_counts(df).collect()) == sorted(len(plain(t)) if t else 0 for t in texts)
    assert token_ids(df.limit(0)).count() == 0


def squares_by_force(sizes, capacity):
    """Every choice tried, the whole sum worked out each time."""
    gaps, out = [], []
    for s in sizes:
        def total(g):
            return sum(n * n for n in np.unique([x for x in g if 0 < x < capacity], return_counts=True)[1].tolist())

        options = [(total([*gaps[:i], g - s, *gaps[i + 1 :]]), g - s, i) for i, g in enumerate(gaps) if g >= s]
        best = min(options, default=None, key=lambda x: x[:2])
        new = total([*gaps, capacity - s])
        if best and best[0] <= new:
            gaps[best[2]] -= s
            out.append(best[1])
        else:
            gaps.append(capacity - s)
            out.append(capacity - s)
    return out, len(gaps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=30))
def test_sum_of_squares_against_every_choice(sizes):
    bins = sum_of_squares(np.array(sizes, np.int64), 12)
    filled, gaps = {}, []
    for s, b in zip(sizes, bins.tolist()):
        filled[b] = filled.get(b, 0) + s
        gaps.append(12 - filled[b])
    assert (gaps, len(filled)) == squares_by_force(sizes, 12)
    assert all(v <= 12 for v in filled.values())


def first_fit(sizes, capacity):
    """Bins that first fit takes, largest items first; parts of full size beside."""
    room, full = [], sum(s // capacity for s in sizes)
    for s in sorted((s % capacity for s in sizes if s % capacity), reverse=True):
        i = next((i for i, g in enumerate(room) if g >= s), None)
        if i is None:
            room.append(capacity - s)
        else:
            room[i] -= s
    return len(room) + full


def test_packing_keeps_items_whole(spark):
    r = random.Random(1)
    sizes = [r.choice([0, None, 5, 100, 100, 700, 2048, 2049, 5000, r.randrange(1, 2000)]) for _ in range(3000)]
    df = spark.createDataFrame([(i // 2, s, "clash") for i, s in enumerate(sizes)], "doc_id long, tokens int, bin string")
    for shard_items in (10_000, 500):
        rows = pack(df, shard_items=shard_items).collect()
        fill = {}
        for x in rows:
            fill[x["shard"], x["bin"]] = fill.get((x["shard"], x["bin"]), 0) + x["tokens"]
        assert max(fill.values()) <= 2048 and sum(fill.values()) == sum(s or 0 for s in sizes)
        assert len(fill) <= first_fit([s for s in sizes if s], 2048) * 1.01 + 3 * -(-3000 // shard_items)
        assert sum(x["tokens"] for x in container_fill(pack(df, shard_items=shard_items)).collect()) == sum(fill.values())
    assert pack(df.limit(0)).count() == 0


def test_parts_of_large_items(spark):
    rows = pack(spark.createDataFrame([(1, 5000), (2, 4096), (3, 2048)], "doc_id long, tokens int")).collect()
    assert sorted((x["doc_id"], x["part"], x["tokens"]) for x in rows) == [(1, 0, 2048), (1, 1, 2048), (1, 2, 904), (2, 0, 2048), (2, 1, 2048), (3, 0, 2048)]


SENTENCES = ["The unit was handed over.", "Who keeps the original?", "यह डिलीवरी कल होगी।", "Total 14,670.00 in down payments!", "(Ask Port Calden.)", "DO123 🙏 done", "VELTROLEDTVS-300कीडिलीवरी"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(SENTENCES), st.sampled_from([" ", "\n", "\n\n", "\n\n\n", "\r\n", ""])), min_size=1, max_size=80), st.sampled_from([(32, 4), (64, 16), (40, 0), (48, 8)]))
def test_pieces(plain, parts, size):
    text, (limit, overlap) = "".join(a + b for a, b in parts), size
    ids = plain(text)
    found = Splitter(encoder(VOCABULARY), limit, overlap).pieces(text)
    if len(ids) <= limit:
        assert found == []
        return
    assert found[0][0] == 0 and found[-1][1] == len(ids)
    assert all(b[0] == a[1] - overlap and b[1] > a[1] for a, b in zip(found, found[1:]))
    assert all(0 < b - a <= limit for a, b, _, _ in found)
    if overlap == 0:
        assert "".join(t for *_, t in found) == text


def test_natural_boundaries_come_first():
    e = encoder(VOCABULARY)
    paragraph = "The unit was handed over with the card. " * 12
    text = (paragraph.strip() + "\n\n") * 40
    found = Splitter(e, 256, 16).pieces(text)
    assert {k for _, _, k, _ in found[:-1]} == {"paragraph"}
    long = Splitter(e, 256, 16).pieces("word " * 3000)
    assert {k for _, _, k, _ in long[:-1]} == {"word"}
    assert {k for _, _, k, _ in Splitter(e, 256, 16).pieces("की" * 3000)[:-1]} == {"character"}
    assert all(len(e.encode(t)) <= 256 for *_, t in (*found, *long))


def test_split_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "short", "x"), (4, "word " * 3000, "x"), (4, "word " * 3000, "x")], "doc_id long, text string, piece string")
    rows = split_long(df).collect()
    assert {r["doc_id"] for r in rows} == {4} and sum(r["piece"] == 0 for r in rows) == 2
    assert split_long(df.limit(0)).count() == 0


def test_characters_of_three_tokens(plain):
    """Whole characters at both ends of an overlap never meet: pieces still stay within the limit and cover all."""
    text = "\u9f98\u9f99\u9f9a\u9f9b" * 700
    found = Splitter(encoder(VOCABULARY)).pieces(text)
    assert found[0][0] == 0 and found[-1][1] == len(plain(text)) and all(b[0] == a[1] - 64 for a, b in zip(found, found[1:], strict=False))
    assert all(len(plain(p[3])) <= 1024 for p in found)


def test_short_texts_are_cut_at_certain_places_too(plain):
    text = "Delivery order 25 of Minula, 14,500.00 paid; balance nil.\n" * 8
    e = encoder(VOCABULARY)
    assert len(list(e.fragments(text))) > 1 and e.encode(text).tolist() == plain(text)
