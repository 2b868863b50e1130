import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import names as N

GIVEN = [("Tarendra", "Taru"), ("Tarindra", "Taru"), ("Minula", "Minu"), ("Minula", "Guddan"), ("Dalika", "Guddan"), ("Rupamma", "Rupu"), ("Nimansh", "Nimu"), ("Eklendra", None)]
SCHEMA = "id long, name string, phone string, key string, buyer string, n string"


def buyers(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)
    given_names = spark.createDataFrame(GIVEN, "formal string, short_form string")
    return N.same_buyer(df, given_names, **kw)


def groups(spark, rows, **kw):
    out = {}
    for r in buyers(spark, rows, **kw).collect():
        out.setdefault(r["buyer"], set()).add(r["id"])
    return sorted(map(sorted, out.values()))


def plain_distance(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


words = st.text("abc", max_size=7)


@settings(max_examples=300, deadline=None)
@given(st.sets(words, max_size=25), words, st.integers(0, 3))
def test_automaton_against_plain_distance(vocabulary, word, most):
    want = sorted((w, d) for w in vocabulary if (d := plain_distance(w, word)) <= most)
    assert sorted(N.Trie(vocabulary).neighbours(word, most)) == want
    assert all(N.distance(w, word, most) == min(plain_distance(w, word), most + 1) for w in vocabulary)


P = "5123456789"


@pytest.mark.parametrize(
    "spellings",
    [
        ["Minula Dhorajun", "DHORAJUN, MINULA", "Mrs. M. Dhorajun", "Minu Dhorajun", "Guddan  Dhorajun", "Mniula Dhorajun", "minula do rajun"[:6] + " dhorajn", "Minulabhai Dhorajun", "minuladhorajun", "Minula Dh.", "Minula", "Minula Rupamma Dhorajun", "Minula Dhorajun (self)"],
        ["M/s. Shree Suryoda Enterprises & Sons", "suryoda entp", "Messrs Shri Suryodaa Ent., main rd", "SH. SURYODA ENTERPRISE"],
    ],
)
def test_one_buyer(spark, spellings):
    assert groups(spark, [(i, s, P) for i, s in enumerate(spellings, 1)]) == [list(range(1, len(spellings) + 1))]


def together(keys, counts=None):
    """The forms of one number by buyer, without Spark."""
    which = N.Shard(N.Given([(a, b) for a, b in GIVEN])).resolve(keys, counts or [1] * len(keys))
    out = {}
    for k, w in zip(keys, which, strict=True):
        out.setdefault(w, []).append(k)
    return sorted(map(sorted, out.values()))


def test_a_form_is_compared_with_every_form_of_a_buyer():
    """A third spelling agrees only with the second, which comes after more than twelve ways to write the first."""
    first = [f"{t}minula dhorajun{n}" for t in ("", "mr ", "mrs ", "ms ", "smt ") for n in ("", " (self)", " - old")]
    keys = [*first, "minula dhorjan", "minula dhrjan"]
    assert together(keys, [3] * len(first) + [2, 1]) == [sorted(keys)]


def surnames_agree(a, b):
    if a.surname and b.surname:
        most = min(N.slips(a.surname), N.slips(b.surname))
        return N.sound(a.surname) == N.sound(b.surname) or N.distance(a.surname, b.surname, most) <= most
    for x, y in ((a, b), (b, a)):
        if x.surname and y.surname_cut:
            return x.surname.startswith(y.surname_cut)
    return not (a.surname_cut and b.surname_cut) or a.surname_cut.startswith(b.surname_cut) or b.surname_cut.startswith(a.surname_cut)


def givens_agree(a, b):
    firsts = lambda f: {g[0] for g, c in f.given.items() if c == f.cost()} | ({f.unknown[0]} if f.unknown else set())
    if a.given and b.given:
        return set(a.given) & set(b.given) != set()
    if a.unknown and b.unknown:
        return N.distance(a.unknown, b.unknown, 2) <= max(N.slips(a.unknown), N.slips(b.unknown)) or N.sound(a.unknown) == N.sound(b.unknown)
    if a.given and b.unknown or b.given and a.unknown:
        return False
    for x, y in ((a, b), (b, a)):
        if (x.given or x.unknown) and y.initial:
            return y.initial in firsts(x)
    if a.initial and b.initial:
        return a.initial == b.initial
    return bool(a.surname and b.surname)


def agree(a, b):
    """Pair by pair, without keys and tries; costs aside."""
    if a.firm or b.firm or "text" in (a.reading()[:4], b.reading()[:4]):
        return None
    return surnames_agree(a, b) and givens_agree(a, b)


def test_what_is_asked_for_is_all_that_agrees():
    """Names offered and asked for by key meet exactly if pair by pair they agree."""
    r = random.Random(3)
    surnames = ["dhorajun", "dhorjan", "dhrjan", "jeewan", "jivan", "jiwan", "karpatti", "karpati", "rao", "roa", "dh.", "k.", ""]
    keys = {f"{r.choice(['minula', 'minu', 'm.', 'n.', 'nimansh', 'guddan', 'dalika', 'mniula', 'xqorv', 'xqorw', ''])} {r.choice(surnames)}".strip() for _ in range(900)} - {""}
    given = N.Given(GIVEN)
    forms = [f for k in sorted(keys) if not (f := N.read_name(k, given)).others]
    near = N.Shard.near(forms)
    assert len(forms) > 80
    for a in forms:
        wanted = dict(N.asks(a, near))
        for b in forms:
            met = any(k in wanted for k, _ in N.offers(b))
            if not (a.cost() in (2, 3) or b.cost() in (2, 3)):  # first letters of mistyped names are asked for by all readings
                assert met == bool(agree(a, b)), (a.key, b.key)


@settings(max_examples=400, deadline=None)
@given(st.text("abcdeow", min_size=1, max_size=9), st.lists(st.tuples(st.integers(0, 9), st.sampled_from(["a", "b", "z", "", "swap"])), max_size=2))
def test_words_that_are_neighbours_share_an_address(word, edits):
    other = word
    for at, e in edits:
        at %= len(other) + 1
        other = other[:at] + other[at + 1 : at + 2] + other[at : at + 1] + other[at + 2 :] if e == "swap" else other[:at] + e + other[at + r_drop(e) :]
    if not other:
        return
    for kind in ("surname", "unknown", "core", "lead"):
        if other in N.Neighbours(kind, [other]).of(word):
            assert other == word or N.addresses(kind, word) & N.addresses(kind, other)


def r_drop(e):
    return 0 if e == "a" else 1


def test_firms_of_one_core(spark):
    """Their first words tell them apart, abbreviated or not; a name without a first word goes to the one with more records."""
    rows = [(1, "Star Mehta Traders", P), (2, "Royal Mehta Traders", P), (3, "New Mehta Agencies", P), (4, "N. Mehta Traders", P), (5, "Ryl Mehta trdrs", P), (6, "starr mehta tr. & co", P), (7, "Star Mehta Traders & Co", P), (8, "Mehta Traders", P), (9, "StarMehta Traders", P)]
    assert groups(spark, rows) == [[1, 6, 7, 8, 9], [2, 5], [3, 4]]


def test_given_names_that_the_dictionary_lacks():
    assert together(["john smith", "jon smith", "j. smith", "mary smith", "smith, john"]) == [["j. smith", "john smith", "jon smith", "smith, john"], ["mary smith"]]


def test_trades_are_learnt(spark):
    """From firms known by their marks; a surname that firms bear too isn't one."""
    firms = [(i, f"M/s {a} {b} Creamery & Sons", f"51234567{i:02d}") for i, (a, b) in enumerate(zip("abcdefgh" * 2, ["royal", "star"] * 8, strict=False))]
    people = [(100 + i, f"Minula Dhorajun {x}", f"52234567{i:02d}") for i, x in enumerate("abcdefghijkl")] + [(200 + i, "M/s Ravi Dhorajun & Sons", f"53234567{i:02d}") for i in range(6)]
    rows = [*firms, *people, (300, "Royal Mehta Creamery", P), (301, "royal mehtaa creamery", P), (302, "Star Mehta Creamery", P)]
    forms = spark.createDataFrame([(p, n.lower()) for _, n, p in rows], "phone10 string, key string")
    assert N.learned_trades(forms) == ["creamery"]
    assert [g for g in groups(spark, rows) if max(g) >= 300] == [[300, 301], [302]]


def test_sounds_and_given_names_alone_in_large_numbers():
    others = ["".join(r.choices("bcdfglpstz", k=10)) for r in [random.Random(5)] for _ in range(150)]
    others = [f"tarendra {x}" for x in others]
    for few in (["minula jeewan", "minula jivan"], ["minula jivan", "minula jeewan"], ["minula", "m. dhorajun"]):
        assert sorted(few) in together([*few, *others], [3, 2] + [1] * len(others)) and sorted(few) in together(few)


def test_households_firms_and_strangers(spark):
    rows = [
        (1, "Minula Dhorajun", P), (2, "Nimansh Dhorajun", P), (3, "Nimu Dhorajun", P), (4, "M. Dhorajun", P), (5, "New Dhorajun Traders", P), (6, "Tarendra Karpatti", P), (7, "Tarindra Karpatti", P), (8, "Minula Dhorajun", "5999999999"), (9, "minula dhorajun", "+91 59999 99999"),
    ]
    assert groups(spark, rows) == [[1, 4], [2, 3], [5], [6], [7], [8, 9]]


def test_numbers_in_any_form_and_those_left_out(spark):
    forms = [P, "+91 51234 56789", "0091 5123456789", "05123456789", "(0)5123456789", "5123456789.0", "Mob: 5123456789", " 5123 456 789 ", "+91-512-345-6789"]
    rows = [(i, f"Minula Dhorajun{' ' * i}.", p) for i, p in enumerate(forms, 1)]
    out = [(50, None, P), (51, "Minula Dhorajun", None), (52, "Minula Dhorajun", "512345678"), (53, "Minula Dhorajun", "+91 44177 00880"), (None, "Minula Dhorajun", P), (54, "Minula Dhorajun", "")]
    assert groups(spark, rows + out) == [list(range(1, 10))]


def test_slips_of_the_number(spark):
    rows = [(1, "Minula Dhorajun", P), (2, "M. Dhorajun", "5123456788"), (3, "Nimansh Dhorajun", "5123456798"), (4, "minu dhorajun", "5123465789"), (5, "Minula Dhorajun", "5123456000"), (6, "Minula Karpatti", "5123456780")]
    assert groups(spark, rows) == [[1, 2, 4], [3], [5], [6]]


def test_slips_of_the_number_by_any_form(spark):
    """The third spelling agrees only with one that is neither its buyer's longest nor commonest."""
    rows = [*((i, "Minula Dhorajun", P) for i in range(1, 6)), (6, "Minula Dhorjan", P), (7, "Minula Dhrjan", "5123456788"), (8, "M. Dhorjan", P), (9, "Minakshi Dhorjan", "5123456780")]
    assert groups(spark, rows) == [[1, 2, 3, 4, 5, 6, 7, 8], [9]]


def test_every_slip_and_no_other(spark):
    """All neighbours of numbers with repeated and leading digits, found by one buyer's name."""
    for number in ("0012334555", "9" * 10, "5120000001"):
        slips = {number[:i] + d + number[i + 1 :] for i in range(10) for d in "0123456789"} | {number[:i] + number[i + 1] + number[i] + number[i + 2 :] for i in range(9)}
        further = {f"{(int(number) + 77_000_077) % 10**10:010d}", number[::-1][:5] + number[:5]} - slips
        rows = [(i, f"Minula Dhorajun {'.' * i}", p) for i, p in enumerate([number, *sorted(slips - {number}), *sorted(further)])]
        linked = next(g for g in groups(spark, rows) if 0 in g)
        assert set(linked) >= set(range(len(slips))) and len(linked) <= len(rows)
        pair = [rows[0], rows[-1]]
        assert len(groups(spark, pair)) == 2


def test_pairs_are_of_differing_texts(spark):
    rows = [(3, "Minula Dhorajun", P), (1, "Minula Dhorajun", P), (2, "MINULA DHORAJUN", P), (7, "", P), (8, " ", P)]
    pairs = sorted(map(tuple, N.variant_pairs(buyers(spark, rows)).collect()))
    assert [p for p in pairs if max(p) < 7] == [(1, 2), (2, 3)]
    blocks = sorted(map(tuple, N.variant_pairs(buyers(spark, rows), block_rows=1).collect()))
    assert blocks == pairs


@pytest.mark.parametrize("block_rows", [1, 4, 1000])
def test_pairs_of_a_large_buyer(spark, block_rows):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", "d"]), r.choice([1, 1, 1, 2, 3])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, name string, buyer long")
    want = sorted((i, j) for i, n, b in rows for j, m, c in rows if i < j and n != m and b == c)
    assert sorted(map(tuple, N.variant_pairs(df, block_rows).collect())) == want


def test_a_number_with_very_many_names_is_split(spark):
    r = random.Random(1)
    surnames = ["".join(r.choices("abcdefghiklmnoprstuvz", k=9)) for _ in range(40)]
    rows = [(i, f"{r.choice(['Minula', 'Minu', 'M.', 'Nimansh', 'Nimu', 'Dalika', 'Eklendra', 'eklnedra'])} {r.choice(surnames)}", P) for i in range(1, 400)]
    whole, split = groups(spark, rows), groups(spark, rows, shard_forms=10)
    assert split == whole


def test_a_number_resolved_by_joins_is_as_in_memory(spark):
    """Persons, firms, initials, cut words, names alone and unreadable ones, mistyped in every way."""
    r = random.Random(9)

    def typo(s):
        at = r.randrange(len(s))
        return r.choice([s, s, s[:at] + s[at + 1 :], s[:at] + s[at : at + 2][::-1] + s[at + 2 :], s[:at] + r.choice("aeiouv") + s[at + 1 :]])

    first = ["minula", "minu", "m.", "nimansh", "nimu", "n", "dalika", "guddan", "tarendra", "tarindra", "taru", "john", "jon", "eklendra", "x.", ""]
    last = ["dhorajun", "dhorjan", "karpatti", "karpati", "jeewan", "jivan", "rao", "dh.", "k.", ""]
    firm = ["star suryoda traders", "suryoda traders", "royal suryoda furniture & co", "ryl suryoda furn.", "star ekdantra trdrs", "sai ram stores", "shree sai ram stores"]
    rows = []
    for i in range(500):
        a, b = r.choice(first), r.choice(last)
        name = typo(r.choice(firm)) if r.random() < 0.2 else f"{typo(a) if len(a) > 3 else a} {typo(b) if len(b) > 3 else b}".strip()
        rows.append((i + 1, r.choice([name, name.title(), f"{b}, {a}" if a and b else name, "!" * r.randrange(3)] if r.random() < 0.3 else [name]), P))
    whole, split = groups(spark, rows), groups(spark, rows, shard_forms=2)
    assert split == whole and len(whole) > 20


def test_parts_of_a_number_meet_in_any_spelling(spark):
    """Forms mistyped at their beginnings, given names alone, short forms of two names: as if the number weren't split."""
    rows = [
        (1, "Minula Dhorajun", P), (2, "Imnula Hdorajun", P), (3, "inula horajun", P), (4, "Minula", P), (5, "Guddan Dhorajun", P), (6, "minuladhorajun", P), (7, "M. Dhorajun", P), (8, "Dalika Dhorajun", P), (9, "Dalika Dhorajun.", P), (10, "Tarendra Karpatti", P), (11, "Suryoda Traders", P), (12, "usryoda trdrs", P),
    ]
    whole, split = groups(spark, rows), groups(spark, rows, shard_forms=2)
    assert split == whole
    assert [1, 2, 3, 4, 6, 7] == [i for i in next(g for g in split if 1 in g) if i != 5]
    assert [8, 9] == [i for i in next(g for g in split if 8 in g) if i != 5]
    assert [10] in split and [11, 12] in split and [g for g in whole if 10 in g or 11 in g] == [[10], [11, 12]]


def test_nothing_and_long_names(spark):
    assert groups(spark, []) == []
    assert groups(spark, [(1, "x" * 20_000, P), (2, "!!!", P), (3, "\u0001", P)]) == [[1], [2], [3]]


def test_large_dictionaries_are_refused(spark):
    with pytest.raises(ValueError, match="too large"):
        buyers(spark, [], most_given=2)
