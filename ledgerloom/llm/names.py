"""Spellings of one buyer's name linked by a trie join.

Names are sharded by the number they came with.  Each name is read by itself: as a firm by the words of its own, as a person by what may be
the given name and the surname, in whatever order they stand, with initials, cut words, short forms and words run
together.  The words of each shard go into tries, which are traversed with a Levenshtein automaton to enumerate
for each word its neighbours within a bounded distance.  A name is offered under keys made of its own
words and asks for keys made of its words' neighbours, in all orders that may agree; so who agrees is looked up, and no two names
are compared.  Numbers one slip apart are shards to look up in each other as well.

Who is whose is decided by rank: names that tell the whole name first, exactly typed before mistyped, common before rare.
Each follows the best earlier one among those that agree; names that tell less then go to the buyer they agree with
best, of several to the one with more records.  Nothing in this depends on what else stands under the number, or on the order of work, so a
number with very many names is resolved by joins with the same result (``_resolve_large``).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import storage

SHOP_NUMBERS = ("4417700880",)
#: Forms of name under one number beyond which its names are looked up by joins instead of in one task's memory.
SHARD_FORMS = 5000
#: Records of one buyer beyond which the pairs are made in blocks.
BLOCK_ROWS = 500
#: Trade words that may be learnt, and the numbers that a word must have been met under.
MOST_TRADES, LEAST_NUMBERS = 1000, 5

# What stands beside a person's name, what tells that a name is a firm's, and the trades.
TITLES = frozenset("mr mrs ms miss smt shri sri dr kum sh mister".split())
SUFFIXES = ("bhai", "ji")
NOTES = frozenset("self old cust customer new".split())
FIRM_MARKS = frozenset("m/s messrs pvt private ltd limited co company sons agency agencies agcy".split())
TRADES = frozenset(
    "traders trader trading tr mobiles mobile mob enterprises enterprise ent entp furniture furnitures furn electronics electronic elect electr elex appliances appliance appl "
    "stores store pharmacy medicals bakery hardware textiles garments jewellers motors electricals opticals sweets".split()
)
GLUE = frozenset("and the of".split())


class Trie:
    """Words, and for a word those within a number of edits; an exchange of neighbours is one edit."""

    __slots__ = ("root",)

    def __init__(self, words: Iterable[str] = ()):
        self.root: dict = {}
        for w in words:
            self.add(w)

    def add(self, word: str) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = word

    def neighbours(self, word: str, most: int) -> list[tuple[str, int]]:
        """The automaton of ``word`` runs along the trie: its state is the row of edit distances so far, and
        where no entry is within ``most`` the branch ends."""
        out: list[tuple[str, int]] = []
        n, far, letters = len(word), most + 1, set(word)

        def step(c: str, row: list[int], before: list[int] | None, last: str, depth: int) -> list[int] | None:
            """The state after one more letter, in the band that can stay within ``most``; None where it can't."""
            new = [far] * (n + 1)
            if depth <= most:
                new[0] = depth
            least = new[0]
            for i in range(max(1, depth - most), min(n, depth + most) + 1):
                d = row[i - 1]
                w = word[i - 1]
                if w != c:
                    d = 1 + min(d, row[i], new[i - 1])
                    if before is not None and i > 1 and w == last and word[i - 2] == c and before[i - 2] + 1 < d:
                        d = before[i - 2] + 1
                new[i] = d
                if d < least:
                    least = d
            return new if least <= most or min(row) < most else None

        stack = [(self.root, list(range(n + 1)), None, "", 1)]
        while stack:
            node, row, before, last, depth = stack.pop()
            miss: list[int] | None = None  # letters that the word doesn't have all lead to the same state
            missed = False
            for c, child in node.items():
                if c == "":
                    if row[-1] <= most:
                        out.append((child, row[-1]))
                    continue
                if c in letters:
                    new = step(c, row, before, last, depth)
                else:
                    if not missed:
                        miss, missed = step(c, row, before, last, depth), True
                    new = miss
                if new is not None:
                    stack.append((child, new, row, c, depth + 1))
        return out


def distance(a: str, b: str, most: int) -> int:
    """Edits between two words, ``most + 1`` if more than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, w in enumerate(b, 1):
            d = row[j - 1] if c == w else 1 + min(row[j - 1], row[j], new[j - 1])
            if before is not None and j > 1 and c == b[j - 2] and a[i - 2] == w:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most and min(row) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def slips(word: str) -> int:
    """Edits allowed in a word."""
    return 2 if len(word) >= 7 else 1 if len(word) >= 4 else 0


@dataclass(slots=True)
class Form:
    """A name read: as a firm by its own words, as a person by what may be the given name and the surname."""

    key: str
    firm: bool = False
    lead: str = ""  # of a firm's own words the first, if there are several
    core: str = ""  # the others, run together
    words: list[str] = field(default_factory=list)  # full words, in order
    parts: list[str] = field(default_factory=list)  # initials and cut words
    given: dict[str, int] = field(default_factory=dict)  # formal given names it may stand for, with cost
    unknown: str = ""  # a given name that the dictionary doesn't have
    initial: str = ""
    surname: str = ""
    surname_cut: str = ""
    others: list[Form] = field(default_factory=list)  # the same with another word as the given name, where that isn't sure

    def reading(self) -> str:
        """All that is looked at; of a name in which nothing can be read the name itself."""
        if self.firm:
            told = [self.lead, self.core] if self.core else []
        else:
            told = [",".join(f"{g}={c}" for g, c in sorted(self.given.items())), self.unknown, self.initial, self.surname, self.surname_cut]
            told += [o.reading() for o in self.others]
        return f"{'firm' if self.firm else 'person'}|{'|'.join(told)}" if any(told) else f"text|{self.key}"

    def cost(self) -> int:
        return min(self.given.values(), default=0 if self.firm else 9)

    def full(self) -> bool:
        """Whether it tells the whole name: a firm's first word too; one given name and the surname."""
        if self.firm:
            return bool(self.lead and self.core)
        return bool(self.surname) and (self.cost() == 0 or self.cost() == 2 and len(self.given) == 1) and not self.others


def sound(word: str) -> str:
    """A word as it is heard: long vowels, v and w, doubled letters written alike."""
    return re.sub(r"(.)\1", r"\1", word.replace("ee", "i").replace("oo", "u").replace("au", "o").replace("w", "v"))


class Given:
    """Formal given names and their short forms, and the trades."""

    def __init__(self, pairs: Iterable[tuple[str | None, str | None]], trades: Iterable[str] = ()):
        self.formal_of: dict[str, set[str]] = defaultdict(set)
        self.formals: set[str] = set()
        for formal, short in pairs:
            if formal:
                self.formals.add(formal.lower())
                if short:
                    self.formal_of[short.lower()].add(formal.lower())
        self.known = self.formals | set(self.formal_of)
        self.trie = Trie(self.known)
        self.sounds: dict[str, set[str]] = defaultdict(set)
        for w in self.known:
            self.sounds[sound(w)].add(w)
        self._near: dict[str, dict[str, int]] = {}
        self.trades = TRADES | frozenset(trades)
        self.trades |= {v for w in self.trades if len(v := re.sub("[aeiou]", "", w)) >= 5}  # written without vowels
        self.long_trades = Trie(w for w in self.trades | FIRM_MARKS if len(w) >= 6)
        self._trade: dict[tuple[str, int], bool] = {}

    def like_trade(self, word: str, most: int) -> bool:
        """Whether a word is a long firm word or within so many edits of one."""
        if len(word) < 6:
            return False
        if (word, most) not in self._trade:
            if len(self._trade) > 200_000:
                self._trade.clear()
            self._trade[word, most] = bool(self.long_trades.neighbours(word, most))
        return self._trade[word, most]

    def exact(self, word: str) -> dict[str, int]:
        out = {f: 1 for f in self.formal_of.get(word, ())}
        if word in self.formals:
            out[word] = 0
        return out

    def near(self, word: str) -> dict[str, int]:
        """Formal names that a mistyped word may stand for: those that sound alike, and by the dictionary's trie those within
        one edit or, of long words, two."""
        if word not in self._near:
            if len(self._near) > 200_000:
                self._near.clear()
            out: dict[str, int] = {}
            if most := slips(word):
                for w, d in [(w, 1) for w in self.sounds.get(sound(word), ())] + self.trie.neighbours(word, most):
                    for f, c in self.exact(w).items():
                        out[f] = min(out.get(f, 9), c + d + 1)
            self._near[word] = out
        return self._near[word]


_FIRM_WORD = re.compile(r"[a-z]+(?:/[a-z])?")


def read_name(key: str, given: Given) -> Form:
    """A lower-case name with single blanks, read by itself."""
    form = Form(key)
    text = re.sub(r"\([^)]*\)|\s-\s*[a-z]+$", " ", key).replace("*", " ")
    raw = _FIRM_WORD.findall(text)
    mark = lambda w: w in FIRM_MARKS or w in given.trades and len(w) > 2
    marks = {w for w in raw if mark(w)}
    if not marks and len(raw) > 1:
        marks = {w for w in raw if given.like_trade(w, 1)}
    if marks and len(raw) > 1:
        words = [w for w in _FIRM_WORD.findall(text.split(",")[0]) if w not in GLUE]
        tells = lambda w, at: w in marks or w in FIRM_MARKS or at and (w in given.trades or given.like_trade(w, 2))
        while words and words[0] in FIRM_MARKS:
            del words[0]
        end = next((i for i, w in enumerate(words) if tells(w, i)), len(words))
        own = words[:end] or [w for i, w in enumerate(words) if not tells(w, i)] or words
        form.firm, form.lead, form.core = True, own[0] if len(own) > 1 else "", "".join(own[1:] or own)
        return form
    before, comma, after = text.partition(",")
    ordered = f"{after} {before}" if comma else text
    words = []
    for w, dot in re.findall(r"([^\W\d_]+)(\.?)", ordered):
        if w in TITLES or w in NOTES or w in SUFFIXES and words:
            continue
        for s in SUFFIXES:
            if w.endswith(s) and len(w) > len(s) + 3 and w not in given.known:
                stem = w[: -len(s)]
                if s == "bhai" or stem in given.known or not given.near(w) and given.near(stem):
                    w = stem
                    break
        words.append((w, bool(dot)))
    for w, dot in words:
        (form.parts if len(w) == 1 or dot and len(w) <= 3 else form.words).append(w)
    _assign(form, given)
    return form


def _assign(form: Form, given: Given) -> None:
    """Finds which word is the given name, in whatever order they stand."""
    words = form.words
    if len(words) == 1 and not form.parts and len(words[0]) >= 9 and not given.exact(words[0]):  # run together?
        w = words[0]
        for k in range(len(w) - 4, 3, -1):
            for g, s in ((w[:k], w[k:]), (w[-k:], w[:-k])):
                if given.exact(g) and len(s) >= 4:
                    form.given, form.surname = given.exact(g), s
                    return
        for k in range(min(len(w) - 4, 12), 4, -1):
            for g, s in ((w[:k], w[k:]), (w[-k:], w[:-k])):
                if len(s) >= 5 and (near := given.near(g)):
                    form.given, form.surname = near, s
                    return

    def taken(g: int, reading: dict[str, int], into: Form) -> None:
        into.given, rest = reading, [w for i, w in enumerate(words) if i != g]
        if rest:
            into.surname = ([w for w in rest if not given.exact(w)] or rest)[-1]
        elif form.parts:
            into.surname_cut = form.parts[-1]

    exact = [i for i, w in enumerate(words) if given.exact(w)]
    if exact:  # a given name stands before a middle one
        taken(exact[0], given.exact(words[exact[0]]), form)
        return
    can = sorted((min(r.values()), i) for i, w in enumerate(words) if (r := given.near(w)))
    sure = bool(can) and (can[0][0] <= 2 or len(words) > 1)
    if sure:
        taken(can[0][1], given.near(words[can[0][1]]), form)
    for _, i in can[sure:]:
        form.others.append(Form(form.key))
        taken(i, given.near(words[i]), form.others[-1])
    if sure:
        pass
    elif words:
        form.surname = words[-1] if len(words) == 1 or form.parts else max(words, key=len)
        rest = [w for w in words if w != form.surname]
        if form.parts:
            form.initial = form.parts[0][0]
        elif rest:
            form.unknown = rest[0]
    elif form.parts:
        form.initial = form.parts[0][0]
        form.surname_cut = form.parts[-1] if len(form.parts) > 1 else ""


# Which words may stand for one another: (kind of word, word), kinds being surname, unknown (given name), core and lead (of a firm).


def vocabulary(form: Form) -> set[tuple[str, str]]:
    """The words whose neighbours a form asks for."""
    if form.firm:
        return {("core", form.core), ("core", form.lead + form.core), ("lead", form.lead)} - {("core", ""), ("lead", "")}
    return ({("surname", form.surname), ("unknown", form.unknown)} | {w for o in form.others for w in vocabulary(o)}) - {("surname", ""), ("unknown", "")}


def short_for(short: str, long: str) -> bool:
    """Whether a few letters are a longer word's in order, the first one first."""
    if not (0 < len(short) <= 3 and len(short) < len(long) and short[0] == long[0]):
        return False
    rest = iter(long)
    return all(c in rest for c in short)


class Neighbours:
    """The words of one kind that stand in a shard, in a trie by letters and one by sound."""

    def __init__(self, kind: str, words: Iterable[str]):
        self.kind, self.letters = kind, Trie(words := set(words))
        self.heard: dict[str, set[str]] = defaultdict(set)
        for w in words:
            self.heard[sound(w)].add(w)
        self.sounds = Trie(self.heard) if kind == "core" else None
        self.by_first: dict[str, list[str]] = defaultdict(list)
        if kind == "lead":
            for w in words:
                self.by_first[w[0]].append(w)
        self.found: dict[str, dict[str, int]] = {}

    def of(self, word: str) -> dict[str, int]:
        """The words that may stand for one, with their cost."""
        if word in self.found:
            return self.found[word]
        out = {w: 1 for w in self.heard.get(sound(word), ())} | {word: 0}
        if self.kind == "core":
            near = self.letters.neighbours(word, 2) + [(w, d) for s, d in self.sounds.neighbours(sound(word), 2) for w in self.heard[s]]
            fits = lambda w, d: d <= (2 if (n := min(len(w), len(word))) >= 6 else n >= 3)
        elif self.kind == "lead":
            short = lambda w: short_for(w, word) or short_for(word, w) or short_for(sound(w), sound(word)) or short_for(sound(word), sound(w))
            near = self.letters.neighbours(word, 1) + [(w, 1) for w in self.by_first.get(word[0], ()) if short(w)]
            fits = lambda w, d: min(len(w), len(word)) >= 3 or short(w)
        else:
            longer = max if self.kind == "unknown" else min
            near = self.letters.neighbours(word, 2 if self.kind == "unknown" else slips(word))
            fits = lambda w, d: d <= longer(slips(w), slips(word))
        for w, d in near:
            if fits(w, d):
                out[w] = min(out.get(w, 9), d)
        self.found[word] = out
        return out


def addresses(kind: str, word: str) -> set[str]:
    """Where a word lies when a vocabulary is spread: neighbours share an address.  Two edits leave two of the first four
    letters beside one another in order or exchanged, one edit two of three."""
    out = set()
    for w in {word, sound(word)}:
        first = w[:4]
        out |= {"".join(sorted((x, y))) for i, x in enumerate(first) for y in first[i + 1 :]}
        if len(w) <= 3 or kind == "lead":
            out |= set(w[:3])
    return out


Keys = list[tuple[str, int]]


def offers(f: Form, full: bool = False) -> Keys:
    """The keys under which a form is found, and what its own reading costs; ``full``: only those that forms telling the whole
    name ask for."""
    if f.firm:
        whole = [(f"W|{f.lead}{f.core}", 0)] if len(f.lead) > 2 else []
        return [(f"F|{f.core}|{f.lead}", 0), (f"F|{f.core}|*", 0), *whole] if f.core else []
    given = [(f"G:{g}", c) for g, c in f.given.items()]
    if full:
        return [(f"S:{f.surname}|{g}", c) for g, c in given]
    given += [(f"H:{x}", 0) for x in {w[0] for w in (*(g for g, c in f.given.items() if c == f.cost()), f.unknown) if w}]
    given += [(f"U:{f.unknown}", 0)] if f.unknown else [(f"I:{f.initial}", 0)] if f.initial else []
    if not given and not f.surname:
        return []
    beside = [f"P:{f.surname[:n]}" for n in (1, 2, 3)] if f.surname else [f"C:{f.surname_cut}", *(f"D:{f.surname_cut[:n]}" for n in range(1, len(f.surname_cut) + 1))] if f.surname_cut else ["N"]
    out = {(f"{s}|{g}", c) for s in (*beside, "*") for g, c in given}
    if f.surname:
        out |= {(f"S:{f.surname}|{g}", c) for g, c in (*given, ("any", 0) if given else ("A", 0))}
    return sorted(out)


#: What two forms that share a given name may cost together.
MOST_COST = 6


def asks(f: Form, near: dict[str, dict[str, dict[str, int]]], full: bool = False) -> Keys:
    """The keys under which all forms stand that agree with this one, and the cost; ``near``: neighbours by kind and word.  ``full``:
    only of forms that tell the whole name, as this one does."""
    if f.firm:
        if not f.core:
            return []
        cores = near["core"][f.core].items()
        if full:
            return [(f"F|{c}|{x}", d + e) for c, d in cores for x, e in near["lead"][f.lead].items()] + _joined(f, near)
        return [(f"F|{c}|*", d + 2) for c, d in cores] + _joined(f, near)
    given = [(f"G:{g}", c) for g, c in f.given.items()]
    if full:
        return [(f"S:{s}|{g}", d + c) for s, d in near["surname"][f.surname].items() for g, c in given]
    given += [(f"U:{u}", 3 if d else 0) for u, d in near["unknown"][f.unknown].items()] if f.unknown else []
    given += [(f"I:{x}", 2) for x in {w[0] for w in (*f.given, f.unknown, f.initial) if w}] + ([(f"H:{f.initial}", 2)] if f.initial else [])
    if f.surname:
        whole = [*given, ("A", 3)] if given else [("any", 3), ("A", 0)]
        out = [(f"S:{s}|{g}", d + c) for s, d in near["surname"][f.surname].items() for g, c in whole]
        beside = [(f"C:{f.surname[:n]}", 1) for n in (1, 2, 3)] + [("N", 2)]
    else:
        out = []
        cut = f.surname_cut
        beside = [(f"P:{cut}", 1), *((f"C:{cut[:n]}", 2) for n in range(1, len(cut) + 1)), (f"D:{cut}", 2), ("N", 2)] if cut else [("*", 2)]
    out += [(f"{s}|{g}", d + c) for s, d in beside for g, c in given]
    best: dict[str, int] = {}
    for k, c in [*out, *(x for o in f.others for x in asks(o, near))]:
        best[k] = min(best.get(k, c), c)
    return list(best.items())


def _joined(f: Form, near: dict[str, dict[str, dict[str, int]]]) -> Keys:
    """A firm's words run together, on either side; a letter or two in front make no other word."""
    whole = [(f"F|{w}|*", d + 2) for w, d in near["core"][f.lead + f.core].items()] if len(f.lead) > 2 else []
    return whole + [(f"W|{w}", d + 2) for w, d in near["core"][f.core].items()]


def _fits(key: str, ask: int, own: int) -> bool:
    return "|G:" not in key or ask + own <= MOST_COST


class Shard:
    """The forms of name under one number, made into buyers."""

    def __init__(self, given: Given):
        self.given = given

    @staticmethod
    def near(forms: Iterable[Form]) -> dict[str, dict[str, dict[str, int]]]:
        """The neighbours of all words of forms by kind and word, by tries of these words."""
        words: dict[str, set[str]] = defaultdict(set)
        for f in forms:
            for kind, w in vocabulary(f):
                words[kind].add(w)
        out = {}
        for kind, ws in words.items():
            of = Neighbours(kind, ws)
            out[kind] = {w: of.of(w) for w in ws}
        return out

    def same(self, a: list[dict], b: list[dict]) -> bool:
        """Whether two numbers' buyers, each of forms ``key, n``, are one."""
        of = {f["key"]: read_name(f["key"], self.given) for side in (a, b) for f in side}
        whole = [[f for f in side if of[f["key"]].full()] for side in (a, b)]
        compared = [[f["key"] for f in side] for side in (whole if all(whole) else (a, b))]
        if all(whole):
            for side, chosen in zip((a, b), compared, strict=True):
                best = max(side, key=lambda f: (len(f["key"]) - 100 * ("." in f["key"]), f["n"], f["key"]))
                chosen += [best["key"], max(side, key=lambda f: (f["n"], f["key"]))["key"]]
        near = self.near(of[k] for side in compared for k in side)
        there: dict[str, int] = {}
        for k in compared[0]:
            for key, c in offers(of[k]):
                there[key] = min(there.get(key, c), c)
        asked = lambda f: asks(f, near, f.full() and all(of[k].full() for k in compared[0]))
        return any(key in there and _fits(key, c, there[key]) for k in dict.fromkeys(compared[1]) for key, c in asked(of[k]))

    def resolve(self, keys: list[str], counts: list[int]) -> list[int]:
        """The number of the buyer of each form."""
        forms = [read_name(k, self.given) for k in keys]
        readings = [f.reading() for f in forms]
        n: dict[str, int] = defaultdict(int)
        for r, c in zip(readings, counts, strict=True):
            n[r] += c
        of = dict(zip(readings, forms, strict=True))
        if len(of) == 1:
            return [0] * len(keys)
        near = self.near(of.values())
        order = sorted(of, key=lambda r: (not of[r].full(), of[r].cost(), -n[r], r))
        whole = [r for r in order if of[r].full()]
        place = {r: i for i, r in enumerate(order)}
        root: dict[str, str] = {}
        there: dict[str, tuple[int, int, str]] = {}
        for r in whole:
            best = min(((c + e[0], e[1], e[2]) for k, c in asks(of[r], near, True) if (e := there.get(k)) and _fits(k, c, e[0])), default=None)
            root[r] = root[best[2]] if best else r
            for k, c in offers(of[r], True):
                if (e := there.get(k)) is None or c < e[0]:  # of equal ones the earlier stays
                    there[k] = (c, place[r], r)
        if len(whole) == len(order):
            number = {b: i for i, b in enumerate(dict.fromkeys(root[r] for r in readings))}
            return [number[root[r]] for r in readings]
        records: dict[str, int] = defaultdict(int)
        for r in whole:
            records[root[r]] += n[r]
        buyers: dict[str, tuple[int, int, int, str]] = {}
        for r in whole:
            b = root[r]
            for k, c in offers(of[r]):
                entry = (c, -records[b], place[b], b)
                if (e := buyers.get(k)) is None or entry < e:
                    buyers[k] = entry
        earlier: dict[str, tuple[int, str]] = {}
        for r in order[len(whole) :]:
            wanted = asks(of[r], near)
            best = min(((c + e[0], *e[1:]) for k, c in wanted if (e := buyers.get(k)) and _fits(k, c, e[0])), default=None)
            if best:
                root[r] = best[3]
            else:
                first = min(((c, *e) for k, c in wanted if (e := earlier.get(k))), default=None)
                root[r] = root[first[2]] if first else r
            for k, _ in offers(of[r]):
                earlier.setdefault(k, (place[r], r))
        number = {b: i for i, b in enumerate(dict.fromkeys(root[r] for r in readings))}
        return [number[root[r]] for r in readings]


def ten_digits(phone: Column) -> Column:
    """The last ten digits of a number in any form; null for one of fewer."""
    digits = F.regexp_replace(F.regexp_replace(phone, r"\.0+\s*$", ""), r"\D", "")
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10)))


def name_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"[\s\p{Z}]+", " "))


def learned_trades(forms: DataFrame, most: int = MOST_TRADES, least: int = LEAST_NUMBERS) -> list[str]:
    """Trade words that ``TRADES`` lacks: they stand last among the own words of firms (known by their marks) of at least
    ``least`` numbers, and at least half the numbers that have the word have it so.  A language has few: of more than ``most`` the commonest
    are taken."""
    words = F.filter(F.split(F.regexp_replace("key", r"\([^)]*\)|[^a-z/ ]", " "), " +"), lambda w: F.length(w) > 0)
    listed = lambda ws: F.array(*(F.lit(w) for w in sorted(ws)))
    marks = listed(FIRM_MARKS | GLUE)
    read = lambda some: some.select("phone10", words.alias("ws")).withColumn("own", F.array_except("ws", marks))
    marked = forms.filter(F.col("key").rlike(rf"(?:^|[^a-z/])(?:{'|'.join(sorted(FIRM_MARKS))})(?:$|[^a-z/])"))
    told = read(marked).filter((F.size("own") > 1) & F.arrays_overlap("ws", listed(FIRM_MARKS)) & ~F.arrays_overlap("ws", listed(TRADES)))
    last = told.select("phone10", F.element_at("own", -1).alias("word")).filter("length(word) > 2")
    found = storage.cut(last.groupBy("word").agg(F.countDistinct("phone10").alias("n")).filter(F.col("n") >= least))
    if found.isEmpty():
        return []
    all_of = read(forms).select("phone10", F.explode("own").alias("word")).join(found.select("word"), "word", "left_semi").groupBy("word").agg(F.countDistinct("phone10").alias("all"))
    own = found.join(all_of, "word").filter(F.col("n") * 2 >= F.col("all"))
    return [r["word"] for r in own.orderBy(F.desc("n"), "word").limit(most).collect()]


def _rows(columns: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    values = zip(*rows, strict=True) if rows else ((),) * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(values, columns, strict=True)], [n for n, _ in columns])


def _resolve_large(forms: DataFrame, pairs: list[tuple], trades: list[str]) -> DataFrame:
    """``(phone10, key, entity, n)``: what ``Shard.resolve`` gives, by joins.

    The words of a number are spread by ``addresses``; within each a trie tells which are neighbours.  Offers and asks of
    all names, each a row a key, meet by key; a running minimum in order of rank, or a grouped one, keeps of each key the one
    best offer, so no pairs are made.
    """
    given = lambda: Given(pairs, trades)
    text, number, short = pa.string(), pa.int64(), pa.int32()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = given()
        for b in batches:
            out = [(*r, f.reading(), f.full(), f.cost()) for r in zip(*(b[c].to_pylist() for c in ("phone10", "key", "first", "n")), strict=True) for f in [read_name(r[1], g)]]
            yield _rows([("phone10", text), ("key", text), ("first", number), ("n", number), ("reading", text), ("full", pa.bool_()), ("cost", short)], out)

    said = storage.cut(forms.mapInArrow(read, "phone10 string, key string, first bigint, n bigint, reading string, full boolean, cost int"))
    nodes = storage.cut(said.groupBy("phone10", "reading").agg(F.min("first").alias("node"), F.sum("n").alias("n"), F.min("key").alias("key"), F.first("full").alias("full"), F.first("cost").alias("cost")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = given()
        for b in batches:
            out = [(p, k, kind, w) for p, k in zip(b["phone10"].to_pylist(), b["key"].to_pylist(), strict=True) for kind, w in vocabulary(read_name(k, g))]
            yield _rows([("phone10", text), ("key", text), ("kind", text), ("word", text)], out)

    used = storage.cut(nodes.mapInArrow(spread, "phone10 string, key string, kind string, word string"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(p, k, w, a) for p, k, w in zip(*(b[c].to_pylist() for c in ("phone10", "kind", "word")), strict=True) for a in addresses(k, w)]
            yield _rows([("phone10", text), ("kind", text), ("word", text), ("address", text)], out)

    def join_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words = None, []

        def found() -> list[tuple]:
            of = Neighbours(at[1], words)
            return [(at[0], at[1], w, v, d) for w in words for v, d in of.of(w).items()]

        for b in batches:
            out: list[tuple] = []
            for p, k, a, w in zip(*(b[c].to_pylist() for c in ("phone10", "kind", "address", "word")), strict=True):
                if (p, k, a) != at:
                    out += found() if words else []
                    at, words = (p, k, a), []
                words.append(w)
            yield _rows(wide, out)
        yield _rows(wide, found() if words else [])

    wide = [("phone10", text), ("kind", text), ("word", text), ("near", text), ("d", short)]
    by_address = used.select("phone10", "kind", "word").distinct().mapInArrow(placed, "phone10 string, kind string, word string, address string")
    near = by_address.repartition("phone10", "kind", "address").sortWithinPartitions("phone10", "kind", "address").mapInArrow(join_tries, "phone10 string, kind string, word string, near string, d int")
    near = near.groupBy("phone10", "kind", "word", "near").agg(F.min("d").alias("d")).groupBy("phone10", "kind", "word").agg(F.collect_list(F.struct("near", "d")).alias("near"))
    known = used.join(near, ["phone10", "kind", "word"]).groupBy("phone10", "key").agg(F.collect_list(F.struct("kind", "word", "near")).alias("near"))
    nodes = nodes.join(known, ["phone10", "key"], "left")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = given()
        for b in batches:
            out = []
            for p, k, node, full, told in zip(*(b[c].to_pylist() for c in ("phone10", "key", "node", "full", "near")), strict=True):
                f, of = read_name(k, g), defaultdict(dict)
                for x in told or ():
                    of[x["kind"]][x["word"]] = {y["near"]: y["d"] for y in x["near"]}
                out += [(p, node, full, False, key, c) for key, c in offers(f)] + [(p, node, full, True, key, c) for key, c in asks(f, of, full)]
            yield _rows([("phone10", text), ("node", number), ("full", pa.bool_()), ("asks", pa.bool_()), ("at", text), ("c", short)], out)

    rank = F.struct((~F.col("full")).alias("late"), "cost", (-F.col("n")).alias("few"), "reading").alias("rank")
    nodes = nodes.withColumn("rank", rank)
    sent = nodes.select("phone10", "key", "node", "full", "near").mapInArrow(keys, "phone10 string, node bigint, full boolean, asks boolean, at string, c int")
    sent = storage.cut(sent.join(nodes.select("node", "rank"), "node"))
    nodes = storage.cut(nodes.select("phone10", "reading", "node", "n", "full", "rank"))
    fits = lambda ask, own: ~F.contains("at", F.lit("|G:")) | (F.col(ask) + F.col(own) <= MOST_COST)
    # a name's own offers stand behind its asks
    earlier = Window.partitionBy("phone10", "at").orderBy("rank", F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    follow = lambda part, offer: part.withColumn("best", F.min(F.when(~F.col("asks"), offer)).over(earlier)).filter("asks AND best IS NOT NULL")

    def roots(links: DataFrame) -> DataFrame:
        links = storage.cut(links)
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0) if links.isEmpty() else _connected(links)

    asked = follow(sent.filter("full"), F.struct(F.col("c").alias("own"), "rank", "node")).filter(fits("c", "best.own"))
    joined = roots(asked.groupBy(F.col("node").alias("a")).agg(F.min(F.struct(F.col("c") + F.col("best.own"), "best.rank", F.col("best.node").alias("b")))["b"].alias("b")))
    whole = storage.cut(nodes.filter("full").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")))
    heads = whole.groupBy("root").agg(F.sum("n").alias("records"), F.min("rank").alias("head"))
    offered = sent.filter("full AND NOT asks").join(whole.select("node", "root"), "node").join(heads, "root")
    best = offered.groupBy("phone10", "at").agg(F.min(F.struct(F.col("c").alias("own"), (-F.col("records")).alias("few"), "head", "root")).alias("e"))
    found = sent.filter("asks AND NOT full").join(best, ["phone10", "at"]).filter(fits("c", "e.own"))
    found = storage.cut(found.groupBy("node").agg(F.min(F.struct(F.col("c") + F.col("e.own"), "e.few", "e.head", F.col("e.root").alias("root")))["root"].alias("own")))
    asked = follow(sent.filter("NOT full"), F.struct("rank", "node")).join(found, "node", "left_anti")
    joined = roots(asked.groupBy(F.col("node").alias("a")).agg(F.min(F.struct("c", "best.rank", F.col("best.node").alias("b")))["b"].alias("b")))
    less = nodes.filter("NOT full").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")).join(found, "node", "left")
    ends = less.groupBy("root").agg(F.min(F.struct("rank", F.coalesce("own", "node").alias("b")))["b"].alias("end"))
    less = less.join(ends, "root").select("phone10", "reading", "node", F.coalesce("own", "end").alias("root"))
    every = storage.cut(whole.select("phone10", "reading", "node", "root").unionByName(less))
    lowest = every.groupBy("root").agg(F.min("node").alias("entity"))
    return said.join(every.join(lowest, "root").select("phone10", "reading", "entity"), ["phone10", "reading"]).select("phone10", "key", "entity", "n")


def _connected(links: DataFrame) -> DataFrame:
    """``(node, root)``: the lowest node that each node of ``links(a, b)`` is connected with."""
    edges = storage.cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = storage.cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = edges.join(roots, edges["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("least"))
        lower = roots.join(near, roots["node"] == near["a"], "left").select("node", F.least("root", "least").alias("root"), F.col("root").alias("was"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = storage.cut(lower.join(jump, "root", "left").select("node", F.least("root", "further").alias("root"), "was"))
        roots = new.select("node", "root")
        if new.filter("root <> was").isEmpty():
            return roots


def same_buyer(
    records: DataFrame,
    given_names: DataFrame,
    key: str = "id",
    name: str = "name",
    phone: str = "phone",
    shop_numbers: tuple[str, ...] = SHOP_NUMBERS,
    shard_forms: int = SHARD_FORMS,
    most_given: int = 1_000_000,
) -> DataFrame:
    """``(id, name, buyer)``: the records that can be told apart by name and number, each with its buyer.

    ``buyer`` is the lowest id among the buyer's records.  Left out are records of a null id or name, a number that is null, of
    fewer than ten digits, or one of ``shop_numbers`` in any form.  Equal names under one number are one
    form before anything is shuffled.  ``given_names`` (formal, short_form) is a dictionary held in memory; one of
    more than ``most_given`` rows is refused.  The forms of a number are resolved in one task's memory; those of a number with more than
    ``shard_forms`` by joins, with the same result.
    """
    if given_names.count() > most_given:
        raise ValueError("given_names is too large to be held in memory")
    pairs = [(r[0], r[1]) for r in given_names.select("formal", "short_form").distinct().collect()]
    rows = records.select(F.col(key).cast("bigint").alias("id"), F.col(name).alias("name"), ten_digits(F.col(phone)).alias("phone10"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("name").isNotNull() & F.col("phone10").isNotNull() & ~F.col("phone10").isin(*shop_numbers)).withColumn("key", name_key(F.col("name")))
    forms = storage.cut(rows.groupBy("phone10", "key").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    trades = learned_trades(forms)
    columns = [("phone10", pa.string()), ("key", pa.string()), ("entity", pa.int64()), ("n", pa.int64())]

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at, held = Shard(Given(pairs, trades)), None, []
        out: list[tuple] = []

        def buyers() -> None:
            which = shard.resolve([h[1] for h in held], [h[3] for h in held]) if len(held) > 1 else [0]
            lowest: dict[int, int] = {}
            for w, h in zip(which, held, strict=True):
                lowest[w] = min(lowest.get(w, h[2]), h[2])
            out.extend((h[0], h[1], lowest[w], h[3]) for w, h in zip(which, held, strict=True))

        for b in batches:
            for r in zip(*(b[c].to_pylist() for c in ("phone10", "key", "first", "n")), strict=True):
                if r[0] != at:
                    if held:
                        buyers()
                    held, at = [], r[0]
                held.append(r)
            yield _rows(columns, out)
            out.clear()
        if held:
            buyers()
        yield _rows(columns, out)

    large = storage.cut(forms.groupBy("phone10").count().filter(F.col("count") > shard_forms).select("phone10"))
    some = not large.isEmpty()
    small = forms.join(large, "phone10", "left_anti") if some else forms
    resolved = small.repartition("phone10").sortWithinPartitions("phone10", "first").mapInArrow(resolve, "phone10 string, key string, entity bigint, n bigint")
    if some:
        resolved = resolved.unionByName(_resolve_large(forms.join(large, "phone10", "left_semi"), pairs, trades))
    resolved = storage.cut(resolved)
    links = storage.cut(_slip_links(resolved, pairs, trades))
    buyer = resolved.select("phone10", "key", "entity")
    if not links.isEmpty():
        linked = _connected(links)
        buyer = buyer.join(linked.withColumnRenamed("node", "entity"), "entity", "left").select("phone10", "key", F.coalesce("root", "entity").alias("entity"))
    return rows.join(buyer, ["phone10", "key"]).select("id", "name", F.col("entity").alias("buyer"))


def _slip_links(resolved: DataFrame, pairs: list[tuple], trades: list[str]) -> DataFrame:
    """Buyers of numbers one slip apart (one digit wrong, or two neighbours exchanged) whose names agree.

    All forms of the two are compared where one of them never tells the whole name. Else, as under one number, the forms that
    tell it are, and beside these each one's longest and commonest form: a short form of a buyer known in full
    may stand for others too.

    Each number has a key for each digit masked and for each exchange.  At most ten numbers share a key
    of the one kind and two of the other: a key keeps no list but ten bits, the digits (or the two orders) seen
    there.  A number has at most 99 such neighbours.
    """
    p = F.col("phone10").cast("bigint")
    digit = lambda i: F.expr(f"pmod(_p div {10**i}, 10)")
    key = lambda at, n: (at * 32 + n).alias("slip")
    bit = lambda n: F.call_function("shiftleft", F.lit(1), n.cast("int")).alias("bit")
    masked = [F.struct(key(F.col("_p") - digit(i) * 10**i, i), bit(digit(i))) for i in range(10)]
    low, high = (lambda i, f=f: f(digit(i), digit(i + 1)) for f in (F.least, F.greatest))
    swapped = [F.when(digit(i) != digit(i + 1), F.struct(key(F.col("_p") + (high(i) - digit(i)) * 10**i + (low(i) - digit(i + 1)) * 10 ** (i + 1), 16 + i), bit((digit(i) < digit(i + 1)).cast("int")))) for i in range(9)]
    keys = resolved.select("phone10").distinct().select(p.alias("_p")).select(F.explode(F.array(*masked, *swapped)).alias("s")).filter("s IS NOT NULL").select("s.slip", "s.bit")
    shared = keys.groupBy("slip").agg(F.bit_or("bit").alias("bits")).filter(F.bit_count("bits") > 1)
    # the numbers that share a key, from the key and the digits or orders seen
    powers = F.array(*(F.lit(10**i).cast("bigint") for i in range(11)))
    n, at = F.pmod("slip", F.lit(32)), F.expr("slip div 32")
    power = F.element_at(powers, (F.pmod(n, F.lit(16)) + 1).cast("int"))
    digits = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.bit_get(F.col("bits"), d) == 1)
    apart = F.pmod(F.floor(at / power), F.lit(10)) - F.pmod(F.floor(at / (power * 10)), F.lit(10))
    members = F.when(n < 16, F.transform(digits, lambda d: at + d * power)).otherwise(F.array(at, at + apart * 9 * power))
    shared = shared.select(members.alias("all"))
    text = lambda c: F.lpad(F.col(c).cast("string"), 10, "0").alias(c)
    near = shared.select(F.explode("all").alias("p"), "all").select("p", F.explode("all").alias("q")).filter("p < q").distinct().select(text("p"), text("q"))
    near = storage.cut(near)
    beside = near.select(F.explode(F.array("p", "q")).alias("phone10")).distinct()
    form = F.struct("key", "n")
    entities = storage.cut(resolved.join(beside, "phone10", "left_semi").groupBy("phone10", "entity").agg(F.collect_list(form).alias("forms")))
    a, b = (entities.select(F.col("phone10").alias(x), F.col("entity").alias(f"e{x}"), F.col("forms").alias(f"f{x}")) for x in "pq")
    both = near.join(a, "p").join(b, "q").select("ep", "fp", "eq", "fq")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(Given(pairs, trades))
        for batch in batches:
            found = []
            for ep, fp, eq, fq in zip(*(batch[c].to_pylist() for c in ("ep", "fp", "eq", "fq")), strict=True):
                if shard.same(fp, fq):
                    found.append((min(ep, eq), max(ep, eq)))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return both.mapInArrow(compare, "a bigint, b bigint")


def variant_pairs(buyers: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(id_a, id_b)``, the smaller first: records of one buyer whose names differ in any way.

    Records of a buyer with at most ``block_rows`` are paired directly.  Of others the differing names are paired
    first and then laid out by their records, so equal names, however many, cost no comparison; a name with very many
    records is cut into blocks, so its pairs are made by many tasks.
    """
    buyers = storage.cut(buyers.select("id", "name", "buyer"))
    sizes = buyers.groupBy("buyer").agg(F.count("*").alias("n"), (F.min("name") != F.max("name")).alias("varied")).filter("varied")
    rows = buyers.join(sizes, "buyer")
    few = rows.filter(F.col("n") <= block_rows)
    a, b = (few.select("buyer", F.col("id").alias(f"id_{x}"), F.col("name").alias(f"name_{x}")) for x in "ab")
    direct = a.join(b, "buyer").filter("id_a < id_b AND name_a <> name_b").select("id_a", "id_b")
    many = rows.filter(F.col("n") > block_rows).select("buyer", "name", "id")
    if many.isEmpty():
        return direct
    block = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    blocks = lambda n: F.ceil(F.col(n) / block_rows).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    forms = many.groupBy("buyer", "name").agg(F.count("*").alias("m")).select("buyer", "name", blocks("m").alias("parts"))
    spread = forms.join(forms.groupBy("buyer").agg(F.count("*").alias("m")).select("buyer", blocks("m").alias("cuts")), "buyer")
    x = spread.select("buyer", block("name", F.col("cuts")).alias("cut"), F.col("name").alias("name_a"), F.col("parts").alias("parts_a"))
    y = spread.select("buyer", every("cuts").alias("cut"), F.col("name").alias("name_b"), F.col("parts").alias("parts_b"))
    named = x.join(y, ["buyer", "cut"]).filter("name_a < name_b").drop("cut")
    placed = many.join(forms, ["buyer", "name"]).select("buyer", "name", "id", block("id", F.col("parts")).alias("part"))
    ids = {s: placed.select("buyer", F.col("name").alias(f"name_{s}"), F.col("id").alias(f"id_{s}"), "part") for s in "ab"}
    first = named.withColumn("part", every("parts_a")).join(ids["a"], ["buyer", "name_a", "part"]).drop("part")
    both = first.withColumn("part", every("parts_b")).join(ids["b"], ["buyer", "name_b", "part"])
    return direct.unionByName(both.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")))
