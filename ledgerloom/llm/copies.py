"""Records that are the same but for formatting, by radix partitioning on canonical bytes and tries.

A record's canonical bytes are its key fields without white space, case and punctuation, in sorted
order.  Equal ones are combined in each task before anything is shuffled.  The rest is partitioned by
prefixes: a bucket with too many entries is split by further bytes, again and again, until
each fits or holds one string only.  Each bucket's strings go into a trie whose terminals count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import storage

SEPARATOR = "\x1f"
BUCKET_ENTRIES = 50_000
#: Prefixes of one level that are compared as literals; more are joined as a table.
MOST_LITERALS = 4096
#: Bytes of the first prefixes; each round looks at twice as many.
FIRST = 2


def canonical(fields: list[str]) -> Column:
    """The fields without white space, case and punctuation of any script, in sorted order, as one text."""
    plain = [F.regexp_replace(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))), r"[\p{P}\p{Z}\s\x{0B}\x{1C}-\x{1F}\x{85}]+", "") for f in fields]
    return F.concat_ws(SEPARATOR, F.array_sort(F.array(*plain)))


class CountingTrie:
    """A burst trie: suffixes lie in hash containers that become branching nodes beyond ``burst`` entries."""

    def __init__(self, burst: int = 256):
        self.burst, self.root = burst, _Container()

    def add(self, text: bytes, first: int | None, copies: int) -> None:
        node, parent, at = self.root, None, 0
        while type(node) is _Branch:
            if at == len(text):
                node.terminal = _merged(node.terminal, first, copies)
                return
            parent, node = node, node.children.get(text[at])
            if node is None:
                node = parent.children[text[at]] = _Container()
            at += 1
        rest = text[at:]
        node.suffixes[rest] = _merged(node.suffixes.get(rest), first, copies)
        if len(node.suffixes) > self.burst:
            branch = _Branch()
            for suffix, terminal in node.suffixes.items():
                if suffix:
                    child = branch.children.get(suffix[0])
                    if child is None:
                        child = branch.children[suffix[0]] = _Container()
                    child.suffixes[suffix[1:]] = terminal
                else:
                    branch.terminal = terminal
            if parent is None:
                self.root = branch
            else:
                parent.children[text[at - 1]] = branch

    def terminals(self) -> Iterator[tuple[int | None, int]]:
        """(first id, copies) of each string."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if type(node) is _Branch:
                if node.terminal is not None:
                    yield node.terminal
                stack.extend(node.children.values())
            else:
                yield from node.suffixes.values()


class _Container:
    __slots__ = ("suffixes",)

    def __init__(self) -> None:
        self.suffixes: dict[bytes, tuple[int | None, int]] = {}


class _Branch:
    __slots__ = ("children", "terminal")

    def __init__(self) -> None:
        self.children: dict[int, _Branch | _Container] = {}
        self.terminal: tuple[int | None, int] | None = None


def _merged(old: tuple[int | None, int] | None, first: int | None, copies: int) -> tuple[int | None, int]:
    if old is None:
        return first, copies
    return (first if old[0] is None else old[0] if first is None else min(old[0], first)), old[1] + copies


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal strings of some 2^17 rows made one: of the ids the lowest, and the number."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).group_by("_text").aggregate([("_id", "min"), ("_id", "count"), ("_one", "sum")])
        yield from pa.table({"_text": t["_text"], "_first": t["_id_min"], "_copies": t["_one_sum"]}).to_batches()

    for b in batches:
        held.append(b.append_column("_one", pa.array(pc.if_else(pc.is_null(b["_text"]), 1, 1), pa.int64())))
        rows += b.num_rows
        if rows >= 1 << 17:
            yield from flush()
            held, rows = [], 0
    if held:
        yield from flush()


def radix_buckets(entries: DataFrame, text: str, bucket_entries: int = BUCKET_ENTRIES, first: int = FIRST, literals: int = MOST_LITERALS) -> DataFrame:
    """``entries`` with the ``_bucket`` of each: its shortest prefix of ``first`` bytes, twice as many, and so on, that at most ``bucket_entries`` share.

    Each round counts the prefixes of what lay in too large buckets before.  Those that are still too large are
    compared as literals where they are few, else joined as a table, so their number has no bound.  A
    string that ends within its prefix can't be split further and needn't be: its bucket holds it alone.  As prefixes
    double, strings that share thousands of bytes take a few rounds more.
    """
    t, depth, rest = F.encode(F.col(text), "UTF-8"), first, entries
    settled: list[DataFrame] = []
    while True:
        prefix = F.substring(t, 1, depth)
        large = storage.cut(rest.filter(F.octet_length(t) > depth).groupBy(prefix.alias("_p")).count().filter(F.col("count") > bucket_entries).select("_p"))
        n = large.count()
        if not n:
            break
        if n <= literals:
            marked = rest.withColumn("_large", F.hex(prefix).isin([bytes(r["_p"]).hex().upper() for r in large.collect()]))
        else:
            marked = rest.withColumn("_p", prefix).join(large.withColumn("_large", F.lit(True)), "_p", "left").drop("_p")
        split = F.coalesce("_large", F.lit(False)) & (F.octet_length(t) > depth)
        settled.append(marked.filter(~split).drop("_large").withColumn("_bucket", prefix))
        rest = marked.filter(split).drop("_large")
        if n > literals:
            rest = storage.cut(rest)
        depth *= 2
    out = rest.withColumn("_bucket", F.substring(t, 1, depth))
    return reduce(DataFrame.unionByName, settled, out)


def formatting_copies(records: DataFrame, fields: list[str], key: str = "id", least: int = 1, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """``(first_id, copies)``: for each set of records alike but for formatting, its lowest id and its size.

    Records are alike when ``fields``, in whatever order, agree without white space, letter case and
    punctuation; null is as blank, so records with all fields blank are alike too.  Sets of fewer than
    ``least`` records don't come out.  Null ids count as records but are the lowest only if all are null.
    Other columns aren't read.  An empty table gives no rows.
    """
    source = records.select(canonical(fields).alias("_text"), F.col(key).cast("bigint").alias("_id"))
    entries = storage.cut(source.mapInArrow(_combine, "_text string, _first bigint, _copies bigint"))
    bucketed = radix_buckets(entries, "_text", bucket_entries)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, at = CountingTrie(), None

        def result(trie: CountingTrie) -> pa.RecordBatch:
            found = [x for x in trie.terminals() if x[1] >= least]
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["first_id", "copies"])

        for b in batches:
            for bucket, text, first, copies in zip(*(b[c].to_pylist() for c in ("_bucket", "_text", "_first", "_copies")), strict=True):
                if bucket != at:
                    yield result(trie)
                    trie, at = CountingTrie(), bucket
                trie.add(text.encode()[len(bucket) :], first, copies)
        yield result(trie)

    return bucketed.repartition("_bucket").sortWithinPartitions("_bucket").mapInArrow(count, "first_id bigint, copies bigint")
