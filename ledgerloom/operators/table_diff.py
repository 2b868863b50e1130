"""Differences between two copies of a table, by shared key ordinals and presence bitmaps.

Both sides are hashed into the same buckets of some 2^15 keys.  Within a bucket every distinct key
of either side gets a dense ordinal, shared by the sides; bucket and ordinal together number all keys.  Each side's
presence is a compressed bitmap over the ordinals (sorted arrays where sparse, bit fields where
dense, in containers of 2^16).  AND-NOT gives the rows missing on a side; the intersection gives
the ordinals at which the columns of both sides are laid out and compared as whole arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTAINER = 1 << 16
ARRAY_MOST = 4096  # entries up to which a container is a sorted array: as large as its bit field


class PresenceBitmap:
    """A set of ordinals in containers of 2^16: sorted uint16 arrays, or bit fields where dense."""

    def __init__(self, containers: dict[int, np.ndarray]):
        self.containers = containers

    @classmethod
    def of(cls, ordinals: np.ndarray) -> PresenceBitmap:
        ordinals = np.unique(ordinals)
        high = ordinals >> 16
        return cls({int(h): cls._packed((ordinals[high == h] & 0xFFFF).astype(np.uint16)) for h in np.unique(high)})

    @staticmethod
    def _packed(low: np.ndarray) -> np.ndarray:
        if len(low) <= ARRAY_MOST:
            return low
        bits = np.zeros(CONTAINER, bool)
        bits[low] = True
        return np.packbits(bits)

    @staticmethod
    def _bits(part: np.ndarray) -> np.ndarray:
        if part.dtype == np.uint8:
            return part
        bits = np.zeros(CONTAINER, bool)
        bits[part] = True
        return np.packbits(bits)

    def _combine(self, other: PresenceBitmap, keep_alone: bool) -> PresenceBitmap:
        out = {}
        for h, mine in self.containers.items():
            theirs = other.containers.get(h)
            if theirs is None:
                if keep_alone:
                    out[h] = mine
                continue
            if mine.dtype == np.uint16 and theirs.dtype == np.uint16:
                low = np.setdiff1d(mine, theirs, assume_unique=True) if keep_alone else np.intersect1d(mine, theirs, assume_unique=True)
                part = low
            else:
                a, b = self._bits(mine), self._bits(theirs)
                bits = np.unpackbits(a & ~b if keep_alone else a & b)
                part = self._packed(np.flatnonzero(bits).astype(np.uint16))
            if len(part):
                out[h] = part
        return PresenceBitmap(out)

    def and_not(self, other: PresenceBitmap) -> PresenceBitmap:
        return self._combine(other, True)

    def intersect(self, other: PresenceBitmap) -> PresenceBitmap:
        return self._combine(other, False)

    def ordinals(self) -> np.ndarray:
        parts = []
        for h in sorted(self.containers):
            part = self.containers[h]
            low = np.flatnonzero(np.unpackbits(part)) if part.dtype == np.uint8 else part
            parts.append(low.astype(np.int64) + (h << 16))
        return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _newest(batch: pa.Table, keys: list[str], version: list[str]) -> pa.Table:
    """One row for each key: the one that comes last by version, then by the values themselves."""
    order = batch.sort_by([(c, "ascending") for c in (*keys, *version)])
    same = np.ones(max(order.num_rows - 1, 0), bool)
    for k in keys:
        code = order[k].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        same &= code[1:] == code[:-1]
    return order.filter(pa.array(np.append(~same, True)[: order.num_rows]))


def _objects(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) and not column.null_count else np.array(column.to_pylist(), object)


def _bucket_diff(rows: pa.Table, fields: list[str], version: list[str], names: tuple[str, str]) -> tuple[list[str], list[str]]:
    """Keys and kinds of the differences of one bucket."""
    rows = _newest(rows, ["_key", "_side"], version)
    keys = rows["_key"].combine_chunks().dictionary_encode()
    ordinal, side = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows["_side"].to_numpy(zero_copy_only=False)
    left, right = (PresenceBitmap.of(ordinal[side == s]) for s in (0, 1))
    out: list[tuple[np.ndarray, str]] = [(left.and_not(right).ordinals(), f"only_{names[0]}"), (right.and_not(left).ordinals(), f"only_{names[1]}")]
    both = left.intersect(right).ordinals()
    place = np.full((2, len(keys.dictionary)), -1, np.int64)
    place[side, ordinal] = np.arange(len(ordinal))
    for f in fields:
        value = rows[f].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out.append((both[value[place[0, both]] != value[place[1, both]]], f))
    texts = keys.dictionary
    found = [(texts.take(pa.array(o)).to_pylist(), kind) for o, kind in out]
    return [k for ks, _ in found for k in ks], [kind for ks, kind in found for _ in ks]


def table_diff(
    left: DataFrame,
    right: DataFrame,
    key: str,
    fields: dict[str, Column | tuple[Column, Column]],
    version: list[str] | None = None,
    names: tuple[str, str] = ("left", "right"),
    bucket_keys: int = 1 << 15,
) -> DataFrame:
    """Rows ``(key, diff)``: ``only_<name>`` for a key on one side alone, else the name of each
    field whose values differ.

    ``fields`` maps a field to the expression of its comparable form (or one for each side); nulls agree with
    nulls only.  Rows without key don't count.  Where a side holds several rows of a key, the newest by
    ``version`` (bigint columns) is compared, ties by the fields' comparable forms; such rows are
    combined before the shuffle, so a key that holds a large share of all rows is no hot spot.
    Other columns, of whatever name, aren't read.  Empty tables are empty sides.
    """
    version = version or []
    buckets = max(1, -(-(left.count() + right.count()) // bucket_keys))

    def side(df: DataFrame, s: int) -> DataFrame:
        forms = {f: (x[s] if isinstance(x, tuple) else x).cast("string") for f, x in fields.items()}
        return df.filter(F.col(key).isNotNull()).select(
            F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int").alias("_bucket"),
            F.lit(s).cast("int").alias("_side"),
            F.col(key).cast("string").alias("_key"),
            *(F.coalesce(F.col(v).cast("bigint"), F.lit(-(2**63) + 1)).alias(f"_v{i}") for i, v in enumerate(version)),
            *(x.alias(f"_f{i}") for i, x in enumerate(forms.values())),
        )

    named = dict(zip((f"_f{i}" for i in range(len(fields))), fields, strict=True))
    order = [f"_v{i}" for i in range(len(version))] + list(named)
    rows = side(left, 0).unionByName(side(right, 1))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _newest(pa.Table.from_batches([b]), ["_key", "_side"], order).to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                keys, kinds = _bucket_diff(pa.concat_tables(held), list(named), order, names)
                kinds = [named.get(k, k) for k in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(kinds, pa.string())], [key, "diff"])
                held.clear()

        at = None
        for b in batches:
            bucket = b["_bucket"].to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1), len(bucket)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    if at is not None and bucket[lo] != at:
                        yield from flush()
                    at = bucket[lo]
                    held.append(pa.Table.from_batches([b.slice(lo, hi - lo)]))
        yield from flush()

    combined = rows.mapInArrow(combine, rows.schema)
    return combined.repartition("_bucket").sortWithinPartitions("_bucket").mapInArrow(compare, f"`{key}` string, diff string")


def text_form(c: Column) -> Column:
    """Case and white space at the ends disregarded; null stays null."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def cents_form(c: Column) -> Column:
    """A price to two decimals; null stays null."""
    return F.when(F.isnan(c), F.lit("NaN")).otherwise((F.round(c, 2) + F.lit(0.0)).cast("string"))
