"""Filling containers of fixed capacity by sum of squares.

``N(g)`` is the number of open bins with a residual gap of ``g``.  Each item goes where the sum of ``N(g)^2`` over all
gaps becomes smallest.  Items are spread over shards of a bounded number of items, each packed alone.
"""

from __future__ import annotations



import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import storage

CAPACITY = 2048
SHARD_ITEMS = 100_000


def sum_of_squares(sizes: np.ndarray, capacity: int, open_early: bool = True) -> np.ndarray:
    """The bin number of each item, taken in the order given; all sizes from 1 to capacity.

    ``open_early``: a new bin is a place like others; else one is opened only for an item that fits nowhere.

    Among places that make the sum equally small, the smallest remaining gap wins, so the result is one.
    """
    n = np.zeros(capacity + 1, np.int64)  # open bins by gap; of gap 0 and capacity none are kept
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.empty(len(sizes), np.int64)
    made = 0
    none = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        # change of the sum when a bin of gap g takes the item: g loses a bin, g - s gains one unless it is full
        change = 2 * (n[: capacity - s] - n[s:capacity]) + 2
        if s < capacity:
            change[0] = 1 - 2 * n[s]
            change[n[s:capacity] == 0] = none
            best = int(np.argmin(change))
            least = change[best]
            fresh = 2 * n[capacity - s] + 1
        else:
            best, least, fresh = 0, none, 0
        if least != none and (least <= fresh or not open_early):
            b = open_bins[s + best].pop()
            n[s + best] -= 1
            gap = best
        else:
            b, gap, made = made, capacity - s, made + 1
        if gap:
            n[gap] += 1
            open_bins[gap].append(b)
        bins[i] = b
    return bins


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "tokens", capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``(key, part, tokens, shard, bin)``: the container ``(shard, bin)`` of each item.

    An item larger than the capacity is cut into full parts, each alone in its container, and a
    rest that is packed like an item; ``part`` numbers them from 0.  Items of null or no size need no
    container and don't come out.  Items of a key that comes twice are items of their own.

    Within a shard the largest items are placed first, ties by key, and a bin is opened only for an item that fits
    in no other: so no more are opened than first fit opens on the sizes tried, and fewer than early opening does.  What sharding costs is the few bins
    that stay open in each shard of ``shard_items``.
    """
    items = storage.cut(sizes.select(F.col(key).alias("_key"), F.col(size).cast("bigint").alias("_size")).filter("_size > 0"))
    shards = max(1, -(-items.count() // shard_items))
    kind = sizes.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        full = (group["_size"].to_numpy() // capacity).astype(np.int64)
        rest = (group["_size"].to_numpy() % capacity).astype(np.int64)
        order = np.lexsort((group["_key"].to_numpy(), -rest))
        order = order[rest[order] > 0]
        bins = sum_of_squares(rest[order], capacity, open_early=False)
        whole = np.repeat(np.arange(len(full)), full)
        first = np.concatenate([[0], np.cumsum(full)])
        part = np.arange(len(whole)) - first[whole]
        made = int(bins.max()) + 1 if len(bins) else 0
        keys = group["_key"].to_numpy()
        return pd.DataFrame(
            {
                key: np.concatenate([keys[order], keys[whole]]),
                "part": np.concatenate([full[order], part]).astype(np.int32),
                "tokens": np.concatenate([rest[order], np.full(len(whole), capacity)]).astype(np.int32),
                "shard": np.int64(group["_shard"].iloc[0]),
                "bin": np.concatenate([bins, made + np.arange(len(whole))]).astype(np.int64),
            }
        )

    # by place, not by key: a key that comes very often would fill one shard; places are fixed by the checkpoint
    spread = items.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return spread.groupBy("_shard").applyInPandas(run, f"`{key}` {kind}, part int, tokens int, shard bigint, bin bigint")


def container_fill(packed: DataFrame) -> DataFrame:
    """``(shard, bin, items, tokens)`` of each container."""
    return packed.groupBy("shard", "bin").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))



