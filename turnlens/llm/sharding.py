"""Sharding by minimax contiguous partition.

Equal texts form one atomic group. Groups lie in the order of a 63-bit hash of their text, and the operator cuts that
order into contiguous shards so that the largest shard is as small as it can be. The smallest feasible capacity comes
from binary search; a capacity is checked greedily. The greedy check needs only prefix sums near its cuts, so the
driver never sees the groups: it sees a bounded number of hash bins and opens those that a cut can fall into, until the
bounds meet. A shard is then a range of hashes, and rows find theirs by comparing against the cuts, without a join.

Defined cases: a null text counts as empty; a null id sorts first; an empty table gives no rows; repeated rows are kept and
get slots of their own, in any order among themselves; very long texts count by their whole length; extra columns are
ignored. A group larger than the mean shard gets a shard for itself, and the others share evenly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, numbered, table

KEY_BITS = 63
#: Bins of the first look, and how far a bin is split when few or many are opened. They bound what the driver gets.
FIRST_BITS, FEW, FEW_BITS, MANY_BITS = 14, 256, 8, 5


@dataclass
class Bins:
    """Ordered bins of groups. ``one``: the bin is a single group, so no cut can fall inside."""

    low: np.ndarray
    bits: np.ndarray
    size: np.ndarray
    largest: np.ndarray
    one: np.ndarray

    def __post_init__(self):
        self.before = np.concatenate([[0], np.cumsum(self.size)])

    def without(self, drop: np.ndarray, more: "Bins") -> "Bins":
        parts = [np.concatenate([getattr(self, k)[~drop], getattr(more, k)]) for k in ("low", "bits", "size", "largest", "one")]
        order = np.argsort(parts[0], kind="stable")
        return Bins(*[p[order] for p in parts])


def greedy(bins: Bins, capacity: int, shards: int) -> list[int]:
    """Where each shard ends, as an index of bins, when bins are atomic and every shard is filled as far as it goes."""
    at, ends = 0, []
    for _ in range(shards):
        at = max(at, int(np.searchsorted(bins.before, bins.before[at] + capacity, "right")) - 1)
        ends.append(at)
    return ends


def fluid(bins: Bins, capacity: int, shards: int) -> list[int]:
    """Where each shard ends at the furthest, as a prefix sum: bins of several groups may be cut anywhere."""
    at, ends = 0, []
    for _ in range(shards):
        at = min(at + capacity, int(bins.before[-1]))
        i = int(np.searchsorted(bins.before, at, "right")) - 1
        if i < len(bins.one) and bins.one[i]:
            at = int(bins.before[i])
        ends.append(at)
    return ends


def smallest(feasible, low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    return low


def bounds(bins: Bins, shards: int) -> tuple[int, int]:
    """A capacity that no partition can beat, and one that is feasible."""
    total = int(bins.before[-1])
    least = max(-(-total // shards), int(bins.largest.max(initial=0)))
    low = smallest(lambda c: fluid(bins, c, shards)[-1] >= total, least, max(least, total))
    high = smallest(lambda c: c >= bins.size.max(initial=0) and greedy(bins, c, shards)[-1] == len(bins.size), low, max(low, total))
    return low, high


def to_open(bins: Bins, low: int, high: int, shards: int) -> np.ndarray:
    """Bins of several groups that a greedy cut can fall into for some capacity between the bounds."""
    heavy = ~bins.one & (bins.size > low)
    if heavy.any():
        return heavy
    near, far = greedy(bins, low, shards), fluid(bins, high, shards)
    out = np.zeros(len(bins.size), bool)
    for a, b in zip(near, far):
        out[a : int(np.searchsorted(bins.before, b, "right"))] = True
    return out & ~bins.one


def cuts(bins: Bins, capacity: int, shards: int) -> list[int]:
    """Ends of the shards as indexes of bins: no shard above the capacity, each as near its even share as that allows."""
    n = len(bins.size)
    furthest = np.maximum(np.searchsorted(bins.before, bins.before[:-1] + capacity, "right") - 1, np.arange(n) + 1)
    needs = np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        needs[i] = needs[furthest[i]] + 1
    giants = np.zeros(n, bool)
    while True:
        share = (bins.size.sum() - bins.size[giants].sum()) / max(1, shards - giants.sum())
        if not (more := ~giants & (bins.size > share) & bins.one).any():
            break
        giants |= more
    small = np.concatenate([[0], np.cumsum(np.where(giants, 0, bins.size))])
    alone = np.concatenate([[0], np.cumsum(giants)])
    at, ends = 0, []
    for left in range(shards, 0, -1):
        if at < n:
            if giants[at]:
                end = at + 1
            else:
                goal = small[at] + (small[-1] - small[at]) / max(1, left - (alone[-1] - alone[at]))
                end = int(np.searchsorted(small, goal, "right")) - 1
                end += int(end < n and end > at and small[end + 1] - goal < goal - small[end]) or int(end <= at)
                ahead = np.flatnonzero(giants[at:end])
                end = at + int(ahead[0]) if len(ahead) else end
            end = n if left == 1 else min(max(end, at + 1), int(furthest[at]))
            while needs[end] > left - 1:
                end += 1
            at = end
        ends.append(at)
    return ends


def group_key(text: Column) -> Column:
    """The group's place in the order. Two texts that shared all 63 bits would only share a shard."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 1)


def _bins(sizes: DataFrame, bits: int) -> Bins:
    groups = sizes.groupBy("key").agg(F.sum("size").alias("size"))
    rows = (
        groups.groupBy(F.shiftright("key", KEY_BITS - bits).alias("bin"))
        .agg(F.sum("size").alias("size"), F.max("size").alias("largest"), (F.min("key") == F.max("key")).alias("one"))
        .toPandas()
        .sort_values("bin")
    )
    return Bins(rows["bin"].to_numpy(np.int64) << (KEY_BITS - bits), np.full(len(rows), bits), rows["size"].to_numpy(np.int64), rows["largest"].to_numpy(np.int64), rows["one"].to_numpy(bool))


def _opened(spark: SparkSession, sizes: DataFrame, bins: Bins, chosen: np.ndarray) -> Bins:
    out = None
    for bits in np.unique(bins.bits[chosen]):
        own = chosen & (bins.bits == bits)
        wanted = spark.createDataFrame([(int(x) >> (KEY_BITS - int(bits)),) for x in bins.low[own]], "bin long")
        inside = sizes.join(F.broadcast(wanted), F.shiftright("key", KEY_BITS - int(bits)) == F.col("bin"), "left_semi")
        more = _bins(inside, min(KEY_BITS, int(bits) + (FEW_BITS if own.sum() <= FEW else MANY_BITS)))
        out = bins.without(own, more) if out is None else out.without((out.bits == bits) & np.isin(out.low, bins.low[own]), more)
    return out


def boundaries(sizes: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the first key of each shard but the first; ``sizes``: key, size."""
    bins = _bins(sizes, FIRST_BITS)
    low, high = bounds(bins, shards)
    while low < high and (chosen := to_open(bins, low, high, shards)).any():
        bins = _opened(sizes.sparkSession, sizes, bins, chosen)
        low, high = bounds(bins, shards)
    ends = cuts(bins, high, shards)
    return high, [int(bins.low[e]) if e < len(bins.low) else (1 << KEY_BITS) - 1 for e in ends[:-1]]


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16, order: list[Column] | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, capacity.

    Size is the text's UTF-8 bytes plus ``overhead``. Slots run from 0 within a shard, in the ``order`` given, then that of ids, then
    of texts; ranges of that order are counted apart, so neither a shard nor a group of equal rows is one task's work.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(docs["text"], F.lit(""))
    rows = scratch.keep(
        docs.select(F.monotonically_increasing_id().alias("rid"), docs["doc_id"], (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), group_key(docs["text"]).alias("key"), *[c.alias(f"order{i}") for i, c in enumerate(order or [])]),
        "rows",
    )
    capacity, firsts = boundaries(rows.select("key", "size"), shards)
    which = F.lit(0)
    for first in firsts:
        which = which + (F.col("key") >= first).cast("int")
    placed = numbered(scratch, rows.withColumn("shard", which.cast("int")), ["shard"], [*(f"order{i}" for i in range(len(order or []))), "doc_id", "key", "rid"], "placed")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=40, overhead=16)
