"""Near-duplicate documents by SuperMinHash (Ertl, 2017), banding, verification and union-find grouping.

SuperMinHash gives each element one permutation of the signature's slots and adds the rank to a fresh random number: slot
values are minima over elements, correlated through the permutation, which lowers the estimator's variance. Ranks are
visited in rising order; once every slot lies below the next rank no later rank can lower it, and the document stops.
Here all elements of a block of documents take rank 0 together, then the open ones rank 1, and so on.

Documents with equal shingle sets form a class and only its representative goes on. Bands of the signature are buckets.
Of buckets with the same members one stands for all, as they ask the same question.
A bucket is not paired out. First all members meet the bucket's pivot, which each bucket chooses by a hash of its own, so
that a large group of copies meets many pivots; their full shingle sets decide. Distributed star rounds (union-find for
edges that no task holds together) give components. Then only buckets whose members are still apart go on: members
outside the pivot's component meet the other members in blocks of bounded size, by exact set sizes, and a block reports
which components it joins. So every pair that shares a bucket is compared or is already connected.

Banding misses a pair at exactly the threshold t with probability (1 - t^rows)^bands; the number of bands is the least
that keeps this below ``MISS``: 28 of five rows for 0.85, 41 for 0.8.

Defined cases: documents without words (or a null text) have an empty set and link with nothing, not even each other;
with fewer words than a shingle the whole sequence is the one shingle; repeated rows are members of one class; every row
counts by itself, so rows that repeat a doc_id with other texts link by those texts alone, and rows without a doc_id link
like others; a component's id is its smallest doc_id, or null; of several rows with that id the one whose set has the
smallest fingerprint stands for the component; very long texts are read whole; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_table, mix64, slices, table, word_hashes, words_of
from .components import components

MOST_ROWS, MISS, MOST_SLOTS = 5, 1e-7, 255
#: Elements that take a rank together; bounds the permutation table to this times the slots.
TOGETHER = 1 << 17
#: A pivot's set travels once for this many of its partners.
GROUP = 256
#: Bits of the table that tells which texts may be needed again, in rows of 4 KB: so many for each id, 4 MB at most.
BITS_EACH, BITS = 16, 1 << 25
#: Members of unsettled buckets meet in blocks bounded by the elements of their sets and by their number.
BLOCK_ELEMENTS, BLOCK_MEMBERS = 1 << 18, 1024


def shingles(flat: pa.Array, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, in one array, and where each text's begin (n + 1 offsets)."""
    h, out, ends = word_hashes(flat), [], [0]
    odd = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        rolled = h.copy()
        for k in range(1, size):
            rolled[: len(h) - k] = mix64(rolled[: len(h) - k] * odd + h[k:]) if len(h) > k else rolled[: len(h) - k]
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= size:
                own = np.unique(rolled[a : b - size + 1])
            elif b > a:
                whole = h[a : a + 1]
                for x in h[a + 1 : b]:
                    whole = mix64(whole * odd + x)
                own = mix64(whole + np.uint64(b - a))
            else:
                own = h[:0]
            out.append(own)
            ends.append(ends[-1] + len(own))
    return (np.concatenate(out) if out else h[:0]), np.array(ends, np.int64)


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows of each: the most rows that keep the promised recall within the slots."""
    for rows in range(MOST_ROWS, 0, -1):
        count = math.ceil(math.log(MISS) / math.log1p(-min(1 - 1e-12, (percent / 100) ** rows)))
        if count * rows <= MOST_SLOTS:
            return count, rows
    raise ValueError(f"no banding finds pairs at {percent} %")


def signatures(elements: np.ndarray, ends: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash signature of each set, as float64 [set][slot]; empty sets stay at infinity."""
    n = len(ends) - 1
    best = np.full((n, slots), np.inf)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(ends))
    for low in range(0, len(elements), TOGETHER):
        e, doc = elements[low : low + TOGETHER], owner[low : low + TOGETHER]
        perm = np.tile(np.arange(slots, dtype=np.uint8), (len(e), 1))
        row = np.arange(len(e))
        for rank in range(slots):
            with np.errstate(over="ignore"):
                z = mix64(e + np.uint64(rank + 1) * np.uint64(0x9E3779B97F4A7C15))
                pick = rank + (mix64(z) % np.uint64(slots - rank)).astype(np.int64)
            value = rank + (z >> np.uint64(11)).astype(np.float64) * 2.0**-53
            slot = perm[row, pick]
            perm[row, pick] = perm[row, rank]
            np.minimum.at(best.reshape(-1), doc * slots + slot, value)
            own = np.arange(doc[0], doc[-1] + 1)
            open_ = np.zeros(n, bool)
            open_[own] = best[own].max(axis=1) >= rank + 1
            stay = open_[doc]
            if not stay.any():
                break
            if not stay.all():
                e, doc, perm = e[stay], doc[stay], perm[stay]
                row = np.arange(len(e))
    return best


def bands(signature: np.ndarray, count: int, rows: int) -> np.ndarray:
    """A 64-bit hash of each band of each signature."""
    out = np.empty((len(signature), count), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(count):
            h = np.full(len(signature), b + 1, np.uint64)
            for r in range(rows):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + np.ascontiguousarray(signature[:, b * rows + r]).view(np.uint64))
            out[:, b] = h
    return out.view(np.int64)


def _fingerprint(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of each set, as two columns: sums and xors of mixed elements do not depend on their order."""
    out = np.zeros((len(ends) - 1, 2), np.uint64)
    with np.errstate(over="ignore"):
        up = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
        two = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(sets * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)), dtype=np.uint64)])
    out[:, 0], out[:, 1] = up[ends[1:]] - up[ends[:-1]], two[ends[1:]] - two[ends[:-1]]
    return out.view(np.int64)


def _signed(docs: DataFrame, shingle: int, count: int, rows: int) -> DataFrame:
    """rid, doc_id, n_shingles, f1, f2, bands of every row (rid, doc_id, text), in one pass over the texts."""
    blank = byte_table()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                sets, ends = shingles(*words_of(part.column("text"), blank), shingle)
                marks, f = bands(signatures(sets, ends, count * rows), count, rows), _fingerprint(sets, ends)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(marks) + 1) * count, count), pa.int32()), pa.array(marks.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), pa.array(np.diff(ends)), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy()), lists], ["rid", "doc_id", "n_shingles", "f1", "f2", "bands"])

    return docs.mapInArrow(run, f"rid long, doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, f1 long, f2 long, bands array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """f1, f2, n_shingles and set (sorted distinct shingle hashes) of texts."""
    blank = byte_table()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                sets, ends = shingles(*words_of(part.column("text"), blank), shingle)
                lists, f = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(sets.view(np.int64))), _fingerprint(sets, ends)
                yield pa.RecordBatch.from_arrays([pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy()), pa.array(np.diff(ends)), lists], ["f1", "f2", "n_shingles", "set"])

    return docs.mapInArrow(run, "f1 long, f2 long, n_shingles long, set array<long>")


def _passed(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts whose id may be one of ``wanted`` (low), by a table of bits, so that others are not shuffled. Its rows are
    bounded; a bit that another id has set lets a text pass, and the join that follows drops it."""
    size = min(BITS, 1 << max(15, (BITS_EACH * wanted.count()).bit_length()))
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    bits = wanted.where("low is not null").groupBy(F.bitmap_bucket_number(spot("low")).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot("low"))).alias("_bits"))
    place = F.bitmap_bit_position(spot("doc_id"))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = texts.join(F.broadcast(bits), F.bitmap_bucket_number(spot("doc_id")) == bits["_part"])
    return met.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*texts.columns)


def _verify(scratch: Scratch, pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Of the pairs (a, b, part) those whose full sets are similar. A pivot's set travels once for each part of its partners."""
    left = pairs.select("a", "part").distinct().join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    right = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    met = right.join(left, ["a", "part"]).select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("shared"), F.size("set_a").alias("na"), F.size("set_b").alias("nb"))
    return scratch.keep(met.where(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b"), name)


def shared_sizes(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """[i][j]: size of the intersection of one[i] and two[j], by counting on the elements that both sides have."""
    flat_a, flat_b = np.concatenate(one), np.concatenate(two)
    common = np.intersect1d(flat_a, flat_b)
    row_a, row_b = np.repeat(np.arange(len(one)), [len(x) for x in one]), np.repeat(np.arange(len(two)), [len(x) for x in two])
    out = np.zeros((len(one), len(two)), np.float32)
    if not len(common):
        return out
    at = lambda flat: np.searchsorted(common, flat).clip(max=len(common) - 1)
    col_a, col_b = at(flat_a), at(flat_b)
    in_a, in_b = common[col_a] == flat_a, common[col_b] == flat_b
    row_a, col_a, row_b, col_b = row_a[in_a], col_a[in_a], row_b[in_b], col_b[in_b]
    wide = max(256, (1 << 23) // (len(one) + len(two)))
    for low in range(0, len(common), wide):
        x, y = np.zeros((len(one), min(wide, len(common) - low)), np.float32), np.zeros((len(two), min(wide, len(common) - low)), np.float32)
        for m, r, c in ((x, row_a, col_a), (y, row_b, col_b)):
            here = (c >= low) & (c < low + wide)
            m[r[here], c[here] - low] = 1
        out += x @ y.T
    return out


def _blocks_of(spots: DataFrame) -> DataFrame:
    """Members of unsettled buckets, once for each block pair that they meet in: bucket, i, j, side, id, comp.

    Members outside the pivot's component form the first blocks and meet everyone; members inside it have no need to
    meet each other. Blocks are bounded by their sets' sizes and by their number of members.
    """
    inside = F.col("comp") == F.col("main")
    need = lambda mine: F.greatest(F.ceil(F.sum(F.when(mine, F.col("n")).otherwise(0)) / BLOCK_ELEMENTS), F.ceil(F.sum(F.when(mine, 1).otherwise(0)) / BLOCK_MEMBERS))
    mains = spots.groupBy("bucket").agg(F.max(F.when(F.col("id") == F.col("pivot"), F.col("comp"))).alias("main"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("bucket", "main")
    own = spots.join(mains, "bucket")
    plan = own.groupBy("bucket").agg(need(~inside).cast("int").alias("u"), need(inside).cast("int").alias("v"))
    own = own.join(plan, "bucket").withColumn("block", F.when(inside, F.col("u") + F.pmod(F.xxhash64("id"), F.greatest("v", F.lit(1)))).otherwise(F.pmod(F.xxhash64("id"), F.greatest("u", F.lit(1)))).cast("int"))
    with_all = F.transform(F.sequence(F.lit(0), F.col("u") + F.col("v") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    with_open = F.transform(F.sequence(F.lit(0), F.col("u") - 1), lambda k: F.struct(k.alias("i"), F.col("block").alias("j")))
    return own.withColumn("meet", F.explode(F.when(inside, with_open).otherwise(with_all))).select("bucket", F.col("meet.i").alias("i"), F.col("meet.j").alias("j"), F.when(F.col("block") == F.col("meet.i"), 0).otherwise(1).alias("side"), "id", "comp")


def _meet(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        two = two if len(two) else one
        if not len(one):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        sa, sb = one["set"].tolist(), two["set"].tolist()
        na, nb = np.array([len(x) for x in sa]), np.array([len(x) for x in sb])
        inter = np.rint(shared_sizes(sa, sb)).astype(np.int64)
        ca, cb = one["comp"].to_numpy(np.int64), two["comp"].to_numpy(np.int64)
        hit = (100 * inter >= percent * (na[:, None] + nb[None, :] - inter)) & (ca[:, None] != cb[None, :])
        i, j = np.nonzero(hit)
        return pd.DataFrame({"a": np.minimum(ca[i], cb[j]), "b": np.maximum(ca[i], cb[j])}).drop_duplicates()

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 3, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_id (smallest doc_id with the same set). With
    ``row``, a column of distinct numbers, also that column and first: true for exactly one row of each component."""
    scratch = Scratch(docs.sparkSession, "minhash")
    rid = docs[row] if row else F.monotonically_increasing_id()
    signed = scratch.keep(_signed(docs.select(rid.alias("rid"), docs["doc_id"], docs["text"]), shingle, *banding(percent)), "signed")
    of_set = ["f1", "f2", "n_shingles"]
    classes = signed.where("n_shingles > 0").groupBy(*of_set).agg(F.min("rid").alias("id"), F.min("doc_id").alias("low"), F.first("bands").alias("bands"))
    classes = scratch.keep(classes, "classes")

    # Buckets with two classes at least. Each has a pivot of its own choice, so that a large group meets many pivots.
    spots = classes.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    marks = [F.sum(F.shiftright(F.xxhash64(F.lit(1), "id"), 32)).alias("m1"), F.bit_xor(F.xxhash64(F.lit(2), "id")).alias("m2")]
    shared = spots.groupBy("bucket").agg(F.count("*").alias("members"), F.min_by("id", F.xxhash64("bucket", "id")).alias("pivot"), F.min_by("n", F.xxhash64("bucket", "id")).alias("pivot_n"), *marks).where("members > 1")
    # Near copies share many buckets with the same members: one of these goes on, whichever its pivot.
    shared = shared.groupBy("members", "m1", "m2").agg(F.min(F.struct("bucket", "pivot", "pivot_n")).alias("b")).select("members", "b.*")
    spots = scratch.keep(spots.join(shared, "bucket"), "spots")
    near = (F.col("id") != F.col("pivot")) & (100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n"))
    pairs = spots.where(near).groupBy(F.col("pivot").alias("a"), F.col("id").alias("b")).agg(F.max("members").alias("members"))
    pairs = scratch.keep(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / GROUP)).cast("int").alias("part")), "pairs")
    met = scratch.keep(classes.join(spots.select("id").distinct(), "id", "left_semi").select("id", "low", *of_set), "met")
    texts = docs.select(docs["doc_id"], docs["text"])
    found = _passed(texts, met).join(met.select(F.col("low").alias("doc_id")).distinct(), "doc_id").select("doc_id", "text")  # Spark would look for a semi join's rows before the bits
    if met.where("low is null").limit(1).count():  # classes whose rows all lack an id
        found = found.unionByName(texts.where("doc_id is null"))
    sets = scratch.keep(_sets(found.select("text"), shingle).join(met.drop("low"), of_set).select("id", "set").dropDuplicates(["id"]), "sets")
    scratch.drop("met")
    edges = _verify(scratch, pairs, sets, percent, "edges")
    scratch.drop("pairs")
    label = components(scratch, edges, "first")

    # Buckets whose members are still apart: what has not met yet meets in blocks.
    known = spots.where("members > 2").join(label.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    known = scratch.keep(known.select("id", "n", "bucket", "pivot", "comp"), "known")
    scratch.drop("spots")
    met = _blocks_of(known).join(sets, "id").groupBy("bucket", "i", "j").applyInPandas(_meet(percent), "a long, b long")
    # Links found there join whole components: the first stars stand for the links before them.
    more = scratch.keep(met, "more")
    scratch.drop("sets")
    if more.limit(1).count():
        label = components(scratch, more.unionByName(label.select(F.col("component").alias("a"), F.col("node").alias("b"))), "second")

    final = classes.select(*of_set, "id", "low").join(label, classes["id"] == label["node"], "left").withColumn("component", F.coalesce("component", "id"))
    final = scratch.keep(final.select(*of_set, "id", "low", "component"), "final")
    # Of each component the smallest doc_id; its rows are those kept, and the first of them stands for the component.
    lows = final.groupBy("component").agg(F.min("low").alias("lowest"))
    out = signed.select("rid", "doc_id", *of_set).join(final.join(lows, "component"), of_set, "left")
    some = F.col("n_shingles") > 0
    component = F.when(some, F.col("lowest")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", component).withColumn("own", F.col("component_id").eqNullSafe(F.col("doc_id")))
    firsts = out.where(some & F.col("own")).groupBy("component").agg(F.min(F.struct(*of_set, "rid"))["rid"].alias("first_rid"))
    firsts = scratch.keep(firsts, "firsts")
    out = out.join(firsts, "component", "left").withColumn("first", ~some | F.coalesce(F.col("rid") == F.col("first_rid"), F.lit(False)))
    kept = F.when(F.col("doc_id").isNull(), F.col("first")).otherwise(F.col("own"))
    more = [F.col("rid").alias(row), "first"] if row else []
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), F.when(some, F.col("low")).otherwise(F.col("doc_id")).alias("class_id"), *more)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85, shingle=3)
