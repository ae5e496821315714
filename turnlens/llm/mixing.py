"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is dealt into blocks by the top bits of a hash of document id and text, which permutes it. A source's quota is
a count of block draws: some whole passes over all its blocks, then the first blocks of the permutation until its target
is met, the last of them in part. The tree splits the vector of quotas among the output shards: each inner node gives
its left half a multivariate-hypergeometric draw of what it holds, so the quotas stay exact. Each shard then receives
its number of draws from the source's permuted list of draws (disjoint by construction), and ``shuffled`` deals the rows
out to the shards and shuffles them there. All of this is decided on tables of sources and of blocks; documents only look
up their block. A source has a bounded number of blocks; there may be any number of sources, in groups of ``TOGETHER`` that
each have a tree of their own.

Where the part pass ends inside a block, the block is refined by further bits of the hash until it holds few documents, and
rows that agree in their whole hash are numbered, so that the pass ends at exactly one row, of which it takes a part.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a source without words has
target 0; a document without words is never drawn; repeated rows are mixed as rows, in any order among themselves; rows
without an id are told apart by their text; very long texts count whole; an empty table gives no rows; extra columns are
ignored, or carried.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, numbered, table, word_count

#: Fixed values of the contract: weights of the sources in order, repeating; share of all words; most passes.
WEIGHTS, POOL, MOST_PASSES = (3, 1, 2), Fraction(3, 2), 2
#: Documents of a block, on average, until a source has 2^MOST_BITS blocks; bits by which a block is refined at once.
BLOCK_ROWS, MOST_BITS = 16, 16
#: A boundary block is refined until it holds no more documents than this.
EDGE_ROWS = 10_000
HASH_BITS = 63
#: Sources whose quotas one tree splits.
TOGETHER = 1024
#: Tables with no more rows than this are broadcast; larger ones meet the documents in a shuffle.
BROADCAST_ROWS = 1 << 18


def targets(sizes: list[int], weights=WEIGHTS, pool: Fraction = POOL, most: int = MOST_PASSES) -> list[Fraction]:
    """Each source's words: its weight's share of the pool, stopped at ``most`` times its size, the excess reshared."""
    left, out, open_ = pool * sum(sizes), [Fraction(0)] * len(sizes), list(range(len(sizes)))
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        above = [i for i in open_ if left * weights[i % len(weights)] / total > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = left * weights[i % len(weights)] / total
            break
        for i in above:
            out[i] = Fraction(most * sizes[i])
        left -= sum(out[i] for i in above)
        open_ = [i for i in open_ if i not in set(above)]
    return out


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Draws of each source for each shard: rows sum to the quotas, columns differ by one at most."""
    rng, out = np.random.default_rng(seed), np.zeros((len(quotas), shards), np.int64)

    def part(held: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[:, low] = held
            return
        middle = (low + high) // 2
        n = int(held.sum())
        take = round(n * (middle - low) / (high - low))
        left = rng.multivariate_hypergeometric(held, take, method="marginals") if n else held
        part(left, low, middle)
        part(held - left, middle, high)

    part(quotas.astype(np.int64), 0, shards)
    return out


def _aimed(scratch: Scratch, kept: DataFrame, weights, pool: Fraction, most: int) -> DataFrame:
    """The sources: s (their number in order), source, source_size, docs, target, passes (whole passes over the source) and
    need (words of the part pass). The targets are those of ``targets``, by sums over the table of sources in each step."""
    sizes = kept.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")).withColumn("last", F.col("source").isNull())
    own = numbered(scratch, sizes, [], ["last", "source"], "sources").withColumnRenamed("place", "s")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    own = scratch.keep(own.drop("last").withColumn("w", weight), "weighed")
    big = lambda c: c.cast("decimal(38,0)")
    share, held = None, -1  # words for each unit of weight
    while True:
        stopped = F.lit(False) if share is None else big(F.col("w")) * F.lit(share.numerator).cast("decimal(38,0)") > big(F.col("source_size")) * F.lit(most * share.denominator).cast("decimal(38,0)")
        found = own.agg(F.sum(big(F.col("source_size"))).alias("all"), F.sum(F.when(stopped, big(F.col("source_size")))).alias("stopped"), F.sum(F.when(~stopped, big(F.col("w")))).alias("open"), F.count(F.when(stopped, 1)).alias("n")).first()
        if found["n"] == held or not found["open"]:
            break
        held, share = found["n"], (pool * int(found["all"] or 0) - most * int(found["stopped"] or 0)) / int(found["open"])
    share = share or Fraction(0)
    of_weight = lambda value: F.element_at(F.array(*[F.lit(value(share * w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    words = F.when(stopped, most * F.col("source_size")).otherwise(of_weight(lambda x: round(x)).cast("long"))
    own = own.withColumn("target", F.when(stopped, (most * F.col("source_size")).cast("double")).otherwise(of_weight(float))).withColumn("words", words)
    own = own.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("int"))
    own = own.withColumn("need", F.col("words") - F.col("passes") * F.col("source_size"))
    bits = F.least(F.lit(MOST_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("docs") / BLOCK_ROWS)))).cast("int")
    return scratch.keep(own.select("s", "source", "source_size", "docs", "target", "passes", "need", bits.alias("bits")), "aimed")


def _ends(scratch: Scratch, known: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each source with a part pass where it ends: s, h and size of the rows it ends among, ``whole`` (how many of them it
    takes) and ``part`` (words of the next one). ``known`` has s, h, size, bits, need; ``blocks`` s, block, words, docs, bits, need."""
    up = F.sum("words").over(W.partitionBy("s").orderBy("block"))
    at = blocks.withColumn("up", up).where((F.col("need") > 0) & (F.col("up") >= F.col("need")) & (F.col("up") - F.col("words") < F.col("need")))
    ends = scratch.keep(at.select("s", F.col("bits").alias("width"), F.col("block").alias("low"), (F.col("up") - F.col("words")).alias("before"), "docs"), "ends-0")
    round_ = 0
    inside_of = lambda e: known.join(e, "s").where(F.expr(f"shiftright(h, {HASH_BITS} - width) = low"))
    while (wide := ends.where((F.col("docs") > EDGE_ROWS) & (F.col("width") < HASH_BITS))).limit(1).count():
        round_ += 1
        finer = F.least(F.lit(HASH_BITS), F.col("width") + MOST_BITS)
        more = inside_of(wide.drop("docs")).withColumn("finer", finer).withColumn("block", F.expr(f"shiftright(h, {HASH_BITS} - finer)"))
        more = more.groupBy("s", "finer", "block", "before", "need").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        at = more.withColumn("up", up + F.col("before")).where((F.col("up") >= F.col("need")) & (F.col("up") - F.col("words") < F.col("need")))
        rest = ends.where((F.col("docs") <= EDGE_ROWS) | (F.col("width") >= HASH_BITS))
        ends = scratch.keep(rest.unionByName(at.select("s", F.col("finer").alias("width"), F.col("block").alias("low"), (F.col("up") - F.col("words")).alias("before"), "docs")), f"ends-{round_}")
    alike = inside_of(ends.drop("docs")).groupBy("s", "h", "size", "before", "need").agg(F.count("*").alias("n"))
    up = F.sum(F.col("n") * F.col("size")).over(W.partitionBy("s").orderBy("h", "size")) + F.col("before")
    at = alike.withColumn("up", up).withColumn("from", F.col("up") - F.col("n") * F.col("size")).where((F.col("up") >= F.col("need")) & (F.col("from") < F.col("need")))
    return scratch.keep(at.select("s", F.col("h").alias("end_h"), F.col("size").alias("end_size"), F.expr("(need - from) div size").alias("whole"), F.expr("(need - from) % size").alias("part")), "end")


def _deals(scratch: Scratch, sources: DataFrame, blocks: DataFrame, end: DataFrame, shards: int, seed: int) -> DataFrame:
    """The shards that draw each block: s, block, dealt (one shard for each draw, whole passes first)."""
    last = end.join(sources.select("s", "bits"), "s").select("s", F.expr(f"shiftright(end_h, {HASH_BITS} - bits)").alias("last"))
    draws = blocks.select("s", "block").join(sources.select("s", "passes"), "s").join(last, "s", "left")
    draws = draws.withColumn("times", F.col("passes") + F.coalesce((F.col("block") <= F.col("last")).cast("int"), F.lit(0))).where("times > 0")
    draws = scratch.keep(draws.select("s", "block", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy")), "draws")

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        per_shard = split_tree(pdf["quota"].to_numpy(np.int64), shards, seed + int(key[0]))
        return pd.DataFrame({"s": pdf["s"].to_numpy(), "ends": per_shard.cumsum(axis=1).tolist()})

    quotas = draws.groupBy("s").agg(F.count("*").alias("quota")).withColumn("tree", F.floor(F.col("s") / TOGETHER))
    ends = quotas.groupBy("tree").applyInPandas(grow, "s long, ends array<long>")
    rank = F.row_number().over(W.partitionBy("s").orderBy(F.xxhash64(F.lit(seed + 1), "s", "block", "copy"), "block", "copy")) - 1
    placed = draws.withColumn("rank", rank).join(ends, "s").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
    dealt = placed.groupBy("s", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("dealt"))
    return scratch.keep(dealt, "dealt")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def mix(docs: DataFrame, weights=WEIGHTS, pool: Fraction = POOL, most: int = MOST_PASSES, shards: int = 64, seed: int = 17, whole: bool = False, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, ``draws``, and with ``carry`` the row itself.

    ``draws`` is an array of (words, shard, place): how many words of the document a draw takes (all of them but at one
    document of each source, where the draw is its first words, so that the source meets its target exactly), the output
    shard, and a hash that orders a shard's rows. With ``whole`` that one document is drawn whole if its larger part is.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), docs["doc_id"], F.xxhash64(docs["text"])), 1)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs["doc_id"], docs["source"], word_count(docs["text"]).alias("size"), h.alias("h"), *[F.struct(*[docs[c] for c in docs.columns]).alias("row")] * carry)
    kept = scratch.keep(rows, "rows")
    sources = _aimed(scratch, kept, weights, pool, most)
    of_source = _small(sources.select("s", F.col("source").alias("name"), "source_size", "target", "passes", "need", "bits"))
    known = kept.select("rid", "source", "size", "h").join(of_source, F.col("source").eqNullSafe(F.col("name"))).select("rid", "s", "h", "size", "bits", "need")
    blocks = known.groupBy("s", "bits", "need", F.expr(f"shiftright(h, {HASH_BITS} - bits)").alias("block")).agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
    blocks = scratch.keep(blocks, "blocks")
    end = _ends(scratch, known, blocks)
    dealt = _deals(scratch, sources, blocks, end, shards, seed)
    # Rows that agree with the end in hash and size: numbered, as only so many of them are taken.
    among = known.join(_small(end.select("s", "end_h", "end_size")), "s").where("h = end_h and size = end_size").select("s", "rid")
    among = _small(numbered(scratch, among, ["s"], ["rid"], "among").select("rid", F.col("place").alias("among")))

    placed = (
        kept.join(of_source, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("block", F.expr(f"shiftright(h, {HASH_BITS} - bits)"))
        .join(_small(dealt), ["s", "block"], "left").join(_small(end), "s", "left").join(among, "rid", "left")
    )
    earlier = (F.col("h") < F.col("end_h")) | ((F.col("h") == F.col("end_h")) & (F.col("size") < F.col("end_size")))
    cut = F.when(2 * F.col("part") >= F.col("size"), F.col("size")).otherwise(0) if whole else F.col("part")
    in_part = F.when(earlier | (F.col("among") < F.col("whole")), F.col("size")).when(F.col("among") == F.col("whole"), cut).otherwise(0)
    lists = F.transform(F.coalesce("dealt", F.array().cast("array<int>")), lambda shard, i: F.struct(F.when(i < F.col("passes"), F.col("size")).otherwise(F.col("in_part")).cast("long").alias("words"), shard.alias("shard"), F.xxhash64(F.lit(seed + 2), shard, i, F.col("h")).alias("place")))
    out = placed.withColumn("in_part", F.coalesce(in_part, F.lit(0))).withColumn("draws", F.filter(lists, lambda d: d["words"] > 0))
    return out.select("doc_id", "source", "size", "source_size", "target", F.aggregate("draws", F.lit(0).cast("long"), lambda n, d: n + d["words"]).alias("taken"), "draws", *["row"] * carry)


def shuffled(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each draw, dealt to its output shard and in shuffled order there. A shard may span tasks."""
    draws = mixed.withColumn("draw", F.explode("draws")).select("*", "draw.words", "draw.shard", "draw.place").drop("draw", "draws")
    return draws.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.transform("draws", lambda d: d["shard"]).alias("shards"))
