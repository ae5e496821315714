"""Ranked lexical search: document-at-a-time merge over compressed postings, shard by shard, then one merge of the best.

``index`` reads the texts once and keeps, for each document, how often it holds each term; corpus counts (documents, terms,
documents of each term) are sums over that table. It then puts the documents into shards by ranges of doc_id and inverts each:
a term's postings are the places of its documents in the shard's order, which is the order of doc_id, as gaps in a
variable-byte code, each with its term's part of the score, which the corpus counts have already fixed. A shard holds a
bounded number of documents, so neither a frequent term nor a source is one task's work.

``search`` sends the postings of a block of queries to a task for each shard and block. There a heap over the postings'
heads merges them document by document, and a bounded heap keeps the best by (score, then place). Once that heap is full, lists
whose greatest parts cannot lift a document over its least entry no longer lead: documents that only they hold are passed
over, and they are looked up for the others. That is exact, since documents come in the order in which ties are broken. The
shards' best, so many for each query and shard, are merged in a window whose limit Spark applies before the shuffle.

An index for stated queries leaves other terms out. A fixed number of bits, one for each hash of a query term, tells
readers which terms may be wanted; the terms themselves decide in a join, so no list of terms travels, however many there are.

Defined cases: null and empty texts have no terms, are not counted, and never rank; queries without terms or without
matches give no rows; terms that nearly all documents hold may weigh 0 and then find nothing; queries that repeat (or lack) an
item_id rank by themselves; documents of equal score and doc_id rank in the order in which they were read; a null doc_id comes
before all others; very long texts are read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, byte_table, slices, table, words_of

#: Bytes of a term: digits, letters and all beyond ASCII.
TERM_BYTE = lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a shard, queries of a block, results of a query, and bits that say which terms may be wanted.
SHARD_DOCS, BLOCK_QUERIES, BEST, WANTED_BITS = 16_384, 64, 10, 1 << 22
#: Fixed values of the score: its unit, the weights' unit, and the share of a document's length in what dampens its counts.
UNIT, WEIGHT_UNIT, SHARE, DAMP = 1_000_000_000, 1000, 90, 8
#: The term of a shard's list of ids. No text holds it.
IDS = ""


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 in a variable-byte code: seven bits a byte, the low ones first, the last byte of each marked."""
    left, width = values.astype(np.uint64), np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        width += (left >> np.uint64(bits)) > 0
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in range(int(width.max(initial=0))):
        has = width > i
        out[ends[has] - width[has] + i] = (left[has] >> np.uint64(7 * i)) & np.uint64(0x7F)
    out[ends - 1] |= 0x80
    return out.tobytes()


def unpack(code: bytes) -> np.ndarray:
    raw = np.frombuffer(code, np.uint8)
    ends = np.flatnonzero(raw & 0x80)
    if not len(ends):
        return np.empty(0, np.int64)
    first = np.concatenate([[0], ends[:-1] + 1])
    shift = np.arange(len(raw)) - np.repeat(first, ends - first + 1)
    return np.add.reduceat((raw & 0x7F).astype(np.int64) << (7 * shift), first)


def best(lists: list[tuple[list[int], list[int], int]], k: int) -> list[tuple[int, int]]:
    """The k best (score, place) of the postings lists (places in order, parts, weight), highest first, then by place."""
    tops = [w * max(parts) for _, parts, w in lists]
    order = sorted(range(len(lists)), key=tops.__getitem__)
    lists, tops = [lists[i] for i in order], [tops[i] for i in order]
    under = [0]  # the most that the lists before each one can add
    for t in tops:
        under.append(under[-1] + t)
    kept: list[tuple[int, int]] = []  # a heap of (score, -place)
    lead, least = 0, 0  # lists from ``lead`` on lead; a document has to score more than ``least``
    heads = [(places[0], i, 0) for i, (places, _, _) in enumerate(lists)]
    heapq.heapify(heads)
    sought = [0] * len(lists)
    while heads:
        place, led, score = heads[0][0], False, 0
        while heads and heads[0][0] == place:
            _, i, at = heads[0]
            places, parts, weight = lists[i]
            if i < lead:  # no longer leads; looked up from here on
                sought[i] = at
                heapq.heappop(heads)
                continue
            led, score = True, score + weight * parts[at]
            if at + 1 < len(places):
                heapq.heapreplace(heads, (places[at + 1], i, at + 1))
            else:
                heapq.heappop(heads)
        if not led:
            continue
        for i in range(lead - 1, -1, -1):
            if score + under[i + 1] <= least:
                break
            places, parts, weight = lists[i]
            at = sought[i] = bisect_left(places, place, sought[i])
            if at < len(places) and places[at] == place:
                score += weight * parts[at]
        else:
            if score > least:
                heapq.heappush(kept, (score, -place))
                if len(kept) > k:
                    heapq.heappop(kept)
                if len(kept) == k:
                    least = kept[0][0]
                    while lead < len(lists) and under[lead + 1] <= least:
                        lead += 1
    return [(s, -p) for s, p in sorted(kept, reverse=True)]


def terms(text: Column) -> Column:
    """The terms of a text, as an array."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


@dataclass
class Index:
    """``docs`` (documents with a term) and ``length`` (all their terms), ``frequency`` (term, df) and ``postings`` (shard, term,
    size, places, parts; the row of the term ``IDS`` has ids, the shard's doc_ids in their order, without the nulls before them)."""

    docs: int
    length: int
    frequency: DataFrame
    postings: DataFrame


def _wanted(queries_terms: DataFrame) -> np.ndarray:
    """WANTED_BITS bits, as bytes: of each wanted term's hash one is set."""
    bit = F.pmod(F.xxhash64("term"), F.lit(WANTED_BITS))
    one = F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int"))
    found = queries_terms.groupBy(F.floor(bit / 8).alias("at")).agg(F.bit_or(one).alias("b")).toPandas()
    out = np.zeros(WANTED_BITS // 8, np.uint8)
    out[found["at"].to_numpy(np.int64)] = found["b"].to_numpy(np.uint8)
    return out


def _may(words: pa.Array, wanted: np.ndarray) -> np.ndarray:
    """Whether each word's bit is set. The hash is the one that the plan's ``xxhash64`` has."""
    import xxhash

    code = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words)) % np.uint64(WANTED_BITS)
    return (wanted[(code >> np.uint64(3)).astype(np.int64)] >> (code & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _counted(docs: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """rid, doc_id, n (terms with repeats), terms and tfs (distinct ones that may be wanted, and their counts)."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    small = byte_table(TERM_BYTE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                flat, at = words_of(part.column("text"), small)
                coded = flat.dictionary_encode()
                own, code = np.repeat(np.arange(len(part)), np.diff(at)), np.asarray(coded.indices).astype(np.int64)
                if wanted is not None and len(code):
                    keep = _may(coded.dictionary, wanted)[code]
                    own, code = own[keep], code[keep]
                size = max(1, len(coded.dictionary))
                key, tf = np.unique(own * size + code, return_counts=True)
                offsets = pa.array(np.searchsorted(key // size, np.arange(len(part) + 1)).astype(np.int32))
                found = pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(key % size)).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), pa.array(np.diff(at)), found, pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))], ["rid", "doc_id", "n", "terms", "tfs"])

    return rows.mapInArrow(count, "rid long, doc_id long, n long, terms array<string>, tfs array<int>").where("n > 0")


def index(docs: DataFrame, only: DataFrame | None = None, shard_docs: int = SHARD_DOCS) -> Index:
    """The index of all documents, for all terms or ``only`` those of a table with the column term."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "search")
    counted = scratch.keep(_counted(docs, None if only is None else _wanted(only)), "counted")
    total = counted.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    n, length = int(total["docs"]), int(total["length"])
    frequency = scratch.keep(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "frequency")

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        from pyspark import TaskContext

        names, shard, waiting, waits = ["shard", "term", "size", "places", "parts", "ids"], TaskContext.get().partitionId() << 32, [], 0

        def put(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks()
            lists = whole.column("terms").combine_chunks()
            own = np.repeat(np.arange(len(whole)), np.asarray(pc.list_value_length(lists)))
            m = 100 - SHARE + (SHARE * whole.column("n").to_numpy() * n) // length
            tf = whole.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
            part = UNIT * tf // (1000 * tf + DAMP * m[own])
            coded = lists.flatten().dictionary_encode()
            code = np.asarray(coded.indices)
            order = np.argsort(code, kind="stable")  # places stay in order
            code, own, part = code[order], own[order], part[order]
            first = np.flatnonzero(np.diff(code, prepend=-1))
            cells = [(pack(np.diff(own[a:b], prepend=0)), pack(part[a:b]), b - a) for a, b in zip(first, [*first[1:], len(code)])]
            words = [IDS, *coded.dictionary.take(pa.array(code[first])).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * len(words), pa.int64()), pa.array(words, pa.string()), pa.array([len(whole), *(c[2] for c in cells)], pa.int64()), pa.array([b"", *(c[0] for c in cells)], pa.binary()),
                    pa.array([b"", *(c[1] for c in cells)], pa.binary()), pa.array([whole.column("doc_id").drop_null().to_pylist(), *[None] * len(cells)], pa.list_(pa.int64())),
                ],
                names,
            )

        for batch in batches:
            while len(batch):
                taken = batch.slice(0, shard_docs - waits)
                batch = batch.slice(len(taken))
                waiting, waits = [*waiting, taken], waits + len(taken)
                if waits == shard_docs:
                    yield put(waiting)
                    shard, waiting, waits = shard + 1, [], 0
        if waits:
            yield put(waiting)

    ranged = counted.where(F.size("terms") > 0).repartitionByRange(max(1, math.ceil(n / shard_docs)), "doc_id", "rid").sortWithinPartitions("doc_id", "rid")
    postings = ranged.select("doc_id", "n", "terms", "tfs").mapInArrow(invert, "shard long, term string, size long, places binary, parts binary, ids array<long>")
    return Index(n, length, frequency, scratch.keep(postings, "postings"))


def search(found: Index, queries: DataFrame, k: int = BEST, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k best documents of each query with a score above 0: item_id, rank, doc_id, score. ``queries``: item_id, text."""
    scratch = Scratch(queries.sparkSession, "ranked")
    kind = dict(queries.dtypes)["item_id"]
    asked = scratch.keep(queries.select(F.monotonically_increasing_id().alias("query"), "item_id", "text"), "queries")
    weight = F.floor(F.lit(float(WEIGHT_UNIT)) * F.log((2.0 * found.docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    used = asked.select("query", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(found.frequency, "term").withColumn("weight", weight).where("weight > 0")
    block = F.pmod(F.xxhash64("query"), F.lit(max(1, math.ceil(asked.count() / block_queries))))
    used = used.groupBy(block.alias("block"), "term").agg(F.collect_list(F.struct("query", "weight")).alias("uses"))
    used = scratch.keep(used, "used")
    asked_ids = used.select("block").distinct().select("block", F.lit(IDS).alias("term"), F.array().cast("array<struct<query:bigint,weight:bigint>>").alias("uses"))
    sent = found.postings.join(used.unionByName(asked_ids), "term").select("shard", "block", "term", "size", "places", "parts", "ids", "uses")

    def rank(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, nulls, lists, by_query, out = None, 0, [], {}, []
        for term, size, places, parts, own, uses in zip(pdf["term"], pdf["size"], pdf["places"], pdf["parts"], pdf["ids"], pdf["uses"]):
            if term == IDS:
                ids, nulls = own, size - len(own)
                continue
            lists.append((np.cumsum(unpack(places)).tolist(), unpack(parts).tolist()))
            for use in uses:
                by_query.setdefault(use["query"], []).append((len(lists) - 1, use["weight"]))
        for query, own in by_query.items():
            out += [(query, key[0], place, None if place < nulls else int(ids[place - nulls]), score) for score, place in best([(*lists[i], w) for i, w in own], k)]
        names = ("query", "shard", "place", "doc_id", "score")
        return pd.DataFrame({n: pd.array([r[i] for r in out], "Int64") for i, n in enumerate(names)})

    each = scratch.keep(sent.groupBy("shard", "block").applyInPandas(rank, "query long, shard long, place long, doc_id long, score long"), "each")
    order = W.partitionBy("query").orderBy(F.desc("score"), "shard", "place")  # shards and places follow doc_id
    merged = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return merged.join(asked.select("query", F.col("item_id").cast(kind).alias("item_id")), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    wanted = items.select(F.explode(terms(F.col("text"))).alias("term")).distinct()
    return search(index(table(spark, sf_dir, "documents"), wanted), items)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
x AS (SELECT doc_id, len(w) AS size, unnest(w) AS t FROM d),
p AS (SELECT doc_id, t, any_value(size) AS size, count(*) AS tf FROM x GROUP BY doc_id, t),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * g.n + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * size * g.n) // g.l)))) AS BIGINT) AS score
  FROM q JOIN f USING (t) JOIN p USING (t), g GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
