"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is so many consecutive words of an item (or all words of a shorter item). Its tokens are word shingles with
their offsets. Tokens are ordered by rarity in the documents; containment of the whole window makes a prefix of one
token necessary, so only occurrences of each window's rarest token become candidates. Positional and length bounds drop
candidates that would begin before or end after the document; the rest are verified exactly: every token of the window
must occur at its own offset. One pass over the texts writes where benchmark shingles occur, compared word by word, and
all later steps work on that table. In that pass a bit filter of the benchmark's shingle hashes, of fixed size, drops nearly
all words before they are joined; the plan is the same for benchmarks of any size.

Defined cases: a null or empty text, of a document or item, has no words; repeated rows and repeated ids are judged row
by row; items with the same id count once; a null item_id counts as one item and is written as the empty string; an
empty benchmark hits nothing; of tokens that are equally rare the one written first is a window's prefix, which changes no
result; very long texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table

#: Fixed values of the contract: what separates words, and words of a window.
SEPARATOR, WINDOW = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", 10
SHINGLE = 3
#: Bits of the filter that words of documents pass before any join; more benchmark shingles only let more words through.
FILTER_BITS = 1 << 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words with A-Z lower-cased; other letters stay as they are."""
    text = F.coalesce(text, F.lit(""))
    small = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(small, SEPARATOR), "")


def _token(array: Column, at: Column, size: int) -> list[Column]:
    return [F.get(array, at + i) for i in range(size)]


def windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item_id, content (the window's words), len, tokens: array of (off, k, words of the token)."""
    own = items.select(F.coalesce(items["item_id"].cast("string"), F.lit("")).alias("item_id"), words(items["text"]).alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))))
    cut = own.select("item_id", "w", at.alias("at")).select("item_id", F.slice("w", F.col("at") + 1, window).alias("content"))
    k = F.least(F.lit(shingle), F.size("content"))
    offsets = F.sequence(F.lit(0), F.size("content") - k)
    tokens = F.transform(offsets, lambda o: F.struct(o.alias("off"), k.alias("k"), F.slice("content", o + 1, k).alias("t")))
    return cut.select("item_id", "content", F.size("content").alias("len"), tokens.alias("tokens")).distinct()


def shingle_filter(tokens: DataFrame) -> DataFrame:
    """One row, one column: FILTER_BITS bits as an array of numbers, with a bit for each token's hash."""
    bit = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = tokens.select(F.shiftright(bit, 6).alias("id"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("b")).groupBy("id").agg(F.bit_or("b").alias("b"))
    every = tokens.sparkSession.range(FILTER_BITS // 64).join(words, "id", "left").select("id", F.coalesce("b", F.lit(0)).alias("b"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "b"))), lambda x: x["b"]).alias("bits"))


def occurrences(docs: DataFrame, tokens: DataFrame, sizes: list[int]) -> DataFrame:
    """One pass over the texts: rid, doc_id, text_hash, n_words, pos, sid for each benchmark token in a document, and a row
    with null sid for each document."""
    base = docs.select(F.monotonically_increasing_id().alias("rid"), docs["doc_id"], F.xxhash64(docs["text"]).alias("text_hash"), words(docs["text"]).alias("w"))
    # The place behind the last word stands for the document. It has a key of its own there, which no token has.
    spots = base.select("rid", "doc_id", "text_hash", "w", F.size("w").alias("n_words"), F.explode(F.sequence(F.lit(0), F.size("w"))).alias("pos"))
    end = F.col("pos") == F.col("n_words")
    hashed = lambda k: F.when(F.col("pos") + k <= F.col("n_words"), F.xxhash64(*_token(F.col("w"), F.col("pos"), k)))
    if len(sizes) < 2:
        k = (sizes or [SHINGLE])[0]
        keyed = spots.select("*", F.when(end, 0).otherwise(k).alias("k"), F.when(end, F.xxhash64("rid")).otherwise(hashed(k)).alias("h"))
    else:
        each = F.when(end, F.array(F.struct(F.lit(0).alias("k"), F.xxhash64("rid").alias("h")))).otherwise(F.array(*[F.struct(F.lit(k).alias("k"), hashed(k).alias("h")) for k in sizes]))
        keyed = spots.select("*", F.explode(each).alias("e")).select("rid", "doc_id", "text_hash", "w", "n_words", "pos", "e.k", "e.h")
    bit = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    there = F.call_function("shiftright", F.get(shingle_filter(tokens).scalar(), F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    passed = keyed.where((F.col("k") == 0) | (F.col("h").isNotNull() & there))
    passed = passed.select("rid", "doc_id", "text_hash", "n_words", "pos", "k", "h", F.when(F.col("k") > 0, F.slice("w", F.col("pos") + 1, F.col("k"))).alias("t"))
    found = passed.join(tokens, ["k", "h"], "left").where((F.col("k") == 0) | (F.col("t") == F.col("token")))
    return found.select("rid", "doc_id", "text_hash", "n_words", "pos", "sid")


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: rid, doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    every = scratch.keep(windows(items, window), "windows")
    own = every.select(F.explode("tokens").alias("x")).select(F.col("x.k").alias("k"), F.col("x.t").alias("token")).distinct()
    h = F.when(F.col("k") == 1, F.xxhash64(F.get("token", F.lit(0)))).when(F.col("k") == 2, F.xxhash64(*_token(F.col("token"), F.lit(0), 2))).otherwise(F.xxhash64(*_token(F.col("token"), F.lit(0), 3)))
    tokens = scratch.keep(own.select("k", "token", h.alias("h"), F.monotonically_increasing_id().alias("sid")), "tokens")
    sizes = sorted(r["k"] for r in tokens.select("k").distinct().collect())
    seen = scratch.keep(occurrences(docs, tokens, sizes), "seen")
    spots = seen.where("sid is not null").select("rid", "n_words", "pos", "sid").distinct()

    # Rarity decides each window's prefix token. A window with a token that no document holds cannot occur.
    rarity = spots.groupBy("sid").agg(F.count("*").alias("n"))
    contents = every.groupBy("content", "len").agg(F.first("tokens").alias("tokens")).withColumn("cid", F.xxhash64("content"))
    token_rows = contents.select("cid", "content", "len", F.explode("tokens").alias("x")).select("cid", "content", "len", F.col("x.off").alias("off"), F.col("x.k").alias("k"), F.col("x.t").alias("token"))
    known = token_rows.join(tokens.select("k", "token", "sid"), ["k", "token"]).join(rarity, "sid", "left")
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "sid", "off")))
    prefix = known.groupBy("cid", "content", "len").agg(ordered.alias("by_rarity")).where(F.col("by_rarity")[0]["n"] > 0)
    prefix = scratch.keep(prefix.select("cid", "content", "len", F.col("by_rarity")[0]["sid"].alias("sid"), F.col("by_rarity")[0]["off"].alias("off"), F.transform("by_rarity", lambda t: F.struct(t["sid"].alias("sid"), t["off"].alias("off"))).alias("needs")), "prefix")
    candidates = spots.join(prefix.select("sid", "off", "cid", "len", "needs"), "sid").withColumn("at", F.col("pos") - F.col("off")).where((F.col("at") >= 0) & (F.col("at") + F.col("len") <= F.col("n_words")))
    wanted = candidates.select("rid", "at", "cid", "len", F.size("needs").alias("n"), F.explode("needs").alias("x")).select("rid", "at", "cid", "len", "n", (F.col("at") + F.col("x.off")).alias("pos"), F.col("x.sid").alias("sid"))
    proven = wanted.join(spots.select("rid", "pos", "sid"), ["rid", "pos", "sid"]).groupBy("rid", "at", "cid", "len", "n").agg(F.count("*").alias("met")).where("met = n")
    proven = scratch.keep(proven.select("rid", "at", "cid", "len"), "proven")

    before = W.partitionBy("rid").orderBy("at", "end").rowsBetween(W.unboundedPreceding, -1)
    spans = proven.select("rid", "at", (F.col("at") + F.col("len")).alias("end")).distinct()
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("at"), F.coalesce(F.max("end").over(before), F.lit(0))))
    hits = spans.select("rid", fresh.alias("fresh")).groupBy("rid").agg(F.sum("fresh").alias("n_hit"))
    item_of = every.select(F.xxhash64("content").alias("cid"), "item_id").distinct()
    lists = proven.select("rid", "cid").distinct().join(item_of, "cid").groupBy("rid").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = seen.where("sid is null").select("rid", "doc_id", "text_hash", "n_words").distinct().join(hits, "rid", "left").join(lists, "rid", "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "rid", "doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rid", "text_hash")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS c
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS c
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.c = bw.c AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
