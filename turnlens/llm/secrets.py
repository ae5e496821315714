"""Secret scanning with multipart credential linking, in DataFrame operations only.

Three base kinds are found by pattern alone: assignments to secret names, access identifiers and long hexadecimal runs.
Three weak kinds say little by themselves: names of identities, long random-looking runs, and endpoints. An interval
join within a scope of so many code points reports a weak identity next to a secret, a weak secret next to an identity,
and an endpoint next to both; weak candidates without their complement stay unreported. Where base and weak candidates
cover the same place only the base span stays.

Positions come without a UDF: matches of a pattern and the gaps that splitting by the same pattern leaves alternate, so
running sums of their lengths in code points are the starts. One pass over the texts writes the lengths; everything
after works on those few numbers, and the interval join meets in buckets of one scope, so its pairs are bounded by it.

Defined cases: a null or empty text has no spans; repeated rows and ids are scanned row by row; spans that begin at one
place are listed in the order of kinds; very long texts are scanned whole; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table

#: Fixed values of the contract, in its order: kind, pattern, group whose length counts, least length. Runs are greedy,
#: so asking for the least length in the pattern of a plain run gives the same spans as dropping short runs after.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: The operator's own weak kinds.
WEAK = (
    ("identity", r"""(?i:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", 1, 4),
    ("random", r"[A-Za-z0-9+/_=-]{32,}", 0, 32),
    ("endpoint", r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20"'<>]+""", 0, 8),
)
SCOPE = 256
IDENTITY, SECRET = ("access", "identity"), ("assign", "hex", "random")
ORDER = tuple(k for k, *_ in (*BASE, *WEAK))


def _matches(text: Column, kind: int, pattern: str, group: int, least: int, cheap: Column | None) -> Column:
    """(kind, lengths of matches, whether each is long enough, lengths of the gaps before each)."""
    size = lambda xs: F.transform(xs, F.length)
    p = F.lit(pattern)
    there = text.rlike(pattern) if cheap is None else cheap & text.rlike(pattern)
    gaps, whole = size(F.split(text, pattern, -1)).alias("g"), size(F.regexp_extract_all(text, p, F.lit(0)))
    if group:
        found = F.struct(F.lit(kind).alias("kind"), whole.alias("m"), F.transform(F.regexp_extract_all(text, p, F.lit(group)), lambda x: F.length(x) >= least).alias("ok"), gaps)
    else:  # the match itself is what has to be long enough: look for it once
        found = F.get(F.transform(F.array(whole), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("m"), F.transform(m, lambda n: n >= least).alias("ok"), gaps)), F.lit(0))
    return F.when(there, found)


def _spans(found: DataFrame) -> DataFrame:
    """rid, kind, start, end of the matches that are long enough."""
    rows = found.select("rid", F.explode("kinds").alias("k")).select("rid", "k.kind", F.posexplode(F.arrays_zip(F.col("k.m").alias("m"), F.col("k.ok").alias("ok"), F.slice("k.g", F.lit(1), F.size("k.m")).alias("g"))).alias("i", "z"))
    rows = rows.select("rid", "kind", "i", F.col("z.m").alias("m"), F.col("z.ok").alias("ok"), F.col("z.g").alias("g"))
    end = F.sum(F.col("m") + F.col("g")).over(W.partitionBy("rid", "kind").orderBy("i"))
    return rows.withColumn("end", end.cast("long")).where("ok").select("rid", "kind", (F.col("end") - F.col("m")).alias("start"), "end")


def _near(weak: DataFrame, others: DataFrame, scope: int) -> DataFrame:
    """Rows of ``weak`` with a row of ``others`` of the same document no further than ``scope`` code points off."""
    one, two = weak.withColumn("bucket", F.floor(F.col("start") / scope)), others.select(F.col("rid").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"))
    # A candidate may be longer than a scope: it meets from the bucket of its start on both sides of the other span.
    two = two.withColumn("b", F.explode(F.sequence(F.floor(F.col("s") / scope) - 1, F.floor(F.col("e") / scope) + 1)))
    long_ = one.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))))
    apart = (F.col("s") - F.col("end") <= scope) & (F.col("start") - F.col("e") <= scope) & ((F.col("s") >= F.col("end")) | (F.col("e") <= F.col("start")))
    return long_.join(two, (F.col("rid") == F.col("r")) & (F.col("bucket") == F.col("b")) & apart, "left_semi").drop("bucket").distinct()


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    scratch = Scratch(docs.sparkSession, "secrets")
    text = F.coalesce(docs["text"], F.lit(""))
    cheap = {"access": F.contains(text, F.lit("AKIA")), "endpoint": F.contains(text, F.lit("://"))}
    kinds = F.array_compact(F.array(*[_matches(text, i, p, g, n, cheap.get(k)) for i, (k, p, g, n) in enumerate((*BASE, *WEAK))]))
    found = scratch.keep(docs.select(F.monotonically_increasing_id().alias("rid"), docs["doc_id"], kinds.alias("kinds")), "found")
    spans = scratch.keep(_spans(found.where(F.size("kinds") > 0)), "spans")
    base = spans.where(F.col("kind") < len(BASE))
    of = lambda names: spans.where(F.col("kind").isin([ORDER.index(n) for n in names]))
    weak = spans.where(F.col("kind") >= len(BASE))
    two = base.select(F.col("rid").alias("r"), F.col("start").alias("s"), F.col("end").alias("e")).withColumn("b", F.explode(F.sequence(F.floor(F.col("s") / scope), F.floor(F.col("e") / scope))))
    one = weak.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))))
    covered = one.join(two, (F.col("rid") == F.col("r")) & (F.col("bucket") == F.col("b")) & (F.col("s") < F.col("end")) & (F.col("start") < F.col("e")), "left_semi").drop("bucket").distinct()
    open_ = weak.join(covered, ["rid", "kind", "start", "end"], "left_anti")
    kind = lambda name: open_.where(F.col("kind") == ORDER.index(name))
    linked = _near(kind("identity"), of(SECRET), scope).unionByName(_near(kind("random"), of(IDENTITY), scope)).unionByName(_near(_near(kind("endpoint"), of(IDENTITY), scope), of(SECRET), scope))
    every = base.unionByName(linked)
    put = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, ORDER)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    per_doc = every.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    out = found.select("rid", "doc_id").join(per_doc, "rid", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    count = lambda name: F.size(F.filter("all", lambda s: s["kind"] == ORDER.index(name))).cast("long")
    of_base = F.filter("all", lambda s: s["kind"] < len(BASE))
    return out.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(put(of_base).cast("binary"), 256).alias("base_sha256"), put(F.col("all")).alias("spans"),
        F.size(F.filter("all", lambda s: s["kind"] >= len(BASE))).cast("long").alias("n_linked"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
