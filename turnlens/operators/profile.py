"""Corpus profiles: n-grams with scores, counted by class within each act and over all, and six metrics over the counts.

``scope`` is ``act`` (then intent, domain and slot name it) or ``global`` (then they are empty). One aggregation over
grouping sets gives all scopes; metrics are arithmetic over counts and scope totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import let

SCOPE = ["scope", "intent", "domain", "slot"]
#: The prior's weight, the term that keeps denominators from 0.
PRIOR, TINY = 2.0, 1e-9


def ngrams(toks: Column, scores: Column, max_n: int) -> Column:
    """All n-grams of n = 1 .. max_n with the mean score of their tokens, as an array of (ngram, score)."""
    return let(toks, lambda t: let(scores, lambda s: _ngrams(t, s, max_n)))


def _ngrams(toks: Column, scores: Column, max_n: int) -> Column:
    size = F.least(F.size(toks), F.size(scores))

    def of(n: Column) -> Column:
        starts = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.array_join(F.slice(toks, i, n), " ").alias("ngram"), (F.aggregate(F.slice(scores, i, n), F.lit(0.0), lambda a, x: a + x) / n).alias("score")))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(max_n)), of))


def profile_counts(rows: DataFrame, acts: bool = True) -> DataFrame:
    """Rows (intent, domain, slot, ngram, score) to counts and score sums by class and scope: a positive score speaks for
    the machine (a_n, a_s), a negative one for the human (b_n, b_s), 0 for neither. Without ``acts`` only the scope of all."""
    per = rows.where("score <> 0").withColumn("ngram", F.lower("ngram"))
    sums = [F.sum((F.col("score") > 0).cast("long")).alias("a_n"), F.sum((F.col("score") < 0).cast("long")).alias("b_n"), F.sum(F.when(F.col("score") > 0, F.col("score")).otherwise(0.0)).alias("a_s"), F.sum(F.when(F.col("score") < 0, F.col("score")).otherwise(0.0)).alias("b_s")]
    if not acts:  # one row for each n-gram goes to the shuffle, not two
        return per.groupBy("ngram").agg(*sums).select(F.lit("global").alias("scope"), *[F.lit("").alias(c) for c in ("intent", "domain", "slot")], "ngram", "a_n", "b_n", "a_s", "b_s")
    keys = [F.col(c) for c in ("intent", "domain", "slot", "ngram")]
    grouped = per.groupingSets([keys, [F.col("ngram")]], *keys).agg(*sums, F.grouping("intent").alias("all"))
    empty = lambda c: F.when(F.col("all") == 1, "").otherwise(F.col(c)).alias(c)
    return grouped.select(F.when(F.col("all") == 1, "global").otherwise("act").alias("scope"), *[empty(c) for c in ("intent", "domain", "slot")], "ngram", "a_n", "b_n", "a_s", "b_s")


def metric(counts: DataFrame, name: str, alpha: float = 0.5) -> DataFrame:
    """One score of each n-gram of each scope. Totals are over the scope's n-grams of all orders."""
    by_score = name in ("lsr", "fwlsr", "agg_s")
    a, b = (F.abs("a_s"), F.abs("b_s")) if by_score else (F.col("a_n").cast("double"), F.col("b_n").cast("double"))
    rows = counts.select(*SCOPE, "ngram", a.alias("a"), b.alias("b"))
    totals = rows.groupBy(*SCOPE).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    rows = rows.join(totals, SCOPE)  # small where the ontology is: adaptive execution then broadcasts it
    a, b, ta, tb = (F.col(c) for c in ("a", "b", "ta", "tb"))
    if name.startswith("agg"):
        share = lambda x, t: F.when(t == 0, 0.0).otherwise(x / t)
        score = (1 / alpha) * share(a, ta) + (1 - 1 / alpha) * share(b, tb)
    else:
        own = PRIOR * (a + b) / (ta + tb)
        logit = lambda x, t: F.log((x + own) / (t + PRIOR - x - own + TINY))
        delta = logit(a, ta) - logit(b, tb)
        if name in ("lor", "lsr"):
            score = delta / F.sqrt(1 / (a + own + TINY) + 1 / (b + own + TINY))
        else:
            score = delta * F.sqrt((a + own) / (ta + PRIOR) + (b + own) / (tb + PRIOR))
    return rows.select(*SCOPE, "ngram", score.alias("score"))


def profile_build(rows: DataFrame, name: str = "fwlor", alpha: float = 0.5) -> DataFrame:
    return metric(profile_counts(rows), name, alpha)


def distinct_da(acts: DataFrame) -> DataFrame:
    """Acts without values, once each."""
    return acts.select("intent", "domain", "slot").distinct()


def with_empty_scopes(profile: DataFrame, acts: DataFrame) -> DataFrame:
    """Adds an empty row (null n-gram) for each act that has no n-grams."""
    return distinct_da(acts).withColumn("scope", F.lit("act")).join(profile.where("scope = 'act'"), SCOPE, "left").unionByName(profile.where("scope = 'global'"))


def sum_profiles(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "ngram").agg(F.sum("score").alias("score"))


def top_profile(profile: DataFrame, n: int = 20) -> DataFrame:
    """Per scope the n strongest n-grams of each class; human scores are turned positive."""
    rows = profile.where("score <> 0").withColumn("side", F.when(F.col("score") > 0, "ai").otherwise("human"))
    order = W.partitionBy(*SCOPE, "side").orderBy(F.abs("score").desc(), "ngram")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).withColumn("score", F.abs("score"))


def consecutive_spans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of consecutive idx become phrases: text, mean score, first idx."""
    island = F.col("idx") - F.row_number().over(W.partitionBy(*keys).orderBy("idx"))
    parts = F.array_sort(F.collect_list(F.struct("idx", "token", "score")))
    out = rows.withColumn("_island", island).groupBy(*keys, "_island").agg(parts.alias("p"))
    return out.select(*keys, F.get("p", F.lit(0))["idx"].alias("first"), F.transform("p", lambda x: x["token"]).alias("tokens"), F.transform("p", lambda x: x["score"]).alias("scores"), F.array_join(F.transform("p", lambda x: x["token"]), " ").alias("phrase"))


def slot_tag(text: Column, value: Column, slot: Column) -> Column:
    """Words of the value become ``<slot>``, in any letter case, and runs of the tag one tag."""
    escape = lambda t: F.regexp_replace(t, r"([^\p{L}\p{N}])", r"\\$1")
    words = F.filter(F.split(value, r"(?U)\s+"), lambda t: t != "")
    pattern = F.concat(F.lit(r"(?iU)(?<!\w)(?:"), F.array_join(F.transform(words, escape), "|"), F.lit(r")(?!\w)"))
    tag = F.concat(F.lit("<"), slot, F.lit(">"))
    tagged = F.when((F.size(words) > 0) & (slot != ""), F.regexp_replace(text, pattern, tag)).otherwise(text)
    run = F.concat(F.lit("("), escape(tag), F.lit(r")(?:\s+"), escape(tag), F.lit(")+"))
    return F.when(slot != "", F.regexp_replace(tagged, run, F.lit("$1"))).otherwise(tagged)


def phrases(rows: DataFrame, keys: list[str], value: str | None = None, slot: str | None = None) -> DataFrame:
    """Spans of rows (keys, idx, token, score) with utt_expl, the mean of their scores. With the columns ``value`` and
    ``slot``, functions of the keys, words of the value become the slot's tag; a run of one tag becomes one token that
    takes the run's mean score, so a phrase's tokens and scores keep one length."""
    own = keys if value is None else [*keys, value, slot]
    spans = consecutive_spans(rows, own)
    spans = spans.withColumn("utt_expl", F.aggregate("scores", F.lit(0.0), lambda a, x: a + x) / F.size("scores"))
    if value is None:
        return spans
    tag = F.concat(F.lit("<"), F.col(slot), F.lit(">"))
    tagged = F.transform("tokens", lambda t: F.when((F.col(slot) != "") & (F.col(value) != ""), slot_tag(t, F.col(value), F.col(slot))).otherwise(t))
    spans = spans.withColumn("tokens", tagged).withColumn("both", collapse_scores(F.col("tokens"), F.col("scores"), tag))
    spans = spans.withColumn("tokens", F.col("both.t")).withColumn("scores", F.col("both.s")).drop("both")
    return spans.withColumn("phrase", F.array_join("tokens", " "))


def collapse_scores(toks: Column, scores: Column, tag: Column) -> Column:
    """Tokens t and scores s, with runs of one tag as one token with the run's mean score."""
    start = F.struct(F.array().cast("array<string>").alias("t"), F.array().cast("array<double>").alias("s"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        again = (F.size(acc["t"]) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc["t"]), -1) == tag) & (x["t"] == tag)
        n = F.size(acc["s"])
        mean = (F.coalesce(F.get(acc["s"], n - 1), F.lit(0.0)) * acc["n"] + x["s"]) / (acc["n"] + 1)
        return F.when(again, F.struct(acc["t"].alias("t"), F.concat(F.slice(acc["s"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(mean)).alias("s"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(acc["t"], F.array(x["t"])).alias("t"), F.concat(acc["s"], F.array(x["s"])).alias("s"), F.lit(1).alias("n")))

    return F.aggregate(F.arrays_zip(toks.alias("t"), scores.alias("s")), start, step, lambda acc: F.struct(acc["t"].alias("t"), acc["s"].alias("s")))
