"""Profile plans over the test conversations: n-grams of user turns, by acts of the turn and over all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as PR
from ..sources import conversations as C

KEY = ["dia_no", "label", "turn_no"]


def turn_acts(spark: SparkSession, d: str) -> DataFrame:
    rows = C.user_turns(spark, d).select(*KEY, F.posexplode("acts").alias("act_i", "a"))
    return rows.select(*KEY, "act_i", "a.intent", "a.domain", "a.slot", "a.value")


def turn_ngrams(spark: SparkSession, d: str, max_n: int = 3) -> DataFrame:
    e = C.explanations(spark, d)
    grams = PR.ngrams(F.transform("tok", lambda t: F.lower(t)), F.transform("explanation", lambda x: x["score"]), max_n)
    return e.select(*KEY, F.explode(grams).alias("g")).select(*KEY, F.col("g.ngram").alias("ngram"), F.round("g.score", 9).alias("score"))


def profile_rows(spark: SparkSession, d: str, max_n: int = 3) -> DataFrame:
    return turn_ngrams(spark, d, max_n).join(turn_acts(spark, d).select(*KEY, "intent", "domain", "slot").distinct(), KEY)


def profile(spark: SparkSession, d: str, name: str = "fwlor", max_n: int = 3) -> DataFrame:
    return PR.profile_build(profile_rows(spark, d, max_n), name)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The twenty strongest n-grams of each class over all user turns, by frequency-weighted log odds."""
    rows = turn_ngrams(spark, d).withColumns({"intent": F.lit(""), "domain": F.lit(""), "slot": F.lit("")})
    top = PR.top_profile(profile_global(rows).withColumn("score", F.round("score", 6)), 20)
    return top.select("side", "rank", "ngram", "score")


def profile_global(rows: DataFrame, name: str = "fwlor") -> DataFrame:
    return PR.metric(PR.profile_counts(rows, acts=False), name)
