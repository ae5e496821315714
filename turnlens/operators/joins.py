"""Joins of explanations, predictions, dialogues and small lookup tables. Small sides are left to adaptive execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["dia_no", "turn_no", "label"]


def join_da_utt_expl(da: DataFrame, utt: DataFrame) -> DataFrame:
    """Both explanations of a turn, with suffixes for columns that are no key."""
    mark = lambda df, s: df.select(*KEY, *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c not in KEY])
    return mark(da, "da").join(mark(utt, "utt"), KEY)


def join_expl_original(expl: DataFrame, turns: DataFrame) -> DataFrame:
    """Adds the turn's text, its acts, the system acts before it, and how many features those take (0 where only the
    user's acts are explained, 1 for the opening default, else their number). Positions come from roles."""
    order = W.partitionBy("dia_no", "label").orderBy("pos")
    before = F.last(F.when(F.col("role") != "user", F.col("acts")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    user = turns.withColumn("sys_acts", before).where("role = 'user'").withColumn("turn_no", F.row_number().over(order) - 1)
    user = user.select(*KEY, "text", "acts", F.coalesce("sys_acts", F.array().cast(dict(turns.dtypes)["acts"])).alias("sys_acts"))
    only_user = F.col("user_only") if "user_only" in expl.columns else F.lit(False)
    n = F.when(only_user, 0).when(F.size("sys_acts") == 0, 1).otherwise(F.size("sys_acts"))
    return expl.join(user, KEY).withColumn("n_sys_da", n)


def join_dia_modalities(da: DataFrame, utt: DataFrame) -> DataFrame:
    return da.join(utt, ["dia_no", "label"])


def join_predictions(expl: DataFrame, predictions: DataFrame) -> DataFrame:
    """Explanations keep their rows; the predictions' keys must be unique, else the plan raises an error."""
    checked = predictions.groupBy(*KEY).agg(F.count("*").alias("_n"), F.max("pred").alias("pred"))
    once = checked.withColumn("pred", F.when(F.col("_n") > 1, F.raise_error(F.lit("a turn has several predictions")).cast("int")).otherwise(F.col("pred"))).drop("_n")
    return expl.join(once, KEY, "left")


def lookup_profile(acts: DataFrame, words: DataFrame, profile: DataFrame) -> DataFrame:
    """Scores of each turn's words (turn key, ngram) from the profiles of its acts (turn key, intent, domain, slot), added
    up; a turn none of whose acts has a profile takes the global one. Words meet profiles on the n-gram, never as a product."""
    on = ["intent", "domain", "slot"]
    act = profile.where("scope = 'act'").select(*on, "ngram", "score")
    known = acts.join(act.select(*on).distinct(), on, "left_semi").select(*KEY, *on).distinct()
    own = words.join(known, KEY).join(act, [*on, "ngram"]).groupBy(*KEY, "ngram").agg(F.sum("score").alias("score"))
    without = words.join(known.select(*KEY).distinct(), KEY, "left_anti")
    return own.unionByName(without.join(profile.where("scope = 'global'").select("ngram", "score"), "ngram").select(*KEY, "ngram", "score"))


def lookup_slot_desc(df: DataFrame, slots: DataFrame) -> DataFrame:
    """``slot_text``: the slot's description if there is one, else its name."""
    named = slots.select("slot", F.col("description").alias("_desc"))
    return df.join(named, "slot", "left").withColumn("slot_text", F.coalesce("_desc", "slot")).drop("_desc")


def containment_self(phrases: DataFrame) -> DataFrame:
    """Pairs (long, short) of phrases of one scope where short is a run of long's words. Pairs meet on the rarest word of
    the short phrase, not on all pairs of a scope."""
    words = phrases.select("scope", "phrase", F.split("phrase", " ").alias("w"))
    each = words.select("scope", "phrase", F.explode(F.array_distinct("w")).alias("word"))
    count = each.groupBy("scope", "word").agg(F.count("*").alias("n"))
    rarest = each.join(count, ["scope", "word"]).groupBy("scope", "phrase").agg(F.min(F.struct("n", "word")).alias("m")).select("scope", F.col("phrase").alias("short"), F.col("m.word").alias("word"))
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    met = each.select("scope", F.col("phrase").alias("long"), "word").join(rarest, ["scope", "word"])
    return met.where((F.col("long") != F.col("short")) & F.contains(pad(F.col("long")), pad(F.col("short")))).select("scope", "long", "short").distinct()
