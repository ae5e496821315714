"""Conversations as dialogue tables.

``turns`` is the working form: dia_no, label, pos, role (user or system), text on one line, and acts. The acts of the
test tables are a deterministic surrogate (one act per sentence), not the result of language understanding; so is the
label, the parity of the conversation id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACT = "struct<intent:string,domain:string,slot:string,value:string>"
ACTS = f"array<{ACT}>"
INTENTS, SLOTS = ("inform", "request", "greet", "thank", "bye"), ("name", "price", "")


def act(intent, domain, slot, value) -> Column:
    to = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(to(intent).alias("intent"), to(domain).alias("domain"), to(slot).alias("slot"), to(value).alias("value"))


def none_da() -> Column:
    """The acts of an utterance without acts."""
    return F.array(act("none", "", "", ""))


def greet_da() -> Column:
    return F.array(act("greet", "general", "", ""))


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def surrogate_acts(text: Column) -> Column:
    """One act per sentence: intent by the first word's length, slot by the last word's, which is also its value."""
    sentences = F.filter(F.split(text, "[.?!]+ *"), lambda s: F.trim(s) != "")

    def of(sentence: Column) -> Column:
        words = F.split(F.trim(sentence), " +")
        first, last = F.get(words, F.lit(0)), F.element_at(words, -1)
        slot = F.element_at(F.array(*map(F.lit, SLOTS)), F.length(last) % 3 + 1)
        return act(F.element_at(F.array(*map(F.lit, INTENTS)), F.length(first) % 5 + 1), "general", slot, F.when(slot == "", "").otherwise(last))

    return F.transform(sentences, of)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    role = F.when(F.col("role") == "user", "user").otherwise("system")
    base = c.select(F.col("conv_id").alias("dia_no"), (F.col("conv_id") % 2).cast("int").alias("label"), F.col("turn").cast("int").alias("pos"), role.alias("role"), one_line(F.col("text")).alias("text"))
    return base.withColumn("acts", surrogate_acts(F.col("text")))


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with their dense number from 0."""
    numbered = F.row_number().over(W.partitionBy("dia_no", "label").orderBy("pos")) - 1
    return turns(spark, sf_dir).where("role = 'user'").withColumn("turn_no", numbered)


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dia_no, label, dia (lines ``role: text``) and lines, an array of (pos, role, text, acts)."""
    lines = F.array_sort(F.collect_list(F.struct("pos", "role", "text", "acts")))
    grouped = turns(spark, sf_dir).groupBy("dia_no", "label").agg(lines.alias("lines"))
    return grouped.withColumn("dia", F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n"))


def lexicon_weight(token: Column) -> Column:
    """The surrogate scorer's weight of a token."""
    return (F.length(token) % 5 - 2) / F.lit(10.0)


def explained_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token attributions of the linear surrogate scorer: dia_no, label, turn_no, idx, token, score."""
    u = user_turns(spark, sf_dir).select("dia_no", "label", "turn_no", F.posexplode(tokens(F.col("text"))).alias("idx", "token"))
    return u.withColumn("score", lexicon_weight(F.col("token")))


def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user turn: dia_no, label, turn_no, n_features and explanation, an array of (idx, text, score)."""
    u = user_turns(spark, sf_dir).withColumn("tok", tokens(F.col("text")))
    e = F.transform("tok", lambda t, i: F.struct(i.alias("idx"), t.alias("text"), lexicon_weight(t).alias("score")))
    return u.select("dia_no", "label", "turn_no", F.size("tok").alias("n_features"), e.alias("explanation"), "tok", "acts", "text")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surrogate detector: logit is the sum of weights, probability its sigmoid. dia_no, label, turn_no, logit, prob, pred."""
    e = explanations(spark, sf_dir)
    logit = F.aggregate("explanation", F.lit(0.0), lambda a, x: a + x["score"])
    return e.select("dia_no", "label", "turn_no", F.round(logit, 6).alias("logit")).withColumn("prob", 1 / (1 + F.exp(-F.col("logit")))).withColumn("pred", (F.col("prob") >= 0.5).cast("int"))
