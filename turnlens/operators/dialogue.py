"""Shaping dialogues: lines, user turns, previous acts, model sequences, prefixes and their inverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import CLS, DA_SEP, SEP, SLOT_SEP, SYSTEM_MARK, USER_MARK
from ..sources.conversations import greet_da, none_da


#: Rows of a ring in which rows exchange their values, and batches of a part.
RING, PART_BATCHES = 1000, 64


def range_to(n: Column) -> Column:
    """0 to n - 1; empty where n is 0, as sequence() would count down."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def fill_turn_no(df: DataFrame) -> DataFrame:
    """``turn_nos``: the one given number, or all user turns of the dialogue by how often ``user: `` occurs in it."""
    n = ((F.length("dia") - F.length(F.replace(F.col("dia"), F.lit("user: "), F.lit("")))) / 6).cast("int")
    return df.withColumn("turn_nos", F.when(F.col("turn_no").isNotNull(), F.array(F.col("turn_no").cast("int"))).otherwise(range_to(n)))


def dia_explode(df: DataFrame, role: str = "user") -> DataFrame:
    """The lines of one role, numbered from 0 in order: turn_no indexes the dialogue's own ``turn_nos`` if it has them."""
    lines = df.select("*", F.posexplode(F.split("dia", "\n")).alias("pos", "line")).where(F.col("line").startswith(f"{role}:"))
    nth = F.row_number().over(W.partitionBy("dia_no", "label").orderBy("pos")) - 1
    own = F.coalesce(F.get("turn_nos", F.col("nth")), F.col("nth")) if "turn_nos" in df.columns else F.col("nth")
    return lines.withColumn("nth", nth).withColumn("turn_no", own).withColumn("text", F.trim(F.expr(f"substring(line, {len(role) + 2})"))).drop("nth")


def role_lines(dia: Column, role: str) -> Column:
    return F.filter(F.split(dia, "\n"), lambda x: x.startswith(f"{role}:"))


def every_second_line(dia: Column) -> Column:
    """Lines 0, 2, 4, ... without their six characters of role."""
    return F.transform(F.filter(F.split(dia, "\n"), lambda x, i: i % 2 == 0), lambda x: F.substr(x, F.lit(7)))


def utt_sequence(text: Column) -> Column:
    bare = F.replace(F.replace(text, F.lit("user:"), F.lit("")), F.lit("system:"), F.lit(""))
    return F.concat(F.lit(f"{CLS} "), F.trim(bare))


def acts_or_none(acts: Column) -> Column:
    return F.when(acts.isNull() | (F.size(acts) == 0), none_da()).otherwise(acts)


def da_turn(turns: DataFrame) -> DataFrame:
    """User turns with the acts of the last system line before them. A dialogue that the user opens begins after a greeting."""
    order = W.partitionBy("dia_no", "label").orderBy("pos")
    opened = F.first("role").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    last = F.last(F.when(F.col("role") != "user", acts_or_none(F.col("acts"))), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = turns.withColumn("prev_acts", F.coalesce(last, F.when(opened == "user", greet_da()).otherwise(none_da())))
    return rows.where("role = 'user'").withColumn("acts", acts_or_none(F.col("acts"))).withColumn("turn_no", F.row_number().over(order) - 1)


def _parts(a: Column, use_value: bool, drop_empty: bool) -> Column:
    parts = F.array(a["intent"], a["domain"], a["slot"], *[a["value"]] * use_value)
    return F.filter(parts, lambda p: p != "") if drop_empty else parts


def _is_none(acts: Column) -> Column:
    return (F.size(acts) == 1) & (F.get(acts, F.lit(0))["intent"] == "none")


def serial_acts(acts: Column, use_value: bool, drop_empty: bool = False) -> Column:
    """The acts as text. With ``drop_empty`` an act is its parts that are not empty, without marks between them."""
    between = " " if drop_empty else f" {SLOT_SEP} "
    body = F.array_join(F.transform(acts, lambda a: F.array_join(_parts(a, use_value, drop_empty), between)), f" {DA_SEP} ")
    return F.when(_is_none(acts), F.lit("none")).otherwise(body)


def da_sequence(prev: Column, acts: Column, use_value: bool = False, use_turn: bool = True) -> Column:
    """``CLS previous SEP own SEP``; empty slots stay, so the places of an act's parts are fixed."""
    own = F.concat(serial_acts(acts, use_value), F.lit(f" {SEP}"))
    return F.concat(F.lit(f"{CLS} "), F.concat(serial_acts(prev, use_value), F.lit(f" {SEP} "), own) if use_turn else own)


def _combined(marked: Column, said: Column, use_da: bool, use_utt: bool) -> Column:
    """``CLS acts SEP <usr> utterance <usr> utterance``, or one side alone."""
    utterances = F.concat(F.lit(f"{USER_MARK} "), F.array_join(said, f" {USER_MARK} "))
    return F.concat_ws(" ", F.lit(CLS), *[F.array_join(marked, " ")] * use_da, *[F.lit(SEP)] * (use_da and use_utt), *[utterances] * use_utt)


def _marked(user: Column, acts: Column, use_value: bool) -> Column:
    return F.concat(F.when(user, F.lit(f"{USER_MARK} ")).otherwise(F.lit(f"{SYSTEM_MARK} ")), serial_acts(acts_or_none(acts), use_value, True))


def da_utt_sequence(lines: Column, use_value: bool = False, use_da: bool = True, use_utt: bool = True) -> Column:
    """One sequence of a whole dialogue: acts with role marks, empty parts dropped, and the user's utterances."""
    marked = F.transform(lines, lambda x: _marked(x["role"] == "user", x["acts"], use_value))
    return _combined(marked, F.transform(F.filter(lines, lambda x: x["role"] == "user"), lambda x: x["text"]), use_da, use_utt)


def da_utt(dialogues: DataFrame, use_turn: bool = True, use_value: bool = False, use_da: bool = True, use_utt: bool = True) -> DataFrame:
    """Masked dialogues (masked_da, masked_utt and any further columns) with input_sequence and sample: their acts, and at the end one
    pseudo-act that holds the text. In turn mode acts go user, system, user; else all are the user's."""
    marked = F.transform("masked_da", lambda acts, i: _marked((i % 2 == 0) | F.lit(not use_turn), acts, use_value))
    text = F.array(F.struct(F.array_join("masked_utt", "\n").alias("intent"), *[F.lit("").alias(n) for n in ("domain", "slot", "value")]))
    return dialogues.withColumn("input_sequence", _combined(marked, F.col("masked_utt"), use_da, use_utt)).withColumn("sample", F.concat("masked_da", F.array(text)))


def multimodal_sequence(lines: Column, use_value: bool = False) -> tuple[Column, Column]:
    """The two inputs of a late-fusion model: acts with empty parts kept, and utterances."""
    acts = F.array_join(F.transform(lines, lambda x: serial_acts(acts_or_none(x["acts"]), use_value)), f" {DA_SEP} ")
    said = F.array_join(F.transform(F.filter(lines, lambda x: x["role"] == "user"), lambda x: x["text"]), f" {USER_MARK} ")
    return F.concat(F.lit(f"{CLS} "), acts, F.lit(f" {SEP}")), F.concat(F.lit(f"{CLS} "), said, F.lit(f" {SEP}"))


def hashed_ids(text: Column, max_len: int, buckets: int = 50_000) -> Column:
    """Ids from 1 of a text's words by their hash, cut at ``max_len``. JVM-side stand-in for a tokenizer."""
    number = lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long")
    return F.slice(F.transform(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != ""), lambda t: (number(t) % (buckets - 1) + 1).cast("int")), 1, max_len)


def encode(text: Column, max_len: int, buckets: int = 50_000) -> tuple[Column, Column]:
    """input_ids and attention_mask of fixed length, padded with 0."""
    ids = hashed_ids(text, max_len, buckets)
    pad = lambda xs: F.concat(xs, F.array_repeat(F.lit(0), F.lit(max_len) - F.size(xs)))
    return pad(ids), pad(F.transform(ids, lambda _: F.lit(1)))


def agg_dialogue(rows: DataFrame, turn_mode: bool = True) -> DataFrame:
    """Turn rows (prev_acts, acts, text) back to dialogues. In turn mode each turn brings the acts before it, and the very
    first of those is no part of the dialogue."""
    ordered = F.array_sort(F.collect_list(F.struct("turn_no", "prev_acts", "acts", "text")))
    out = rows.groupBy("dia_no", "label").agg(ordered.alias("r"))
    pairs = F.flatten(F.transform("r", lambda x: F.array(x["prev_acts"], x["acts"])))
    acts = F.slice(pairs, F.lit(2), F.greatest(F.size(pairs) - 1, F.lit(1))) if turn_mode else F.transform("r", lambda x: x["acts"])
    return out.select("dia_no", "label", acts.alias("masked_da"), F.transform("r", lambda x: x["text"]).alias("masked_utt"))


def prefix_expand(dialogues: DataFrame, turn_mode: bool = True) -> DataFrame:
    """Every prefix of n user turns: acts 2i - 1 (or i), utterances i, turn_no i - 1, is_complete at i = n.

    Dialogues whose acts do not fit their turns raise an error."""
    n = F.size("masked_utt")
    want = 2 * n - 1 if turn_mode else n
    checked = dialogues.withColumn("n", F.when(F.size("masked_da") == want, n).otherwise(F.raise_error(F.concat(F.lit("acts do not fit turns in dialogue "), F.col("dia_no").cast("string"))).cast("int")))
    rows = checked.where("n > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    length = 2 * F.col("i") - 1 if turn_mode else F.col("i")
    return rows.select("dia_no", "label", F.slice("masked_da", F.lit(1), length).alias("masked_da"), F.slice("masked_utt", F.lit(1), F.col("i")).alias("masked_utt"), (F.col("i") - 1).alias("turn_no"), (F.col("i") == F.col("n")).alias("is_complete"))


def context_window(turns: DataFrame, size: int = 3) -> DataFrame:
    """The last lines before each line, oldest first."""
    w = W.partitionBy("dia_no", "label").orderBy("pos").rowsBetween(-size, -1)
    return turns.withColumn("context", F.collect_list(F.concat(F.col("role"), F.lit(": "), F.col("text"))).over(w))


def load_dataset(human: DataFrame, machine: DataFrame, splits: DataFrame, name: str, seed: int = 2025) -> DataFrame:
    """Human rows (label 0) and one machine variant of each dialogue (label 1), with data set and split."""
    one = sample_one_per_key(machine, "dia_no", "variant", seed).drop("variant")
    both = human.withColumn("label", F.lit(0)).unionByName(one.withColumn("label", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("dataset", F.lit(name)).join(splits, "dia_no")


def semi_split(df: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    return df.join(splits.where(F.col("split") == split).select("dia_no"), "dia_no", "left_semi")


def anti_resume(df: DataFrame, done: DataFrame) -> DataFrame:
    """What is not complete yet."""
    return df.join(done.where("is_complete").select("dia_no"), "dia_no", "left_anti")


def limit_generate(df: DataFrame, requested: int, done: DataFrame) -> DataFrame:
    """The next rows by dia_no, up to what was requested."""
    return anti_resume(df, done).orderBy("dia_no").limit(requested)


def sample_one_per_key(df: DataFrame, key: str, variant: str, seed: int = 2025) -> DataFrame:
    """One row of each key, chosen by a hash of seed, key and variant; the variant itself breaks ties."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col(variant).cast("string")))
    order = W.partitionBy(key).orderBy(draw, variant)
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def sample_n_rows(df: DataFrame, keys: list[str], n: int, seed: int = 2025) -> DataFrame:
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return df.orderBy(draw, *keys).limit(n)


def union_datasets_offset(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both sets with distinct ids: the second's follow the first's largest."""
    shift = first.agg((F.coalesce(F.max("dia_no"), F.lit(-1)) + 1).alias("_shift"))
    moved = second.join(F.broadcast(shift)).withColumn("dia_no", F.col("dia_no") + F.col("_shift")).drop("_shift")
    return first.unionByName(moved)


def batches(df: DataFrame, keys: list[str], size: int, seed: int | None = 2025, parts: int | None = None) -> DataFrame:
    """Adds part and batch: rows of a part in batches of ``size``, in the order of a digest, or by keys without a seed. Without
    ``parts`` there are as many as leave a part ``PART_BATCHES`` batches. ``collate`` pads, and needs no parts."""
    parts = parts or max(1, -(-df.count() // (size * PART_BATCHES)))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed or 0)), *[F.col(k).cast("string") for k in keys]))
    part = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % parts).cast("int")
    rows = df.withColumn("part", part).withColumn("_h", F.lit("") if seed is None else digest)
    place = F.row_number().over(W.partitionBy("part").orderBy("_h", *keys)) - 1
    return rows.withColumn("batch", F.floor(place / size).cast("int")).drop("_h")


def negatives_random_pair(df: DataFrame, keys: list[str], taken: str, seed: int = 2025) -> DataFrame:
    """Pairs each row with another row's ``taken``: rows stand in rings of about ``RING`` rows by a digest of their keys, and
    each takes its successor's. A row that is alone in its ring has no pair."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    place = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")
    bucket = df.withColumn("_h", draw).withColumn("_b", F.pmod(place, F.lit(max(1, df.count() // RING))))
    order = W.partitionBy("_b").orderBy("_h", *keys)
    ahead = F.coalesce(F.lead(taken).over(order), F.first(taken).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    alone = F.count("*").over(W.partitionBy("_b")) > 1
    return bucket.withColumn("negative", ahead).withColumn("_ok", alone).where("_ok").drop("_h", "_b", "_ok")
