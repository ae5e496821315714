"""Local explanations as plans: masks per instance, scores of masked inputs, a solver per instance.

An instance's masks depend on the seed and its key only. One pass makes masks and masked texts, scores them in batches
and solves, so the hundreds of perturbations of a turn never become rows of a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DA_SEP, MASK, SEED, SLOT_SEP
from ..functions import attribution as A
from ..sources.conversations import tokens

KEY = ["dia_no", "turn_no", "label"]
EXPLANATION = "array<struct<features:array<struct<text:string,idx:int>>,score:double>>"
SCHEMA = f"dia_no long, turn_no int, label int, n_features int, explanation {EXPLANATION}, bias double, infidelity double, r2 double"
#: Masked inputs that are scored at once, and instances whose masks are held together.
AT_ONCE, TOGETHER = 4096, 256


def mask_words(words: list[str], mask: np.ndarray) -> str:
    return " ".join(w if m else MASK for w, m in zip(words, mask))


def drop_words(words: list[str], mask: np.ndarray) -> str:
    return " ".join(w for w, m in zip(words, mask) if m)


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as a shuffle has. A row costs milliseconds of Python here, and by its bytes alone Spark would
    join all of them into a task or two."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY)


def perturb(df: DataFrame, method: str, n: int = 200, order: int = 1, seed: int = SEED, apply: Callable = mask_words, features: str = "tok") -> DataFrame:
    """Rows (key, mask_id, mask, masked), for scorers that live outside; instances without features have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, words in zip(pdf[KEY].itertuples(index=False), pdf[features]):
                if words is None or not len(words):
                    continue
                for i, m in enumerate(A.masks(method, len(words), n, order, A.instance_rng(seed, *key))):
                    rows.append((*key, i, m.astype(int).tolist(), apply(list(words), m)))
            yield pd.DataFrame(rows, columns=[*KEY, "mask_id", "mask", "masked"])

    return spread(df.select(*KEY, features)).mapInPandas(run, "dia_no long, turn_no int, label int, mask_id int, mask array<int>, masked string")


def act_tokens(acts: Column) -> Column:
    """The tokens of serialised acts with the place of the act that each belongs to. Separators between an act's parts
    belong to it, those between acts to none (-1); empty parts have no tokens."""
    part = lambda a, i: lambda p: F.transform(tokens(p), lambda t: F.struct(t.alias("token"), i.alias("act_i")))
    mark = lambda text, i: F.array(F.struct(F.lit(text).alias("token"), i.alias("act_i")))

    def of(a: Column, i: Column) -> Column:
        names = [part(a, i)(a[n]) for n in ("intent", "domain", "slot", "value")]
        joined = [names[0], *[x for n in names[1:] for x in (mark(SLOT_SEP, i), n)]]
        return F.concat(F.when(i > 0, mark(DA_SEP, F.lit(-1))).otherwise(F.array().cast("array<struct<token:string,act_i:int>>")), *joined)

    return F.flatten(F.transform(acts, of))


def sampled(df: DataFrame, score: Callable[[DataFrame], DataFrame], method: str, n: int = 200, order: int = 1, times: int = 5, seed: int = SEED) -> DataFrame:
    """Masks of each instance, each scored ``times`` times and averaged, for scorers that answer at random. ``score`` adds y
    to rows (key, mask_id, mask, masked, try)."""
    rows = perturb(df, method, n, order, seed).withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(times))))
    return averaged(score(rows))


def chosen(df: DataFrame, n: int, least: int = 0, most: int = 130, seed: int = SEED, features: str = "tok") -> DataFrame:
    """``n`` instances in the order of a digest, among those with ``least`` to ``most`` features."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in KEY]))
    return df.where(F.size(features).between(least, most)).orderBy(draw, *KEY).limit(n)


def solved(scored: DataFrame, instances: DataFrame, method: str, order: int = 1, alpha: float = 0.001, features: str = "tok") -> DataFrame:
    """Explanations from stored perturbations: rows (key, mask_id, mask, y) of ``scored``, each instance's in one task, as their
    number is that of a setting. The same columns as ``attribute``; instances without masks have none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("mask_id")
        words = list(pdf["_words"].iloc[0])
        x, y = np.stack(pdf["mask"].to_numpy()).astype(np.int8), pdf["y"].to_numpy(float)
        found = A.explain(method, x, y, order, alpha)
        return pd.DataFrame([(*pdf[KEY].iloc[0], len(words), _formatted(found, words), found.get((), 0.0), *A.infidelity_r2(x, y, found))], columns=[*KEY, "n_features", "explanation", "bias", "infidelity", "r2"])

    rows = scored.select(*KEY, "mask_id", "mask", "y").join(instances.select(*KEY, F.col(features).alias("_words")), KEY)
    return rows.groupBy(*KEY).applyInPandas(run, SCHEMA)


def display(explained: DataFrame, most: int = 10) -> DataFrame:
    """key, rank, features (text and index) and score of the strongest terms, as a table to show."""
    rows = explained.select(*KEY, F.posexplode(F.slice("explanation", 1, most)).alias("rank", "e"))
    return rows.select(*KEY, (F.col("rank") + 1).alias("rank"), F.array_join(F.transform("e.features", lambda f: F.concat_ws(" ", f["text"], f["idx"].cast("string"))), " + ").alias("features"), F.round("e.score", 6).alias("score"))


def averaged(scored: DataFrame, y: str = "y") -> DataFrame:
    """Repeated scores of one mask become their mean."""
    return scored.groupBy(*KEY, "mask_id").agg(F.first("mask").alias("mask"), F.avg(y).alias(y))


def _formatted(found: dict, words: list[str]) -> list[dict]:
    ranked = sorted(((t, v) for t, v in found.items() if t), key=lambda x: (-abs(x[1]), x[0]))
    return [{"features": [{"text": words[i], "idx": int(i)} for i in t], "score": float(v)} for t, v in ranked]


def _scores(todo: list[tuple[list[str], np.ndarray]], score: Callable, apply: Callable, on_masks: Callable | None) -> list[np.ndarray]:
    """Scores of the masked inputs of many instances (features, masks): ``AT_ONCE`` texts of whatever instances at a time."""
    if on_masks is not None:
        return [np.asarray(on_masks(words, x), float) for words, x in todo]
    found, texts = [], []
    for words, x in todo:
        for m in x:
            texts.append(apply(words, m))
            if len(texts) == AT_ONCE:
                found.append(score(texts))
                texts = []
    flat = np.concatenate([*found, score(texts)] if texts else found or [np.zeros(0)])
    return np.split(flat, np.cumsum([len(x) for _, x in todo])[:-1]) if todo else []


def explained(instances: Iterable[tuple[tuple, list[str]]], score: Callable[[list[str]], np.ndarray], method: str = "faith_shap", n: int = 200, order: int = 1, alpha: float = 0.001, seed: int = SEED, apply: Callable = mask_words, valid: int = 0, on_masks: Callable | None = None) -> Iterator[tuple[dict, float | None, float | None]]:
    """The explanation of each instance (key, features), with infidelity and r2: masks of ``TOGETHER`` instances at a time are
    scored together. ``on_masks`` scores (features, masks) without texts, for scorers that can."""
    instances = iter(instances)
    while some := list(islice(instances, TOGETHER)):
        make = lambda count, s: [(words, A.masks(method, len(words), count, order, A.instance_rng(s, *key)) if words else np.zeros((0, 0))) for key, words in some]
        todo = make(n, seed)
        ys = _scores(todo, score, apply, on_masks)
        found = [A.explain(method, x, y, order, alpha) for (_, x), y in zip(todo, ys)]
        if valid:
            todo = make(valid, seed + 1)
            ys = _scores(todo, score, apply, on_masks)
        for (_, x), y, f in zip(todo, ys, found):
            yield (f, *(A.infidelity_r2(x, y, f) if len(x) else (None, None)))


def attribute(df: DataFrame, score: Callable[[list[str]], np.ndarray], method: str = "faith_shap", n: int = 200, order: int = 1, alpha: float = 0.001, seed: int = SEED, apply: Callable = mask_words, features: str = "tok", valid: int = 0, on_masks: Callable | None = None) -> DataFrame:
    """key, n_features, explanation (all terms, strongest first), bias, infidelity and r2 on the masks themselves, or on
    about ``valid`` further masks of their own. A turn without features has an empty explanation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, words = list(pdf[KEY].itertuples(index=False)), [[] if w is None else list(w) for w in pdf[features]]
            every = explained(zip(keys, words), score, method, n, order, alpha, seed, apply, valid, on_masks)
            out = [(*key, len(ws), _formatted(found, ws), found.get((), 0.0), loss, r2) for key, ws, (found, loss, r2) in zip(keys, words, every)]
            yield pd.DataFrame(out, columns=[*KEY, "n_features", "explanation", "bias", "infidelity", "r2"])

    return spread(df.select(*KEY, features)).mapInPandas(run, SCHEMA)


def integrated_gradients(df: DataFrame, embed: Callable, gradient: Callable, baseline: np.ndarray, steps: int = 100, features: str = "tok") -> DataFrame:
    """Gradient attributions by token; ``baseline`` stands for every token, blank tokens are no features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, words in zip(pdf[KEY].itertuples(index=False), pdf[features]):
                words = [w for w in (words if words is not None else []) if w.strip()]
                value = embed(words) if words else np.zeros((0, len(baseline)))
                scores = A.integrated_gradients(value, np.tile(baseline, (len(words), 1)), gradient, steps) if words else []
                out.append((*key, len(words), _formatted({(i,): s for i, s in enumerate(scores)}, words), 0.0, None, None))
            yield pd.DataFrame(out, columns=[*KEY, "n_features", "explanation", "bias", "infidelity", "r2"])

    return spread(df.select(*KEY, features)).mapInPandas(run, SCHEMA)


def keep_acts(acts: list[str], mask: np.ndarray) -> str:
    """Acts without a bit go; ``none`` stands for an utterance that loses all."""
    return ";".join(a for a, m in zip(acts, mask) if m) or "none"


#: Marks an act among the features of a dialogue; no token begins with it.
ACT_MARK = "\x01"


def mask_dialogue(features: list[str], mask: np.ndarray) -> str:
    """Tokens without a bit become the mask token, acts without a bit go."""
    words = [f if m else MASK for f, m in zip(features, mask) if not f.startswith(ACT_MARK)]
    return " ".join([*words, *(f[1:] for f, m in zip(features, mask) if m and f.startswith(ACT_MARK))])


def attribute_acts(df: DataFrame, score: Callable[[list[str]], np.ndarray], method: str = "faith_shap", n: int = 200, order: int = 1, alpha: float = 0.001, seed: int = SEED, acts: str = "acts") -> DataFrame:
    """``attribute`` over the acts of a turn: key, n_features and explanation with acts by name and place."""
    from .features import act_name

    rows = df.withColumn("_acts", F.transform(F.filter(F.coalesce(acts, F.array().cast(dict(df.dtypes)[acts])), lambda a: a["intent"] != "none"), act_name))
    return attribute(rows, score, method, n, order, alpha, seed, keep_acts, "_acts")


def attribute_dialogue(df: DataFrame, score: Callable[[list[str]], np.ndarray], method: str = "faith_shap", n: int = 200, order: int = 1, alpha: float = 0.001, seed: int = SEED, on_masks: Callable | None = None) -> DataFrame:
    """Attribution of whole dialogues from turns (key, tok, acts): the features are all tokens, turn by turn, then all acts.
    Each mask of a long dialogue is a text as long; ``on_masks`` spares scorers that can do without these texts.
    Rows (key of the last turn, kind token or act, turn_no, idx within the turn, text, score) of single features."""
    from .features import act_name

    empty = F.array().cast("array<struct<kind:string,turn_no:int,idx:int,text:string>>")
    place = lambda kind, text: lambda x, i: F.struct(F.lit(kind).alias("kind"), F.col("turn_no").cast("int").alias("turn_no"), i.alias("idx"), text(x).alias("text"))
    words = F.coalesce(F.transform("tok", place("token", lambda x: x)), empty)
    acts = F.coalesce(F.transform(F.filter("acts", lambda a: a["intent"] != "none"), place("act", act_name)), empty)
    turns = df.select("dia_no", "label", "turn_no", words.alias("w"), acts.alias("a"))
    whole = turns.groupBy("dia_no", "label").agg(F.array_sort(F.collect_list(F.struct("turn_no", "w", "a"))).alias("t"), F.max("turn_no").alias("turn_no"))
    whole = whole.withColumn("places", F.concat(F.flatten(F.transform("t", lambda x: x["w"])), F.flatten(F.transform("t", lambda x: x["a"])))).drop("t")
    whole = whole.withColumn("features", F.transform("places", lambda p: F.when(p["kind"] == "act", F.concat(F.lit(ACT_MARK), p["text"])).otherwise(p["text"])))
    found = attribute(whole, score, method, n, order, alpha, seed, mask_dialogue, "features", on_masks=on_masks).select(*KEY, F.explode("explanation").alias("e")).where(F.size("e.features") == 1)
    found = found.select(*KEY, F.get("e.features", F.lit(0))["idx"].alias("i"), F.col("e.score").alias("score"))
    rows = found.join(whole.select(*KEY, "places"), KEY).withColumn("p", F.get("places", F.col("i")))
    return rows.select("dia_no", "label", F.col("turn_no").alias("last_turn"), "p.kind", "p.turn_no", "p.idx", "p.text", "score")


def gradients_by_act(df: DataFrame, embed: Callable, gradient: Callable, baseline: np.ndarray, steps: int = 100, acts: str = "acts") -> DataFrame:
    """Integrated gradients of serialised acts, summed over the tokens of each act: rows (key, act_i, score)."""
    rows = df.withColumn("_t", act_tokens(F.col(acts))).withColumn("_tok", F.transform("_t", lambda t: t["token"]))
    found = integrated_gradients(rows, embed, gradient, baseline, steps, "_tok").select(*KEY, F.explode("explanation").alias("e"))
    owned = found.join(rows.select(*KEY, "_t"), KEY).select(*KEY, F.get("_t", F.get("e.features", F.lit(0))["idx"])["act_i"].alias("act_i"), "e.score")
    return grouped_by_act(owned.where("act_i >= 0"))


def grouped_by_act(explained: DataFrame, owner: str = "act_i") -> DataFrame:
    """Token attributions summed into the act that each token belongs to: rows (key, owner, score)."""
    return explained.groupBy(*KEY, owner).agg(F.sum("score").alias("score"))


def masks_banzhaf_all(df: DataFrame, n: str = "n_features", most: int = 20) -> DataFrame:
    """All masks of each instance as rows, JVM-side. More features than ``most`` raise an error: 2^n rows are no plan."""
    checked = F.when(F.col(n) <= most, F.col(n)).otherwise(F.raise_error(F.lit("too many features for all masks")).cast("int"))
    rows = df.withColumn("_n", checked).where("_n > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, _n) - 1"))).alias("mask_id"))
    bits = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.call_function("shiftright", F.col("mask_id"), F.col("_n") - 1 - i).bitwiseAND(F.lit(1).cast("long")).cast("int"))
    return rows.withColumn("mask", bits).drop("_n")
