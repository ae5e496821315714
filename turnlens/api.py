"""The engine's front: detect, explain, profile, aopc and session over tables, under one immutable configuration.

Turn tables have dia_no, label, turn_no, text and tok (an array of tokens); acts where a function names them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import attribution, dialogue, evaluate, fusion, joins, profile as profiles, scoring, selection
from .operators import features
from .sources.manifest import Manifest
from .streaming import session as sessions

KEY = ["dia_no", "label", "turn_no"]
#: Mask methods of the explanation names.
METHODS = {"fs": "faith_shap", "stii": "shapley_taylor"}


def attributions(turns: DataFrame, cfg: Config, scorer: scoring.Scorer) -> DataFrame:
    """key, n_features, explanation (single features as idx, text, score), bias, infidelity and r2 of each turn, before anything is
    selected. Scores are rounded to nine decimals, as solvers leave noise that would decide ties."""
    if cfg.utt_explanation not in METHODS:
        raise ValueError("gradients need a differentiable scorer: call operators.attribution.integrated_gradients")
    found = attribution.attribute(turns, scorer.predict, METHODS[cfg.utt_explanation], cfg.perturbations, cfg.interaction_order, cfg.lasso_alpha, cfg.seed)
    flat = F.flatten(F.transform("explanation", lambda e: F.transform(e["features"], lambda f: F.struct(f["idx"].alias("idx"), f["text"].alias("text"), F.round(e["score"], 9).alias("score")))))
    return found.select(*KEY, "n_features", flat.alias("explanation"), "bias", "infidelity", "r2")


def select(found: DataFrame, turns: DataFrame, cfg: Config, scorer: scoring.Scorer) -> DataFrame:
    """Attributions with top_explanation, important_features, importance_masks and the masked text of each turn."""
    rows = found.join(turns.select(*KEY, "tok"), KEY)
    k = cfg.utt_k or 1_000_000
    if cfg.random_explanation:
        top = selection.sample_k_features(F.col("explanation"), k, [F.col(c) for c in KEY], cfg.seed)
    elif cfg.ordering == "prediction":
        rows = scoring.score_prob(rows.withColumn("text", F.array_join("tok", " ")), scorer).withColumn("pred", (F.col("prob") >= 0.5).cast("int"))
        top = selection.topk_prediction(F.col("explanation"), F.col("pred"), k)
    else:
        top = selection.topk_absolute(F.col("explanation"), k)
    rows = rows.withColumn("top_explanation", top).withColumn("important_features", selection.important_ids(F.col("top_explanation")))
    rows = rows.withColumn("importance_masks", selection.importance_mask(F.col("important_features"), F.col("n_features")))
    return rows.withColumn("masked_sample", features.mask_apply_utt(F.col("tok"), F.col("importance_masks"))).drop("tok", "text", "prob")


def explain(turns: DataFrame, cfg: Config, scorer: scoring.Scorer) -> DataFrame:
    """n_features, explanation (single features as idx, text, score), top, important_features, importance_masks and the
    masked text of each turn. With ``none`` everything is important and the text stays."""
    if cfg.utt_explanation == "none":
        every = F.transform("tok", lambda t, i: i)
        return turns.select(*KEY, F.size("tok").alias("n_features"), every.alias("important_features"), F.transform("tok", lambda _: F.lit(1)).alias("importance_masks"), F.array_join("tok", " ").alias("masked_sample"))
    return select(attributions(turns, cfg, scorer), turns, cfg, scorer)


#: Turns whose attributions are made and committed together, and what of a configuration they depend on.
PART_TURNS = 1 << 16
ATTRIBUTED = "dia_no long, label int, turn_no int, n_features int, explanation array<struct<idx:int,text:string,score:double>>, bias double, infidelity double, r2 double, split string"
DEPENDS = ("utt_explanation", "interaction_order", "perturbations", "lasso_alpha", "seed")


def explain_splits(turns: DataFrame, splits: DataFrame, cfg: Config, scorer: scoring.Scorer, where: str, part_turns: int = PART_TURNS) -> DataFrame:
    """``explain`` for every split, as a job that can be stopped: attributions are stored below ``where`` in parts of about
    ``part_turns`` turns, named by split and part in a folder of the settings that they depend on. Parts that are there are not made
    again; what is selected from them is, so other choices of ``utt_k`` or ``ordering`` need no new attributions. The parts
    follow from the number of turns: another table needs another folder."""
    spark, rows = turns.sparkSession, turns.join(splits.select("dia_no", "split"), "dia_no")
    if cfg.utt_explanation == "none":
        return explain(turns, cfg, scorer).join(splits.select("dia_no", "split"), "dia_no")
    store = Manifest(spark, f"{where}/attributions-{cfg.key(DEPENDS)}", ATTRIBUTED)
    parts = {}
    for split, n in sorted(map(tuple, rows.groupBy("split").count().collect())):
        many = max(1, -(-n // part_turns))
        parts |= {f"{split}-{many}-{i}": (split, many, i) for i in range(many)}

    def make(name: str) -> DataFrame:
        split, many, i = parts[name]
        own = rows.where((F.col("split") == split) & (F.pmod(F.xxhash64("dia_no", "label", "turn_no"), F.lit(many)) == i))
        return attributions(own, cfg, scorer).withColumn("split", F.lit(split)).select(*[c.split()[0] for c in ATTRIBUTED.split(", ")])

    store.run(parts, make)
    return select(store.read(lambda name: name in parts), turns, cfg, scorer)


def detect(turns: DataFrame, cfg: Config, scorer: scoring.Scorer) -> DataFrame:
    """Select, then predict: masked turns become growing dialogues, and every prefix gets its probability."""
    masked = explain(turns, cfg, scorer).select(*KEY, "masked_sample")
    rows = turns.select(*KEY, "prev_acts", "acts").join(masked, KEY).withColumnRenamed("masked_sample", "text")
    prefixes = dialogue.prefix_expand(dialogue.agg_dialogue(rows, cfg.use_da_turn), cfg.use_da_turn)
    scored = scoring.score_prob(prefixes.withColumn("text", F.array_join("masked_utt", " ")), scorer)
    return scored.withColumn("pred", (F.col("prob") >= 0.5).cast("int")).drop("text")


def metrics(detected: DataFrame) -> DataFrame:
    """Per prefix length and of complete dialogues (turn_no -1)."""
    return evaluate.metrics_online(detected)


def profile(turns: DataFrame, cfg: Config) -> DataFrame:
    """Turns with tok, score arrays and acts to n-gram profiles of every act and of all."""
    grams = F.explode(profiles.ngrams(F.transform("tok", lambda t: F.lower(t)), F.col("scores"), cfg.max_ngram)).alias("g")
    acts = turns.select(*KEY, F.explode(F.array_distinct(F.transform("acts", lambda a: F.struct(a["intent"].alias("intent"), a["domain"].alias("domain"), a["slot"].alias("slot"))))).alias("a")).select(*KEY, "a.*")
    rows = turns.select(*KEY, grams).select(*KEY, "g.*").join(acts, KEY)
    return profiles.profile_build(rows, cfg.metric, cfg.alpha)


def aopc(turns: DataFrame, orders: DataFrame, cfg: Config, scorer: scoring.Scorer) -> DataFrame:
    """Perturbation curves of removal orders (key, method, order): key, method, step, aopc. Every method keeps its own."""
    states = evaluate.remove_iterative(turns.select(*KEY, "tok").join(orders, KEY), cfg.aopc_depth)
    scored = scoring.score_prob(states.withColumn("text", F.array_join("state", " ")), scorer)
    return evaluate.aopc(scored, [*KEY, "method"]).select(*KEY, "method", "step", "aopc")


def prepare(turns: DataFrame, splits: DataFrame, level: str, max_len: int = 128) -> DataFrame:
    """Encoded inputs of one level with their split. ``utt`` and ``da`` take turns (text; prev_acts and acts), ``dia`` dialogues
    with lines. input_sequence, input_ids and attention_mask; ``dia`` has them for both modalities."""
    rows = turns.join(splits.select("dia_no", "split"), "dia_no")
    if level == "dia":
        da, utt = dialogue.multimodal_sequence(F.col("lines"))
        (a, am), (u, um) = dialogue.encode(F.col("da_sequence"), max_len), dialogue.encode(F.col("utt_sequence"), max_len)
        rows = rows.withColumn("da_sequence", F.coalesce(da, F.lit(""))).withColumn("utt_sequence", F.coalesce(utt, F.lit("")))
        return rows.select("dia_no", "label", "split", "da_sequence", "utt_sequence", a.alias("da_input_ids"), am.alias("da_attention_mask"), u.alias("utt_input_ids"), um.alias("utt_attention_mask"))
    text = dialogue.utt_sequence(F.col("text")) if level == "utt" else dialogue.da_sequence(F.col("prev_acts"), F.col("acts"))
    ids, mask = dialogue.encode(F.col("input_sequence"), max_len)
    return rows.withColumn("input_sequence", text).select(*KEY, "split", "input_sequence", ids.alias("input_ids"), mask.alias("attention_mask"))


def refresh_train(rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """The rows with their training split replaced."""
    return rows.where("split <> 'train'").unionByName(fresh.withColumn("split", F.lit("train")))


def train_all(turns: DataFrame, dialogues: DataFrame, splits: DataFrame, cfg: Config, where: str) -> DataFrame:
    """Fits the detectors of acts, utterances and dialogues on the training split, in this order, saves them below ``where``
    under the configuration's key, and returns their metrics on every split. That of dialogues has two towers, fused as the
    configuration says, and stops by the validation split if there is one."""
    out = None
    for level in ("da", "utt", "dia"):
        rows = prepare(dialogues if level == "dia" else turns, splits, level)
        if level == "dia":
            model = fusion.train(rows, {level: fusion.Settings(cfg.fusion, seed=cfg.seed)}, "da_sequence", "utt_sequence")[level]
            fusion.save(rows.sparkSession, model, f"{where}/{cfg.key()}/{level}")
            scored = fusion.predict(rows, model, "da_sequence", "utt_sequence")
        else:
            model = scoring.turn_pipeline("input_sequence").fit(rows.where("split = 'train'"))
            model.write().overwrite().save(f"{where}/{cfg.key()}/{level}")
            scored = model.transform(rows)
        scored = scored.select("split", "label", F.col("prediction").cast("int").alias("pred"))
        own = evaluate.metrics_cls(scored, ["split"]).withColumn("level", F.lit(level))
        out = own if out is None else out.unionByName(own)
    return out


def load_models(spark: SparkSession, where: str, cfg: Config) -> dict:
    """The saved detectors of a configuration, by level."""
    return {level: scoring.PipelineModel.load(f"{where}/{cfg.key()}/{level}") for level in ("da", "utt")} | {"dia": fusion.load(spark, f"{where}/{cfg.key()}/dia")}


def session(stream: DataFrame, cfg: Config, scorer, idle_ms: int | None = sessions.IDLE_MS) -> DataFrame:
    """A stream of (session_id, seq, text, reset) to one row per turn."""
    return sessions.detect_stream(stream, scorer, cfg.utt_k or 0, idle_ms)


__all__ = ["Config", "aopc", "attributions", "detect", "explain", "explain_splits", "joins", "load_models", "metrics", "prepare", "profile", "refresh_train", "select", "session", "train_all"]
