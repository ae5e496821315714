"""The command line: ``python -m turnlens detect|profile|aopc|perturb|explain --data FOLDER --out FOLDER [settings]``.

Every setting of ``Config`` is a flag. ``--data`` holds the conversations, ``--out`` gets tables. ``--scorer package.module:Class``
names a scorer of one's own, which takes no arguments.
"""

from __future__ import annotations

import argparse
from dataclasses import fields
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .config import EXPLANATIONS, FUSIONS, METRICS, ORDERINGS, Config
from .operators import attribution as AT
from .operators import dialogue as D
from .operators import scoring as S
from .sources import conversations as C

CHOICES = {"da_explanation": EXPLANATIONS, "utt_explanation": EXPLANATIONS, "dia_explanation": EXPLANATIONS, "fusion": FUSIONS, "ordering": ORDERINGS, "metric": METRICS}
ORDERS = ("random", "local", "act", "global")
SOLVERS = ("faith_shap", "shapley_taylor", "shapley_interaction")
MASKS = (*SOLVERS, "banzhaf", "banzhaf_all")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="turnlens", description="Detects machine-written turns and explains why.")
    verbs = out.add_subparsers(dest="verb", required=True)
    for verb in ("detect", "profile", "aopc", "perturb", "explain"):
        own = verbs.add_parser(verb)
        own.add_argument("--data", required=True)
        own.add_argument("--out", required=True)
        own.add_argument("--scorer", default="turnlens.operators.scoring:LexiconScorer")
        for f in fields(Config):
            flag = "--" + f.name.replace("_", "-")
            if isinstance(f.default, bool):
                own.add_argument(flag, action=argparse.BooleanOptionalAction, default=f.default)
            else:
                own.add_argument(flag, type=type(f.default), default=f.default, choices=CHOICES.get(f.name))
        if verb == "aopc":
            own.add_argument("--methods", nargs="+", choices=ORDERS, default=ORDERS)
        if verb == "perturb":
            own.add_argument("--instances", type=int, default=50)
            own.add_argument("--valid", type=int, default=0)
            own.add_argument("--times", type=int, default=1)
            own.add_argument("--least", type=int, default=0)
            own.add_argument("--most", type=int, default=130)
        if verb == "perturb":
            own.add_argument("--method", choices=MASKS, default="faith_shap")
        if verb == "explain":
            own.add_argument("--method", choices=SOLVERS, default="faith_shap")
            own.add_argument("--perturbed", required=True, help="what perturb wrote")
    return out


def _scorer(name: str):
    module, _, kind = name.partition(":")
    return getattr(import_module(module), kind)()


def turns(spark: SparkSession, data: str) -> DataFrame:
    """User turns with tokens, acts and the acts before them."""
    return D.da_turn(C.turns(spark, data)).withColumn("tok", C.tokens(F.col("text")))


def detect(spark, args, cfg, scorer) -> None:
    found = api.detect(turns(spark, args.data), cfg, scorer)
    found.write.mode("overwrite").parquet(f"{args.out}/detected")
    kept = spark.read.parquet(f"{args.out}/detected")
    api.metrics(kept).write.mode("overwrite").json(f"{args.out}/metrics")


def profile(spark, args, cfg, scorer) -> None:
    """N-gram profiles of the turns' attributions, all of which count."""
    rows = turns(spark, args.data)
    found = api.attributions(rows, cfg, scorer).select(*api.KEY, F.transform(F.array_sort(F.filter("explanation", lambda e: e["text"].isNotNull())), lambda e: e["score"]).alias("scores"))
    api.profile(rows.join(found, api.KEY), cfg).write.mode("overwrite").parquet(f"{args.out}/profile")


def aopc(spark, args, cfg, scorer) -> None:
    from .plans import matched

    orders = matched.orders(spark, args.data).where(F.col("method").isin(list(args.methods)))
    orders = orders.groupBy(*api.KEY, "method").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "token"))), lambda x: x["token"]).alias("order"))
    curves = api.aopc(turns(spark, args.data), orders, cfg, scorer)
    curves.groupBy("method", "step").agg(F.avg("aopc").alias("aopc")).write.mode("overwrite").json(f"{args.out}/aopc")


def perturb(spark, args, cfg, scorer) -> None:
    """Instances, and their scored masks for fitting and for validation."""
    chosen = AT.chosen(turns(spark, args.data).where(F.size("tok") > 0), args.instances, args.least, args.most, cfg.seed)
    chosen.select(*AT.KEY, "tok").write.mode("overwrite").parquet(f"{args.out}/instances")
    rows = spark.read.parquet(f"{args.out}/instances")
    score = lambda df: S.score_prob(df, scorer, "masked", "y")
    for name, n, seed in (("train", cfg.perturbations, cfg.seed), ("valid", args.valid, cfg.seed + 1)):
        if n:
            AT.sampled(rows, score, args.method, n, cfg.interaction_order, args.times, seed).write.mode("overwrite").parquet(f"{args.out}/{name}")


def explain(spark, args, cfg, scorer) -> None:
    rows = spark.read.parquet(f"{args.perturbed}/instances")
    found = AT.solved(spark.read.parquet(f"{args.perturbed}/train"), rows, args.method, cfg.interaction_order, cfg.lasso_alpha)
    found.write.mode("overwrite").parquet(f"{args.out}/explained")
    AT.display(spark.read.parquet(f"{args.out}/explained")).orderBy(*AT.KEY, "rank").show(50, truncate=False)


VERBS = {f.__name__: f for f in (detect, profile, aopc, perturb, explain)}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    cfg = Config(**{f.name: getattr(args, f.name) for f in fields(Config)})
    VERBS[args.verb](spark or SparkSession.builder.appName("turnlens").getOrCreate(), args, cfg, _scorer(args.scorer))
