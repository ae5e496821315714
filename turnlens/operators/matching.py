"""Matching tokens with acts by similarity of their vectors, within each turn."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Vectors of a block; two blocks meet in one task.
BLOCK = 1024


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def hashed_embedding(text: Column, dims: int = 16) -> Column:
    """A deterministic stand-in for an embedding model: values in [-1, 1) from a digest of the text and the place."""
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", text, i.cast("string"))), 1, 6), 16, 10).cast("double") / F.lit(float(1 << 23)) - 1)


def da_to_text(intent: Column, slot_text: Column, value: Column) -> Column:
    """An act in words: intent (with plain words for the two that have none), slot and value; the domain is left out."""
    plain = F.when(intent == "nobook", "no book").when(intent == "reqmore", "request more").otherwise(intent)
    return F.trim(F.regexp_replace(F.concat_ws(" ", plain, slot_text, value), " +", " "))


def pairwise_sim(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, i, vec) and (keys, j, vec): cosine of each pair within a key, the highest over an item's vectors."""
    a = left.select(*keys, "i", unit(F.col("vec")).alias("va"))
    b = right.select(*keys, "j", unit(F.col("vec")).alias("vb"))
    return a.join(b, keys).withColumn("s", dot(F.col("va"), F.col("vb"))).groupBy(*keys, "i", "j").agg(F.max("s").alias("sim"))


def csls(sim: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """Twice the similarity less the means of the k nearest of its row and of its column."""
    row, col = W.partitionBy(*keys, "i"), W.partitionBy(*keys, "j")
    ranked = sim.withColumn("ri", F.row_number().over(row.orderBy(F.desc("sim"), "j"))).withColumn("rj", F.row_number().over(col.orderBy(F.desc("sim"), "i")))
    near = lambda rank, w: F.avg(F.when(F.col(rank) <= k, F.col("sim"))).over(w)
    return ranked.withColumn("csls", 2 * F.col("sim") - near("ri", row) - near("rj", col)).drop("ri", "rj")


def sim_to_table(sim: DataFrame, column: str = "csls") -> DataFrame:
    """Four decimals, half to even, before any threshold looks at them."""
    return sim.withColumn(column, F.bround(column, 4))


def rel_threshold(sim: DataFrame, keys: list[str], axis: str = "i", share: float = 0.9, column: str = "csls") -> DataFrame:
    """Per row (axis i) or column (axis j) what reaches the least value plus ``share`` of the range."""
    w = W.partitionBy(*keys, axis)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return sim.withColumn("_t", low + share * (high - low)).where(F.col(column) >= F.col("_t")).drop("_t")


def match_flip(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Token -> acts regrouped as act -> tokens, strongest first."""
    return matches.groupBy(*keys, "j").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("csls")).alias("r"), "i"))), lambda x: x["i"]).alias("tokens"))


def match_assemble(matches: DataFrame, token_scores: DataFrame, act_scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per act its score, its tokens with theirs, and the tokens' mean."""
    rows = matches.join(token_scores, [*keys, "i"]).join(act_scores, [*keys, "j"])
    items = F.array_sort(F.collect_list(F.struct("i", "token", "score")))
    return rows.groupBy(*keys, "j", "da_expl").agg(items.alias("utt"), F.avg("score").alias("utt_expl"))


def match_corpus(tokens: DataFrame, acts: DataFrame, keys: list[str], threshold: float = 0.9, axis: str = "i") -> DataFrame:
    """Rows (keys, i, vec) against (keys, j, vec): CSLS, rounded, and per token what is within the threshold."""
    return rel_threshold(sim_to_table(csls(pairwise_sim(tokens, acts, keys), keys)), keys, axis, threshold)


def train_pairs(rows: DataFrame, negatives: DataFrame) -> DataFrame:
    """Texts (utt) with descriptions of acts, with and without values, labelled 1 for own acts and 0 for others'."""
    both = lambda df, y: df.select("utt", F.col("with_value").alias("acts"), F.lit(y).alias("y")).unionByName(df.select("utt", F.col("without_value").alias("acts"), F.lit(y).alias("y")))
    return both(rows, 1).unionByName(both(negatives, 0))


class Blocks:
    """``match_corpus`` and its parts for keys that many vectors share: rows (keys, i, vec) against (keys, j, vec). Blocks of either
    side meet as products of matrices, once for each pass, and only what a pass is asked for leaves a task. An item's highest cosine
    over its vectors counts, so an item's vectors share a block. Null vectors have null cosines."""

    def __init__(self, left: DataFrame, right: DataFrame, keys: list[str]):
        self.keys, self.sides = keys, []
        for side, name in ((left, "i"), (right, "j")):
            blocks = side.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n"))
            self.sides.append((side.select(*keys, F.col(name).alias("_id"), unit(F.col("vec")).alias("_v")), blocks))
        self.kinds = dict(left.dtypes) | {"j": dict(right.dtypes)["j"]}

    def _pass(self, f: Callable, schema: str, more: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """What ``f`` makes of each pair of blocks: of rows' and columns' items, their cosines, and the numbers of each row and
        each column ([item][number]) that ``more`` gives (keys, _id, _x)."""
        parts, keys = [], self.keys
        for at, ((rows, own), (_, other)) in enumerate(zip(self.sides, self.sides[::-1])):
            rows = rows.withColumn("_x", F.array().cast("array<double>")) if more is None else rows.join(more[at], [*keys, "_id"])
            placed = rows.join(own, keys).withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int")).drop("_n").join(other, keys)
            placed = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
            p, q = ("_b", "_o") if at == 0 else ("_o", "_b")
            parts.append(placed.select(*keys, F.col(p).alias("_p"), F.col(q).alias("_q"), F.lit(at).alias("_side"), "_id", "_v", "_x"))
        names = [*keys, *(x.split()[0] for x in schema.split(", "))]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            one, two = (pdf[pdf["_side"] == at].sort_values("_id", kind="stable") for at in (0, 1))
            if not len(one) or not len(two):
                return pd.DataFrame(columns=names)
            dims = next((len(v) for v in pdf["_v"] if v is not None), 1)
            a, b = (np.stack([np.full(dims, np.nan) if v is None else np.asarray(v, float) for v in side["_v"]]) for side in (one, two))
            (i, first_i), (j, first_j) = (np.unique(side["_id"].to_numpy(), return_index=True) for side in (one, two))
            s = np.fmax.reduceat(np.fmax.reduceat(a @ b.T, first_i, axis=0), first_j, axis=1)
            x, y = (np.array([[np.nan if z is None else z for z in v] for v in side["_x"].to_numpy()[first]], float) for side, first in ((one, first_i), (two, first_j)))
            return f(i, j, s, x, y).assign(**{k: pdf[k].iloc[0] for k in keys})[names]

        schema = ", ".join([*(f"{k} {self.kinds[k]}" for k in keys), schema])
        return parts[0].unionByName(parts[1]).groupBy(*keys, "_p", "_q").applyInPandas(run, schema)

    def _pairs(self, f: Callable, name: str, more: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        def run(i, j, s, x, y):
            return pd.DataFrame({"i": i.repeat(len(j)), "j": np.tile(j, len(i)), name: f(s, x, y).reshape(-1)})

        return self._pass(run, f"i {self.kinds['i']}, j {self.kinds['j']}, {name} double", more)

    def pairwise_sim(self) -> DataFrame:
        return self._pairs(lambda s, x, y: s, "sim")

    def _near(self, k: int) -> tuple[DataFrame, DataFrame]:
        """The mean of each item's k highest cosines."""

        def best(i, j, s, x, y):
            out = []
            for at, (items, m) in enumerate(((i, s), (j, s.T))):
                top = -np.partition(np.where(np.isnan(m), np.inf, -m), min(k, m.shape[1]) - 1, axis=1)[:, :k]
                out.append(pd.DataFrame({"side": at, "item": [str(z) for z in items], "top": [t[np.isfinite(t)] for t in top]}))
            return pd.concat(out)

        each = self._pass(best, "side int, item string, top array<double>")
        found = []
        for at, name in enumerate("ij"):
            top = F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, k)
            own = each.where(F.col("side") == at).groupBy(*self.keys, F.col("item").cast(self.kinds[name]).alias("_id")).agg(top.alias("_t"))
            mean = F.when(F.size("_t") > 0, F.aggregate("_t", F.lit(0.0), lambda a, x: a + x) / F.size("_t"))
            found.append(own.select(*self.keys, "_id", F.array(mean).alias("_x")))
        return found[0], found[1]

    def csls(self, k: int = 5) -> DataFrame:
        return self._pairs(_csls_of, "csls", self._near(k))

    def match_corpus(self, threshold: float = 0.9, k: int = 5) -> DataFrame:
        """CSLS, rounded, and per row what is within the threshold: one pass for the means, one for the range of each row's rounded
        values, one for those that reach its bound."""
        near = self._near(k)
        rounded = lambda s, x, y: np.round(_csls_of(s, x, y), 4) + 0.0

        def ends(i, j, s, x, y):
            v = rounded(s, x, y)
            return pd.DataFrame({"i": i, "low": np.fmin.reduce(v, axis=1), "high": np.fmax.reduce(v, axis=1)})

        def hits(i, j, s, x, y):
            v = rounded(s, x, y)
            at, to = np.nonzero(v >= x[:, 1:2])
            return pd.DataFrame({"i": i[at], "j": j[to], "csls": v[at, to]})

        bound = self._pass(ends, f"i {self.kinds['i']}, low double, high double", near).groupBy(*self.keys, F.col("i").alias("_id")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
        rows = near[0].join(bound, [*self.keys, "_id"]).select(*self.keys, "_id", F.concat("_x", F.array(F.col("low") + threshold * (F.col("high") - F.col("low")))).alias("_x"))
        return self._pass(hits, f"i {self.kinds['i']}, j {self.kinds['j']}, csls double", (rows, near[1]))


def _csls_of(s: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 2 * s - x[:, :1] - y[:, 0][None, :]
