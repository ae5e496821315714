"""Near-duplicate vectors by dual traversal of one cover tree.

Cosine c of unit vectors is a distance: |x - y|^2 = 2 - 2c, so "cosine at least t" is "distance at most r". Nested nets
with halving radii (2, 1, 1/2, ...) cover the vectors. The upper tree spans the whole table and grows from the root in
distributed rounds: each round takes every node that holds more than ``Sizes.chunk`` vectors, draws a bounded sample inside the
node, takes the coarsest net of the sample that has several centres, and sends every vector of the node to its nearest
centre. Children that are small enough are packed with their neighbours into leaves of fewer than twice that
many vectors; inside a leaf the nets go on down to the vectors themselves. Vectors that no net parts (equal directions, or
nearly all of a node in one child) are dealt by a hash of the level and their id, so every second round at the least makes nodes
smaller by a known factor. Every node has a centre and a covering radius, the furthest that any of its vectors lies from it.

The traversal starts at the pair (root, root). It drops a pair of nodes whose covering radii keep their vectors further
apart than r, accepts a pair whose vectors are all within r (counted by the nodes' weights, at whatever level), and opens
the rest. Pairs of the upper tree are rows of a table. Pairs of leaves are walked in tasks of bounded size: ``Sizes.group``
neighbouring leaves on either side travel together, each as one row. At the bottom the exact cosine in double precision
decides. Equal vectors are one vector with a weight. Tasks return counts and a label per vector, never the links.

Where the bounds drop nothing, as for random directions in many dimensions, all leaves meet: the number of products then
grows with the square of the distinct vectors, which is the method's nature and not a limit set here.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different lengths never link; rows without a vec_id link with nothing and stay; rows of a repeated vec_id are vectors of
their own for counts and one node for components; ties at the threshold are links; the order and the partitions of rows
do not matter; an empty table gives no rows; extra columns are ignored. There are no texts here.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, mix64, table
from .components import components


class Sizes(NamedTuple):
    """What bounds a node and a task. Tasks get it with their function, never from this module's globals."""

    sample: int = 2048  # vectors that a node is split on
    fan: int = 256  # children of a node at most
    chunk: int = 1024  # vectors of a leaf (less than twice that)
    group: int = 8  # leaves that a task holds of either side
    placed: int = 4096  # vectors that a task places among a node's children
    some: int = 16  # a sample's coarsest net with so many centres splits a node
    stuck: float = 0.9  # a child with more than this share of its parent's vectors is dealt by hash


#: Radii of the nested nets inside a leaf.
RADII = (1.0, 0.5, 0.25, 0.125, 0.0625)
#: Distances from dot products of unit vectors may be off by this at most; covering radii and comparisons allow for it.
NOISE = 1e-7
#: Most that single precision can be off by for the dot product of unit vectors.
ROUNDING = 1e-5
#: Node pairs that are looked at together.
AT_ONCE = 1 << 16


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def chord(cosine):
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


def net(x: np.ndarray, radius: float, within: np.ndarray) -> np.ndarray:
    """For each row its leader: a row of the same group of ``within`` and no further than the radius. Leaders lead themselves."""
    lead, least = np.full(len(x), -1), 1 - radius * radius / 2
    for group in np.unique(within):
        left = np.flatnonzero(within == group)
        first = group if lead[group] < 0 else left[0]
        while len(left):
            near = x[left] @ x[first] >= least
            near |= left == first
            lead[left[near]] = first
            left = left[~near]
            first = left[0] if len(left) else first
    return lead


def levels(x: np.ndarray) -> list[np.ndarray]:
    """The nested nets of a leaf, from the coarse to the fine; the last level is the vectors themselves."""
    out, within = [], np.zeros(len(x), np.int64)
    for radius in RADII:
        within = net(x, radius, within)
        out.append(within)
    return [*out, np.arange(len(x))]


class Labels:
    """Union-find over the local rows of a task, for many links at once."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up

    def join_rows(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.roots()
            a, b = root[a], root[b]
            own = a != b
            a, b = np.maximum(a[own], b[own]), np.minimum(a[own], b[own])
            np.minimum.at(self.up, a, b)


class Side:
    """A leaf's vectors and its levels: per level the leaders, their covering radii, each row's node and the nodes' weights."""

    def __init__(self, x: np.ndarray, leads: list[np.ndarray], weight: np.ndarray):
        self.x, self.norm, self.unit, self.weight = x, np.linalg.norm(x, axis=1), unit(x), weight
        self.single = self.unit.astype(np.float32)
        self.who, self.reach, self.node, self.held, self.size, self.below = [], [], [], [], [], []
        for lead in leads:
            who, node = np.unique(lead, return_inverse=True)
            far = chord(np.einsum("ij,ij->i", self.unit, self.unit[lead])) + NOISE
            far[lead == np.arange(len(x))] = 0
            reach = np.zeros(len(who))
            np.maximum.at(reach, node, far)
            self.who.append(who)
            self.reach.append(reach)
            self.node.append(node)
            self.size.append(np.bincount(node, minlength=len(who)))
            self.held.append(np.bincount(node, weights=weight, minlength=len(who)).astype(np.int64))
        for node, below in zip(self.node, self.who[1:]):
            parent = node[below]
            order = np.argsort(parent, kind="stable")
            self.below.append((order, np.searchsorted(parent[order], np.arange(node.max(initial=-1) + 2))))


def traverse(one: Side, two: Side, same: bool, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted link counts of both sides' rows and a label per row (rows of the second follow those of the first). With
    ``same`` both sides are one leaf, and the counts of both add up."""
    r, n = math.sqrt(2 - 2 * least), len(one.x)
    count_a, count_b, labels = np.zeros(n, np.int64), np.zeros(len(two.x), np.int64), Labels(n if same else n + len(two.x))
    shift = 0 if same else n

    def singles(ra: np.ndarray, rb: np.ndarray) -> None:
        """Row pairs one by one, by their exact cosine."""
        cosine = np.einsum("ij,ij->i", one.x[ra], two.x[rb]) / (one.norm[ra] * two.norm[rb])
        hit = (cosine >= least) & (ra != rb if same else True)
        ra, rb = ra[hit], rb[hit]
        np.add.at(count_a, ra, two.weight[rb])
        np.add.at(count_b, rb, one.weight[ra])
        labels.join_rows(ra, rb + shift)

    def accepted(k: int, pa: np.ndarray, pb: np.ndarray) -> None:
        """All rows of the nodes pa[i] link with all rows of pb[i]."""
        own = same & (pa == pb)
        inside = np.zeros(len(one.who[k]), bool)
        inside[pa[own]] = True
        count_a[:] += np.where(inside[one.node[k]], one.held[k][one.node[k]] - one.weight, 0)
        add = np.bincount(pa[~own], weights=two.held[k][pb[~own]], minlength=len(one.who[k])).astype(np.int64)
        count_a[:] += add[one.node[k]]
        add = np.bincount(pb[~own], weights=one.held[k][pa[~own]], minlength=len(two.who[k])).astype(np.int64)
        count_b[:] += add[two.node[k]]
        for side, nodes, by in ((one, pa, 0), (two, pb, shift)):
            met = np.zeros(len(side.who[k]), bool)
            met[nodes] = True
            rows = np.flatnonzero(met[side.node[k]])
            labels.join_rows(rows + by, side.who[k][side.node[k][rows]] + by)
        labels.join_rows(one.who[k][pa], two.who[k][pb] + shift)

    def opened(k: int, pa: np.ndarray, pb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of the children of node pairs; of a node with itself each pair once."""
        (order_a, first_a), (order_b, first_b) = one.below[k], two.below[k]
        nb = np.diff(first_b)[pb]
        total = np.diff(first_a)[pa] * nb
        own = np.repeat(np.arange(len(pa)), total)
        step = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        a, b = order_a[first_a[pa[own]] + step // nb[own]], order_b[first_b[pb[own]] + step % nb[own]]
        if same:
            once = (pa[own] != pb[own]) | (a <= b)
            a, b = a[once], b[once]
        return a, b

    def visit(k: int, pa: np.ndarray, pb: np.ndarray) -> None:
        """Node pairs (pa[i], pb[i]) of level k; with ``same``, a node's pair with itself or pairs of two nodes once."""
        apart = chord(np.einsum("ij,ij->i", one.unit[one.who[k][pa]], two.unit[two.who[k][pb]]))
        reach = one.reach[k][pa] + two.reach[k][pb]
        keep = apart <= r + reach + NOISE
        full = keep & (apart + reach < r - NOISE) & (reach > 0)
        if full.any():
            accepted(k, pa[full], pb[full])
        rest = keep & ~full
        alone = rest & (one.size[k][pa] == 1) & (two.size[k][pb] == 1)
        singles(one.who[k][pa[alone]], two.who[k][pb[alone]])
        rest &= ~alone
        if rest.any():
            pa, pb = pa[rest], pb[rest]
            up = np.cumsum(np.diff(one.below[k][1])[pa] * np.diff(two.below[k][1])[pb])
            for part in np.split(np.arange(len(pa)), np.searchsorted(up, np.arange(AT_ONCE, up[-1], AT_ONCE))):
                if len(part):
                    visit(k + 1, *opened(k, pa[part], pb[part]))

    def close(k: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pair of the two leaves, opened: nodes i with all nodes of the other side that covering radii cannot keep
        apart, by one matrix product. Single precision only widens the bound."""
        reach_a, reach_b = one.reach[k][i], two.reach[k]
        bound = lambda x: 1 - np.minimum(2, x) ** 2 / 2 - ROUNDING
        dots = one.single[one.who[k][i]] @ two.single[two.who[k]].T
        ok = dots >= np.float32(bound(r))
        wide_a, wide_b = np.flatnonzero(reach_a > 0), np.flatnonzero(reach_b > 0)
        ok[:, wide_b] = dots[:, wide_b] >= bound(r + reach_b[wide_b])
        ok[wide_a] = dots[wide_a] >= bound(r + reach_a[wide_a][:, None] + reach_b[None, :])
        if same:
            ok &= i[:, None] <= np.arange(len(two.who[k]))[None, :]
        p, q = np.nonzero(ok)
        return i[p], q

    # Levels on which both sides are one node say no more than the leaves' own radii.
    k = next((k for k in range(len(one.who)) if max(len(one.who[k]), len(two.who[k])) > 1), len(one.who) - 1)
    step = max(1, (1 << 21) // max(1, len(two.who[k])))
    for low in range(0, len(one.who[k]), step):
        pa, pb = close(k, np.arange(low, min(low + step, len(one.who[k]))))
        for cut in range(0, len(pa), AT_ONCE):
            visit(k, pa[cut : cut + AT_ONCE], pb[cut : cut + AT_ONCE])
    return count_a, count_b, labels.roots()


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x (components as double, without negative zeros) of the rows that can link."""
    x = F.transform(vectors["embedding"], lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null").where(F.col("x").isNotNull() & (F.size("x") > 0) & ~bad & F.exists("x", lambda v: v != 0))
    return rows.select("vec_id", F.transform("x", lambda v: v + F.lit(0.0)).alias("x"))


def centres_of(x: np.ndarray, held: int, stuck: bool = False, sizes: Sizes = Sizes()) -> np.ndarray:
    """Centres of the children of a node of ``held`` vectors, from its sample: the coarsest of the halving nets with
    several centres, in an order in which neighbours are near. Where no net parts the sample, or nets got ``stuck`` at the
    node, one centre several times."""
    radius, who = 2.0, np.zeros(1, np.int64)
    while radius > 1e-6 and not stuck:
        lead = net(x, radius, np.zeros(len(x), np.int64))
        who, size = np.unique(lead, return_counts=True)
        if len(who) >= min(sizes.some, len(x)):
            break
        radius /= 2
    if len(who) < 2:
        return np.repeat(x[:1], min(sizes.fan, max(1, -(-2 * held // sizes.chunk))), axis=0)
    who = who[np.argsort(-size, kind="stable")[: sizes.fan]]
    near = x[who] @ x[who].T
    order, left = [0], np.ones(len(who), bool)
    left[0] = False
    while left.any():
        order.append(int(np.where(left, near[order[-1]], -np.inf).argmax()))
        left[order[-1]] = False
    return x[who[order]]


def dealt(ids: np.ndarray, level: int, parts: int) -> np.ndarray:
    """A part for each id, by a hash of level and id: ids that met in a part of one level part again at the next."""
    salt = mix64(np.array([level + 1], np.uint64))
    return (mix64(ids.astype(np.uint64) ^ salt) % np.uint64(parts)).astype(np.int64)


def _matrix(column, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float).reshape(-1, dim) if len(column) else np.empty((0, dim))


def _splitter(dim: int, sizes: Sizes):
    """The function that gives a node's children their centres, from its sample."""

    def split(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = centres_of(unit(_matrix(pdf.sort_values("id")["x"], dim)), int(pdf["held"].iloc[0]), bool(pdf["stuck"].iloc[0]), sizes)
        return pd.DataFrame({"cell": key[0], "child": np.arange(len(found), dtype="int32"), "centre": found.tolist()})

    return split


def _placer(dim: int, level: int):
    """The function that sends vectors to the nearest of their node's centres, or deals them where all centres are one."""

    def place(pdf: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("id", "int64"), ("x", object), ("weight", "int64"), ("cell", object), ("child", "int32"), ("far", "float64"))})
        centres = centres.sort_values("child")
        c, u = _matrix(centres["centre"], dim), unit(_matrix(pdf["x"], dim))
        dots = u @ c.T
        child = dealt(pdf["id"].to_numpy(), level, len(c)) if len(c) > 1 and (c == c[0]).all() else dots.argmax(axis=1)
        far = chord(dots[np.arange(len(u)), child]) + NOISE
        return pdf[["id", "x", "weight", "cell"]].assign(child=child.astype("int32"), far=far)

    return place


def _leaves(scratch: Scratch, own: DataFrame, dim: int, total: int, sizes: Sizes) -> tuple[DataFrame, DataFrame]:
    """The upper tree: vectors with their leaf (id, x, weight, leaf), and its inner nodes (node, parent, centre, reach, weight, rep)."""
    spark = own.sparkSession
    if total <= sizes.chunk:  # the root's one child is a leaf
        return own.select("id", "x", "weight", F.lit("0:0").alias("leaf")), spark.createDataFrame([], "node string, parent string, centre array<double>, reach double, weight long, rep long")
    rows, leaves, nodes, depth = own.select("id", "x", "weight", F.lit("0").alias("cell"), F.lit(total).alias("held"), F.lit(False).alias("stuck")), None, None, 0
    cells = spark.createDataFrame([("0", total)], "cell string, held long")
    while True:
        share = F.least(F.lit(1.0), F.lit(float(sizes.sample)) / F.col("held"))
        sample = rows.where(F.pmod(F.xxhash64(F.lit(depth), "id"), F.lit(1 << 30)) < F.ceil(share * (1 << 30)))
        centres = scratch.keep(sample.select("cell", "id", "x", "held", "stuck").groupBy("cell").applyInPandas(_splitter(dim, sizes), "cell string, child int, centre array<double>"), f"centres{dim}-{depth}")
        parts = F.ceil(F.col("held") / sizes.placed)
        salted = rows.select("id", "x", "weight", "cell", F.pmod(F.xxhash64(F.lit(-1), "id"), parts).alias("salt"))
        sent = centres.join(cells, "cell").select("cell", "child", "centre", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("salt"))
        placed = salted.groupBy("cell", "salt").cogroup(sent.groupBy("cell", "salt")).applyInPandas(_placer(dim, depth), "id long, x array<double>, weight long, cell string, child int, far double")
        placed = scratch.keep(placed, f"placed{dim}-{depth}")
        children = placed.groupBy("cell", "child").agg(F.count("*").alias("held"), F.max("far").alias("reach"), F.sum("weight").alias("weight"), F.min("id").alias("rep"))
        children = scratch.keep(children, f"children{dim}-{depth}")
        up = F.sum("held").over(W.partitionBy("cell").orderBy("child"))
        small = children.where(F.col("held") <= sizes.chunk).select("cell", "child", F.concat("cell", F.lit(":"), F.floor((up - F.col("held")) / sizes.chunk).cast("string")).alias("leaf"))
        own_leaves = placed.join(small, ["cell", "child"]).select("id", "x", "weight", "leaf")
        leaves = own_leaves if leaves is None else leaves.unionByName(own_leaves)
        large = children.where(F.col("held") > sizes.chunk).withColumn("node", F.concat("cell", F.lit("."), F.col("child").cast("string")))
        inner = large.join(centres, ["cell", "child"]).select("node", F.col("cell").alias("parent"), "centre", "reach", "weight", "rep")
        nodes = inner if nodes is None else nodes.unionByName(inner)
        if not large.limit(1).count():
            return leaves, nodes
        large = large.join(cells.select("cell", F.col("held").alias("_of")), "cell").withColumn("stuck", F.col("held") > sizes.stuck * F.col("_of"))
        large = scratch.keep(large.select("cell", "child", "node", "held", "stuck"), f"large{dim}-{depth}")
        rows = placed.join(large, ["cell", "child"]).select("id", "x", "weight", F.col("node").alias("cell"), "held", "stuck")
        cells = large.select(F.col("node").alias("cell"), "held")
        depth += 1


def _apart(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))


def _pairs(scratch: Scratch, nodes: DataFrame, r: float, dim: int) -> tuple[DataFrame, DataFrame]:
    """Dual traversal of the upper tree from (root, root): pairs of leaves that are left, and pairs of nodes accepted whole."""
    of_leaf = nodes.where("leaf")
    below = nodes.unionByName(of_leaf.withColumn("parent", F.col("node")))
    side = lambda s: below.select(F.col("parent").alias(f"up_{s}"), F.col("node").alias(s), F.col("leaf").alias(f"leaf_{s}"), F.col("centre").alias(f"centre_{s}"), F.col("reach").alias(f"reach_{s}"))
    spark, round_, left, whole = nodes.sparkSession, 0, None, None
    pairs = spark.createDataFrame([("0", "0")], "up_a string, up_b string")
    while True:
        met = pairs.join(side("a"), "up_a").join(side("b"), "up_b").where((F.col("up_a") != F.col("up_b")) | (F.col("a") <= F.col("b")))
        reach = F.col("reach_a") + F.col("reach_b")
        judged = met.select("a", "b", "leaf_a", "leaf_b", _apart(F.col("centre_a"), F.col("centre_b")).alias("apart"), reach.alias("reach")).where(F.col("apart") <= r + F.col("reach") + NOISE)
        judged = scratch.keep(judged.select("a", "b", (F.col("leaf_a") & F.col("leaf_b")).alias("leaves"), (F.col("apart") + F.col("reach") < r - NOISE).alias("whole")), f"pairs{dim}-{round_}")
        a, b = judged.where("leaves and not whole").select("a", "b"), judged.where("whole").select("a", "b")
        left, whole = (a, b) if left is None else (left.unionByName(a), whole.unionByName(b))
        pairs = judged.where("not leaves and not whole").select(F.col("a").alias("up_a"), F.col("b").alias("up_b"))
        if not pairs.limit(1).count():
            return left, whole
        round_ += 1


def _linked(scratch: Scratch, own: DataFrame, dim: int, total: int, least: float, narrow: bool, sizes: Sizes) -> tuple[DataFrame, DataFrame]:
    """Counts (id, links) and label edges (a, b) of the vectors of one length. ``narrow``: components are single precision."""
    kind, r = ("float" if narrow else "double"), math.sqrt(2 - 2 * least)
    placed, inner = _leaves(scratch, own, dim, total, sizes)

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = _matrix(pdf["x"], dim)
        u = unit(x)
        middle = u.mean(axis=0)
        size = np.linalg.norm(middle)
        middle = middle / size if size > 1e-9 else u[0]
        row = {"node": key[0], "parent": key[0].rsplit(":", 1)[0], "centre": middle.tolist(), "reach": float(chord(u @ middle).max() + NOISE), "weight": int(pdf["weight"].sum()), "rep": int(pdf["id"].min())}
        row |= {"ids": pdf["id"].tolist(), "weights": pdf["weight"].tolist(), "leads": np.concatenate(levels(u)[:-1]).astype("int32"), "x": x.reshape(-1).astype("float32" if narrow else "float64")}
        return pd.DataFrame([row])

    head = "node string, parent string, centre array<double>, reach double, weight long, rep long"
    grown = scratch.keep(placed.groupBy("leaf").applyInPandas(grow, f"{head}, ids array<long>, weights array<long>, leads array<int>, x array<{kind}>"), f"leaves{dim}")
    names = ["node", "parent", "centre", "reach", "weight", "rep"]
    nodes = grown.select(*names, F.lit(True).alias("leaf")).unionByName(inner.select(*names, F.lit(False).alias("leaf")))
    left, whole = _pairs(scratch, nodes, r, dim)

    # Pairs of leaves, a task for each pair of groups of neighbouring leaves.
    group = lambda c: F.concat(F.substring_index(c, ":", 1), F.lit(":"), F.floor(F.substring_index(c, ":", -1).cast("long") / sizes.group).cast("string"))
    turned = group(F.col("a")) > group(F.col("b"))
    todo = left.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b")).withColumn("ga", group(F.col("a"))).withColumn("gb", group(F.col("b")))
    holds = todo.select("ga", "gb", F.col("a").alias("node")).unionByName(todo.select("ga", "gb", F.col("b").alias("node"))).distinct()
    carried = holds.join(grown.select("node", "ids", "weights", "leads", "x"), "node")

    def walk(leaves: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        side, ids, out = {}, {}, []
        for row in leaves.itertuples():
            n = len(row.ids)
            ids[row.node] = np.asarray(row.ids, np.int64)
            side[row.node] = Side(np.asarray(row.x, float).reshape(n, dim), [*np.asarray(row.leads, np.int64).reshape(-1, n), np.arange(n)], np.asarray(row.weights, np.int64))
        for a, b in zip(pairs["a"], pairs["b"]):
            ca, cb, root = traverse(side[a], side[b], a == b, least)
            who, counts = (ids[a], ca + cb) if a == b else (np.concatenate([ids[a], ids[b]]), np.concatenate([ca, cb]))
            met = counts > 0
            out.append((who[met], counts[met], who[root][met]))
        every = [np.concatenate(c) if out else np.empty(0, np.int64) for c in zip(*out)] or [np.empty(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("id", "links", "label"), every)))

    found = carried.groupBy("ga", "gb").cogroup(todo.toDF("a", "b", "pa", "pb").groupBy("pa", "pb")).applyInPandas(walk, "id long, links long, label long")
    found = scratch.keep(found, f"found{dim}")
    counts, edges = found.select("id", "links"), found.where("id <> label").select(F.col("label").alias("a"), F.col("id").alias("b"))
    if not whole.limit(1).count():
        return counts.groupBy("id").agg(F.sum("links").alias("links")), edges

    # Pairs accepted whole: each vector below a node links with all the weight of the other, and with its node's own.
    facts = nodes.select("node", "weight", "rep")
    one, two = facts.select(F.col("node").alias("a"), F.col("weight").alias("wa"), F.col("rep").alias("ra")), facts.select(F.col("node").alias("b"), F.col("weight").alias("wb"), F.col("rep").alias("rb"))
    known = scratch.keep(whole.join(one, "a").join(two, "b"), f"whole{dim}")
    gains = known.select(F.col("a").alias("node"), F.col("wb").alias("gain"), (F.col("a") == F.col("b")).cast("int").alias("own")).unionByName(known.where("a <> b").select(F.col("b").alias("node"), F.col("wa").alias("gain"), F.lit(0).alias("own")))
    gains = gains.groupBy("node").agg(F.sum("gain").alias("gain"), F.max("own").alias("own"))
    path = F.split(F.substring_index("leaf", ":", 1), r"\.")
    ancestors = F.concat(F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.array_join(F.slice(path, 1, i), ".")), F.array("leaf"))
    below = placed.select("id", "weight", F.explode(ancestors).alias("node")).join(gains.join(facts.select("node", "rep"), "node"), "node")
    below = scratch.keep(below.select("id", (F.col("gain") - F.col("own") * F.col("weight")).alias("links"), "rep"), f"gained{dim}")
    more = below.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).unionByName(known.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    return counts.unionByName(below.select("id", "links")).groupBy("id").agg(F.sum("links").alias("links")), edges.unionByName(more)


def near_duplicates(vectors: DataFrame, least: float = 0.9, sizes: Sizes = Sizes()) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, copies (how many rows hold the very same vector)."""
    scratch, narrow = Scratch(vectors.sparkSession, "vectors"), dict(vectors.dtypes)["embedding"] == "array<float>"
    usable = _usable(vectors)
    classes = usable.groupBy("x").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"))
    classes = scratch.keep(classes.select(F.monotonically_increasing_id().alias("id"), "x", "low", "weight", F.size("x").alias("dim")), "classes")
    counts, edges = None, None
    for dim, total in sorted(map(tuple, classes.groupBy("dim").count().collect())):
        c, e = _linked(scratch, classes.where(F.col("dim") == dim).select("id", "x", "weight"), dim, total, least, narrow, sizes)
        counts, edges = (c, e) if counts is None else (counts.unionByName(c), edges.unionByName(e))
    x = F.transform(F.transform(vectors["embedding"], lambda v: v.cast("double")), lambda v: v + F.lit(0.0))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), x.alias("x"))
    if counts is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1).cast("long").alias("copies"))
    # A vec_id that several different vectors share is one node of the components.
    often = usable.groupBy("vec_id").agg(F.count("*").alias("rows")).where("rows > 1").select("vec_id")
    shared = usable.join(often, "vec_id").join(classes.select("x", "id"), "x").groupBy("vec_id").agg(F.min("id").alias("a"), F.collect_set("id").alias("bs"))
    label = components(scratch, edges.unionByName(shared.select("a", F.explode("bs").alias("b"))), "labels")
    of_class = classes.join(counts, "id", "left").join(label, classes["id"] == label["node"], "left").select("id", "low", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    lowest = of_class.groupBy("component").agg(F.min("low").alias("component_id"))
    per_class = classes.select("id", "x").join(of_class.join(lowest, "component"), "id")
    out = rows.join(per_class, (rows["x"] == per_class["x"]) & rows["vec_id"].isNotNull(), "left").drop(per_class["x"])
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"), F.coalesce("weight", F.lit(1)).cast("long").alias("copies")
    )


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)
