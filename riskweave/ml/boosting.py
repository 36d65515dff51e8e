"""Boosted trees by second-order histograms, with L1 and L2 terms.

Every tree is grown level by level. A level is one grouped aggregate: sums of
gradients and hessians of the logistic loss per (node, feature, bin), with
partial aggregation, so the shuffle and what the driver sees are bounded by
nodes times features times bins whatever the number of rows. The driver picks
the splits from these sums. Sums are taken of fixed-point numbers, so that
they, and with them the trees, do not depend on the order of rows.

A split's gain is half of what the scores of its two sides exceed that of the
node, where a side's score is T(G)^2 / (H + lambda), T takes ``reg_alpha`` off
the gradient sum toward zero, and both sides need ``min_child_weight`` of
hessian. A leaf weighs -T(G) / (H + lambda). A value below a split's cut goes
left; nulls count as smaller than everything.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import require_positive
from ..sources.store import scratch

#: No split: every value is below it.
NEVER = 1.7976931348623157e308
LEAST_GAIN = 1e-6
#: Trees whose margins are computed anew in every pass before they are written with the rows.
TREES_IN_PLAN = 8
BINS = 256


@dataclass(frozen=True)
class Tree:
    """A complete binary tree in heap order: inner nodes, then the weights of the lowest level."""

    feature: list[int]
    bin: list[int]
    cut: list[float]
    gain: list[float]
    weight: list[float]


@dataclass(frozen=True)
class BoostedTrees:
    """Trees over ``columns``; each adds ``learning_rate`` times the weight of the leaf that a row falls in."""

    columns: tuple[str, ...]
    depth: int
    learning_rate: float
    trees: tuple[Tree, ...]

    def margin(self) -> Column:
        """Log odds of class 1; one expression whatever the number of trees."""
        x = values(self.columns)
        kind = "array<struct<feature:array<int>,cut:array<double>,weight:array<double>>>"
        trees = F.from_json(F.lit(json.dumps([{"feature": t.feature, "cut": t.cut, "weight": t.weight} for t in self.trees])), kind)
        leaf = lambda t: t["weight"][walk(lambda i: x[t["feature"][i]] >= t["cut"][i], self.depth) - (2**self.depth - 1)]
        return F.aggregate(trees, F.lit(0.0), lambda sum_, t: sum_ + leaf(t)) * self.learning_rate

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        return df.withColumn(name, 1 / (1 + F.exp(-self.margin())))

    def to_json(self) -> str:
        return json.dumps({"columns": self.columns, "depth": self.depth, "learning_rate": self.learning_rate, "trees": [vars(t) for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> BoostedTrees:
        m = json.loads(text)
        return cls(tuple(m["columns"]), m["depth"], m["learning_rate"], tuple(Tree(**t) for t in m["trees"]))


def values(columns) -> Column:
    return F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(-math.inf)) for c in columns))


def walk(right, depth: int) -> Column:
    """Number of the node that a row reaches after ``depth`` steps; ``right(i)`` says whether it goes right at node i."""
    if not depth:
        return F.lit(0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), lambda i, _: 2 * i + 1 + right(i).cast("int"))


def find_cuts(df: DataFrame, columns, bins: int = BINS) -> list[list[float]]:
    """At most ``bins`` - 1 cuts a column, at its quantiles; the smallest value is none, as nothing is below it."""
    places = [i / bins for i in range(1, bins)] + [1.0]
    row = df.agg(*(e for i, c in enumerate(columns) for e in (F.percentile_approx(F.col(c).cast("double"), places, 10_000).alias(f"q{i}"), F.min(F.col(c).cast("double")).alias(f"m{i}")))).first()
    return [sorted({x for x in row[f"q{i}"] or [] if x > row[f"m{i}"]}) for i in range(len(columns))]


def binned(df: DataFrame, columns, cuts: list[list[float]]) -> DataFrame:
    """Adds ``_bins``: per column the number of cuts that are not above its value."""
    several = [i for i, c in enumerate(cuts) if c]
    x = df.select("*", *(values([columns[i]])[0].alias(f"_v{i}") for i in several))
    if several:
        splits = [[-math.inf, *cuts[i], math.inf] for i in several]
        x = Bucketizer(splitsArray=splits, inputCols=[f"_v{i}" for i in several], outputCols=[f"_b{i}" for i in several]).transform(x)
    return x.select(*df.columns, F.array(*(F.col(f"_b{i}").cast("int") if i in several else F.lit(0) for i in range(len(cuts)))).alias("_bins"))


def soft(g, alpha: float):
    """``g`` taken toward zero by ``alpha``."""
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


class Grower:
    """Grows one tree from the histograms of its levels."""

    def __init__(self, depth: int, cuts, features, *, min_child_weight: float, reg_alpha: float, reg_lambda: float):
        self.depth, self.cuts, self.features = depth, cuts, features
        self.least, self.alpha, self.ridge = min_child_weight, reg_alpha, reg_lambda
        inner = 2**depth - 1
        self.feature, self.bin, self.cut, self.gain = [0] * inner, [1 << 30] * inner, [NEVER] * inner, [0.0] * inner
        self.sums: dict[int, tuple[float, float]] = {}
        self.open: list[int] = [0]

    def score(self, g, h):
        return soft(g, self.alpha) ** 2 / np.maximum(h + self.ridge, 1e-300)

    def level(self, histograms: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> None:
        """Split the open nodes; ``histograms`` has gradient and hessian sums a bin of every open node and feature."""
        following = []
        for node in self.open:
            best = (LEAST_GAIN, None)
            for f in self.features:
                g, h = histograms[node, f]
                self.sums.setdefault(node, (float(g.sum()), float(h.sum())))
                gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
                gt, ht = self.sums[node]
                gr, hr = gt - gl, ht - hl
                gain = 0.5 * (self.score(gl, hl) + self.score(gr, hr) - self.score(np.float64(gt), np.float64(ht)))
                gain[(hl < self.least) | (hr < self.least)] = -np.inf
                if len(gain) and gain[at := int(np.argmax(gain))] > best[0]:
                    best = (float(gain[at]), (f, at, (float(gl[at]), float(hl[at])), (float(gr[at]), float(hr[at]))))
            if best[1]:
                f, at, left, right = best[1]
                self.feature[node], self.bin[node], self.cut[node], self.gain[node] = f, at, float(self.cuts[f][at]), best[0]
                self.sums[2 * node + 1], self.sums[2 * node + 2] = left, right
                following += [2 * node + 1, 2 * node + 2]
        self.open = following

    def tree(self) -> Tree:
        weights = []
        for leaf in range(2**self.depth - 1, 2 ** (self.depth + 1) - 1):
            at = leaf
            while at not in self.sums:  # rows of a node that was not split go left to the lowest level
                at = (at - 1) // 2 if at % 2 else -1
                if at < 0:
                    break
            g, h = self.sums.get(at, (0.0, 0.0))
            weights.append(float(-soft(g, self.alpha) / (h + self.ridge)) if at >= 0 and h + self.ridge > 0 else 0.0)
        return Tree(self.feature, self.bin, self.cut, self.gain, weights)


def fit(df: DataFrame, columns, label: str, *, weight: Column | None = None, n_estimators: int = 100, max_depth: int = 6, learning_rate: float = 0.3, min_child_weight: float = 1.0, subsample: float = 1.0, colsample_bytree: float = 1.0, reg_alpha: float = 0.0, reg_lambda: float = 1.0, bins: int = BINS, cuts: list[list[float]] | None = None, seed: int = 42) -> BoostedTrees:
    """Boosted trees of the logistic loss, starting at even odds. Rows without a label or weight are an error of the caller."""
    require_positive(n_estimators, "n_estimators")
    require_positive(max_depth, "max_depth")
    if min(reg_alpha, reg_lambda, min_child_weight) < 0 or not 0 < subsample <= 1 or not 0 < colsample_bytree <= 1:
        raise ValueError("penalties and min_child_weight must not be negative, shares must be within (0, 1]")
    columns, folder = tuple(columns), scratch(df.sparkSession)
    cuts = cuts or find_cuts(df, columns, bins)
    start = binned(df, columns, cuts).select(F.col(label).cast("double").alias("y"), (F.lit(1.0) if weight is None else weight).cast("double").alias("w"), F.col("_bins").alias("b"), F.lit(0.0).alias("margin"), F.monotonically_increasing_id().alias("id"))
    rows = _written(start, f"{folder}/rows-0")
    total = rows.agg(F.sum("w")).first()[0] or 1.0
    unit = 2.0 ** min(30, math.floor(61 - math.log2(max(total, 1.0))))  # sums of fixed-point numbers stay below 2^62
    trees: list[Tree] = []
    pending = F.col("margin")
    for number in range(n_estimators):
        features = sorted(random.Random(f"{seed} {number}").sample(range(len(columns)), max(1, round(colsample_bytree * len(columns)))))
        p = 1 / (1 + F.exp(-F.col("m")))
        taken = rows if subsample == 1 else rows.filter(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(number)), F.lit(1 << 20)) < int(subsample * (1 << 20)))
        taken = taken.select("b", "y", "w", pending.alias("m")).select("b", F.floor(F.col("w") * (p - F.col("y")) * unit).cast("long").alias("g"), F.floor(F.col("w") * p * (1 - p) * unit).cast("long").alias("h"))
        grower = Grower(max_depth, cuts, features, min_child_weight=min_child_weight, reg_alpha=reg_alpha, reg_lambda=reg_lambda)
        for depth in range(max_depth):
            if not grower.open:
                break
            grower.level(_histograms(taken, grower, depth, unit))
        trees.append(grower.tree())
        pending = pending + learning_rate * _weight_of(trees[-1], max_depth)
        if (number + 1) % TREES_IN_PLAN == 0 and number + 1 < n_estimators:
            rows = _written(rows.select("y", "w", "b", pending.alias("margin"), "id"), f"{folder}/rows-{number + 1}")
            pending = F.col("margin")
    return BoostedTrees(columns, max_depth, learning_rate, tuple(trees))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _literal(columns: dict[str, list], kinds: str) -> Column:
    return F.from_json(F.lit(json.dumps(columns)), f"struct<{kinds}>")


def leaf_of(tree: Tree, depth: int, bins: str = "_bins") -> Column:
    """Number of the lowest node that a binned row falls in."""
    t = _literal({"f": tree.feature, "k": tree.bin}, "f:array<int>,k:array<int>")
    return walk(lambda i: F.col(bins)[t["f"][i]] > t["k"][i], depth)


def _weight_of(tree: Tree, depth: int) -> Column:
    return _literal({"w": tree.weight}, "w:array<double>")["w"][leaf_of(tree, depth, "b") - (2**depth - 1)]


def _histograms(rows: DataFrame, grower: Grower, depth: int, unit: float) -> dict:
    """Gradient and hessian sums of every open node of the level, one grouped aggregate."""
    t = _literal({"f": grower.feature, "k": grower.bin}, "f:array<int>,k:array<int>")
    node = walk(lambda i: F.col("b")[t["f"][i]] > t["k"][i], depth)
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col("b")[f].alias("k")) for f in grower.features)))
    kept = rows.select("b", "g", "h", node.alias("node")).filter(F.col("node").isin(grower.open))
    sums = kept.select("node", "g", "h", cells.alias("c")).groupBy("node", "c.f", "c.k").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    out = {(n, f): (np.zeros(len(grower.cuts[f]) + 1), np.zeros(len(grower.cuts[f]) + 1)) for n in grower.open for f in grower.features}
    for r in sums.collect():
        out[r["node"], r["f"]][0][r["k"]], out[r["node"], r["f"]][1][r["k"]] = r["g"] / unit, r["h"] / unit
    return out
