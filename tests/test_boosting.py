"""Boosted trees with L1 and L2 terms against a plain version."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.ml import boosting
from riskweave.ml.models import fit_model, load_model
from riskweave.ml.tuning import SPACES, sample_candidates
from riskweave.schemas import MODEL_FEATURES, MODEL_TARGET


def made_rows(n=600, seed=5):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b, c = rng.randint(0, 9), round(rng.gauss(0, 1), 2), rng.choice([0.0, 1.0])
        p = 1 / (1 + math.exp(-(0.6 * a - 3 + 1.5 * b * (a > 4) - c)))
        rows.append((a, b if rng.random() > 0.05 else None, c, int(rng.random() < p)))
    return rows


def plain_boosting(x, y, w, cuts, n, depth, rate, least, alpha, ridge):
    """The same by rows: each node looks at every cut with its own rows."""
    def soft(g):
        return math.copysign(max(abs(g) - alpha, 0), g)

    def score(g, h):
        return soft(g) ** 2 / (h + ridge)

    def grow(idx, g, h, d):
        gt, ht = g[idx].sum(), h[idx].sum()
        best = (1e-6, None)
        if d < depth:
            for f, cs in enumerate(cuts):
                for c in cs:
                    left = idx[x[idx, f] < c]
                    right = idx[x[idx, f] >= c]
                    hl, hr = h[left].sum(), h[right].sum()
                    if hl >= least and hr >= least and len(left) and len(right):
                        gain = 0.5 * (score(g[left].sum(), hl) + score(g[right].sum(), hr) - score(gt, ht))
                        if gain > best[0] + 1e-9:
                            best = (gain, (left, right))
        if best[1] is None:
            margin[idx] += rate * (-soft(gt) / (ht + ridge))
            return
        for part in best[1]:
            grow(part, g, h, d + 1)

    margin = np.zeros(len(y))
    for _ in range(n):
        p = 1 / (1 + np.exp(-margin))
        grow(np.arange(len(y)), w * (p - y), w * p * (1 - p), 0)
    return margin


@pytest.fixture(scope="module")
def made(spark):
    rows = made_rows()
    return rows, spark.createDataFrame(rows, "a long, b double, c double, y int").repartition(3)


@pytest.mark.parametrize("alpha, ridge", [(0.0, 1.0), (2.0, 1.0), (0.0, 20.0)])
def test_trees_equal_a_plain_version(made, alpha, ridge):
    rows, df = made
    cuts = [[2.0, 4.0, 5.0, 7.0], [-1.0, -0.3, 0.4, 1.1], [1.0]]
    model = boosting.fit(df, ["a", "b", "c"], "y", weight=F.lit(1.5), cuts=cuts, n_estimators=4, max_depth=3, learning_rate=0.4, min_child_weight=3.0, reg_alpha=alpha, reg_lambda=ridge)
    x = np.array([[r[0], -np.inf if r[1] is None else r[1], r[2]] for r in rows], float)
    y = np.array([r[3] for r in rows], float)
    want = plain_boosting(x, y, np.full(len(y), 1.5), cuts, 4, 3, 0.4, 3.0, alpha, ridge)
    got = {(r.a, r.b, r.c): r.m for r in df.select("a", "b", "c", model.margin().alias("m")).collect()}
    for r, m in zip(rows, want, strict=True):
        assert got[r[0], r[1], r[2]] == pytest.approx(m, abs=1e-6)


def test_terms_change_the_trees_and_find_the_signal(made):
    rows, df = made
    loss = {}
    weights = {}
    for alpha, ridge in ((0.0, 0.1), (5.0, 0.1), (0.0, 100.0)):
        model = boosting.fit(df, ["a", "b", "c"], "y", n_estimators=9, max_depth=3, reg_alpha=alpha, reg_lambda=ridge, subsample=0.8, colsample_bytree=0.7)
        assert boosting.BoostedTrees.from_json(model.to_json()) == model
        weights[alpha, ridge] = max(abs(w) for w in model.trees[0].weight)
        loss[alpha, ridge] = model.score(df, "p").agg(F.avg(-F.log(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))))).first()[0]
    assert weights[0.0, 0.1] > weights[5.0, 0.1] > 0 and weights[0.0, 0.1] > weights[0.0, 100.0] > 0
    assert loss[0.0, 0.1] < loss[5.0, 0.1] < 0.6 and loss[0.0, 0.1] < loss[0.0, 100.0]


def test_result_does_not_depend_on_partitions(made):
    _, df = made
    a, b = (boosting.fit(d, ["a", "b"], "y", n_estimators=2, max_depth=2, cuts=[[3.0, 6.0], [0.0]]) for d in (df, df.coalesce(1)))
    assert a == b


def test_hard_columns(spark):
    df = spark.createDataFrame([(1.0, None, 5.0, 0), (2.0, None, 5.0, 1), (None, None, 5.0, 1)] * 5, "a double, b double, c double, y int")
    model = boosting.fit(df, ["a", "b", "c"], "y", n_estimators=2, max_depth=2, min_child_weight=0.0)
    assert model.score(df).filter("score is null or isnan(score)").count() == 0
    assert boosting.fit(df.limit(0), ["a"], "y", n_estimators=1, max_depth=1).trees[0].weight == [0.0, 0.0]
    for bad in ({"reg_alpha": -1}, {"subsample": 0}, {"n_estimators": 0}):
        with pytest.raises(ValueError):
            boosting.fit(df, ["a"], "y", **bad)


def test_models_with_terms_are_saved_and_loaded(spark, tmp_path):
    rng = random.Random(1)
    rows = [tuple(float(rng.randint(0, 9)) for _ in MODEL_FEATURES) + (int(rng.random() < 0.3),) for _ in range(120)]
    df = spark.createDataFrame(rows, [*MODEL_FEATURES, MODEL_TARGET])
    model = fit_model("boosted_trees", {"n_estimators": 2, "max_depth": 2, "reg_alpha": 0.1, "reg_lambda": 1.0, "scale_pos_weight": True}, df)
    model.save(str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m"))
    assert again.score(df).select("score").collect() == model.score(df).select("score").collect()
    assert set(df.columns) | {"score"} == set(model.score(df).columns)


def test_search_space_has_both_terms():
    assert len(SPACES["boosted_trees"]) == 8
    chosen = sample_candidates("boosted_trees", 40)
    assert {"reg_alpha", "reg_lambda"} <= set(chosen[0]) and len({c["reg_lambda"] for c in chosen}) > 1
