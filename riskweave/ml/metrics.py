"""Ranking and threshold metrics as DataFrame aggregates.

Rows are reduced to distinct scores first; running totals over scores have two
levels (ranges between quantiles of the distinct scores, then within a range),
so no window runs over the whole table in one task, wherever scores crowd.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import require_none, require_rows

GRID = 1024


@dataclass(frozen=True)
class BinaryMetrics:
    threshold: float
    average_precision: float
    roc_auc: float
    precision: float
    recall: float
    f1: float
    true_negatives: int
    false_positives: int
    false_negatives: int
    true_positives: int

    def as_dict(self) -> dict:
        return asdict(self)


def require_scores(df: DataFrame, label: str, score: str) -> None:
    """Labels 0 or 1, both there; scores finite and within 0..1."""
    require_rows(df, "scored data")
    require_none(df, {
        "scores must be finite and within 0..1": F.col(score).isNull() | F.isnan(score) | ~F.col(score).between(0, 1),
        "labels must be 0 or 1": F.col(label).isNull() | ~F.col(label).isin(0, 1),
    })
    if df.agg(F.count_distinct(label)).first()[0] != 2:
        raise ValueError("labels of both classes are needed")


def by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score: rows of each class, and those with a higher score.

    Columns score, pos, neg, pos_above, neg_above.
    """
    scores = df.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    bounds = scores.agg(F.percentile_approx("score", [i / GRID for i in range(1, GRID)], 10 * GRID).alias("b")).first()["b"] or []
    splits = [-float("inf"), *sorted({float(b) for b in bounds}), float("inf")]
    scores = scores.withColumn("score", F.col("score").cast("double"))
    scores = Bucketizer(splits=splits, inputCol="score", outputCol="cell").transform(scores) if len(splits) > 2 else scores.withColumn("cell", F.lit(0.0))
    cells = scores.groupBy("cell").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    higher = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("cell", F.coalesce(F.sum("p").over(higher), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("n0"))
    within = Window.partitionBy("cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    joined = scores.join(cells, "cell")
    return joined.select("score", "pos", "neg", (F.col("p0") + F.coalesce(F.sum("pos").over(within), F.lit(0))).alias("pos_above"), (F.col("n0") + F.coalesce(F.sum("neg").over(within), F.lit(0))).alias("neg_above"))


def ranking_metrics(df: DataFrame, label: str = "tx_fraud", score: str = "score") -> DataFrame:
    """One row: average_precision (sum of recall gained times precision) and roc_auc (ties count half)."""
    rows = by_score(df, label, score)
    tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    weighted = F.col("pos").cast("double") * tp / (tp + fp)
    below = F.sum("pos").cast("double") * F.sum("neg")
    wins = F.sum(F.col("neg").cast("double") * (2 * F.col("pos_above") + F.col("pos"))) / 2
    return rows.agg((F.sum(weighted) / F.nullif(F.sum("pos").cast("double"), F.lit(0.0))).alias("average_precision"), (wins / F.nullif(below, F.lit(0.0))).alias("roc_auc"))


def safe(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def confusion(df: DataFrame, threshold: float, label: str = "tx_fraud", score: str = "score") -> DataFrame:
    """One row: the confusion counts at an inclusive threshold, precision, recall, f1."""
    alert, fraud = F.col(score) >= threshold, F.col(label) == 1
    counts = df.agg(
        F.count_if(~alert & ~fraud).alias("true_negatives"),
        F.count_if(alert & ~fraud).alias("false_positives"),
        F.count_if(~alert & fraud).alias("false_negatives"),
        F.count_if(alert & fraud).alias("true_positives"),
    )
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return counts.select("*", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def evaluate_binary(df: DataFrame, threshold: float, label: str = "tx_fraud", score: str = "score") -> BinaryMetrics:
    """All metrics of scored rows; the threshold lies within 0..1, both excluded."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold must be between 0 and 1")
    require_scores(df, label, score)
    r, c = ranking_metrics(df, label, score).first(), confusion(df, threshold, label, score).first()
    return BinaryMetrics(threshold, r["average_precision"], r["roc_auc"], c["precision"], c["recall"], c["f1"], c["true_negatives"], c["false_positives"], c["false_negatives"], c["true_positives"])


#: Upper bounds of the score histogram.
SCORE_BUCKETS = (0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0)


def score_histogram(df: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Cumulative counts by upper bound, as a metrics endpoint would show them."""
    bounds = df.agg(*(F.count_if(F.col(score) <= b).alias(f"b{i}") for i, b in enumerate(SCORE_BUCKETS)), F.count_if(F.col(score) >= threshold).alias("alerts"), F.count(F.lit(1)).alias("scored"))
    rows = F.array(*(F.struct(F.lit(b).alias("upper_bound"), F.col(f"b{i}").alias("row_count")) for i, b in enumerate(SCORE_BUCKETS)))
    return bounds.select(F.explode(rows).alias("r"), "alerts", "scored").select("r.upper_bound", "r.row_count", "alerts", "scored")
