"""Prequential folds, parameter candidates, Card Precision@k and the search over them."""

from __future__ import annotations

import math
import random
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import partial

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import require_columns, require_none, require_positive, require_rows
from ..sources.store import scratch
from .metrics import ranking_metrics, require_scores
from .thresholds import card_days

#: The parameter spaces that are searched.
SPACES = {
    "logistic_regression": {"C": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0], "class_weight": [None, "balanced"]},
    "boosted_trees": {
        "n_estimators": [100, 200, 300, 500],
        "max_depth": [3, 4, 6, 8],
        "learning_rate": [0.01, 0.03, 0.05, 0.1, 0.2],
        "min_child_weight": [1, 3, 5, 10],
        "subsample": [0.6, 0.8, 1.0],
        "colsample_bytree": [0.6, 0.8, 1.0],
        "reg_alpha": [0.0, 0.01, 0.1, 1.0],
        "reg_lambda": [0.1, 1.0, 5.0, 10.0],
    },
}


@dataclass(frozen=True)
class Fold:
    """Training before ``train_end``, assessment in [start, end)."""

    number: int
    train_end: datetime
    start: datetime
    end: datetime

    def train(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col("tx_datetime") < _moment(self.train_end))

    def assess(self, df: DataFrame) -> DataFrame:
        return df.filter((F.col("tx_datetime") >= _moment(self.start)) & (F.col("tx_datetime") < _moment(self.end)))


def _moment(t: datetime):
    return F.to_timestamp(F.lit(t.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")))


def prequential_folds(df: DataFrame, *, folds: int, assessment_days: int, gap_days: int) -> list[Fold]:
    """Expanding folds that end with the last day; each needs rows on both sides."""
    require_positive(folds, "folds")
    require_positive(assessment_days, "assessment_days")
    if isinstance(gap_days, bool) or gap_days < 0:
        raise ValueError("gap_days must not be negative")
    bounds = df.agg(F.max(F.unix_micros(F.col("tx_datetime").cast("timestamp"))).alias("last")).first()
    if bounds["last"] is None:
        raise ValueError("the data has no rows")
    last = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=bounds["last"])
    end = last.replace(hour=0, minute=0, second=0, microsecond=0) + timedelta(days=1)
    out = []
    for i in range(folds):
        start = end - timedelta(days=assessment_days * (folds - i))
        out.append(Fold(i + 1, start - timedelta(days=gap_days), start, start + timedelta(days=assessment_days)))
    counts = df.agg(*(F.count_if(F.col("tx_datetime") < _moment(f.train_end)).alias(f"t{f.number}") for f in out), *(F.count_if((F.col("tx_datetime") >= _moment(f.start)) & (F.col("tx_datetime") < _moment(f.end))).alias(f"a{f.number}") for f in out)).first()
    for f in out:
        if not counts[f"t{f.number}"] or not counts[f"a{f.number}"]:
            raise ValueError(f"fold {f.number} has no rows to train on or to assess")
    return out


def sample_candidates(model: str, n: int, seed: int = 42) -> list[dict]:
    """n different parameter sets of a model's space, in a fixed order."""
    if model not in SPACES:
        raise ValueError(f"unknown model: {model}")
    names, choices = list(SPACES[model]), list(SPACES[model].values())
    size = math.prod(map(len, choices))
    if require_positive(n, "n") > size:
        raise ValueError(f"{model} has {size} parameter sets")
    out = []
    for place in random.Random(seed).sample(range(size), n):  # places in the grid, whose last parameter changes fastest
        values = []
        for options in reversed(choices):
            place, at = divmod(place, len(options))
            values.append(options[at])
        out.append(dict(zip(names, reversed(values), strict=True)))
    return out


def card_precision_at_k(df: DataFrame, k: int, score: str = "score") -> float:
    """Mean over days of frauds among the k highest cards, each divided by k.

    A card that was caught (in the top k of an earlier day and fraudulent) is
    left out from then on. Ties in a day go to the card that comes first by
    position, here its first transaction. Cards are ranked in Spark; the driver
    walks over the best 2 k of every day and fetches twice as many from the
    first day on where so many were caught before that k are not left.
    """
    require_positive(k, "k")
    require_columns(df, ["transaction_date", "customer_id", "tx_fraud", score], "scored data")
    require_rows(df, "scored data")
    require_none(df, {
        "transaction_date must not be missing": F.col("transaction_date").isNull(),
        "customer_id must not be missing": F.col("customer_id").isNull(),
        "tx_fraud must be 0 or 1": F.col("tx_fraud").isNull() | ~F.col("tx_fraud").isin(0, 1),
        "scores must be finite and within 0..1": F.col(score).isNull() | F.isnan(score) | ~F.col(score).between(0, 1),
    })
    cards = card_days(df, score, place=True).select("transaction_date", "customer_id", F.col("tx_fraud").alias("fraud"), F.col("score").alias("s"), "place")
    order = Window.partitionBy("transaction_date").orderBy(F.desc("s"), F.asc("place"), F.asc("customer_id"))
    ranked = cards.withColumn("r", F.row_number().over(order)).select("transaction_date", "customer_id", "fraud", "r").persist(StorageLevel.DISK_ONLY)
    try:
        days = [r[0] for r in ranked.select("transaction_date").distinct().orderBy("transaction_date").collect()]
        best, depth, begin = {}, 0, 0
        while True:
            depth = 2 * max(k, depth)
            best.update(_best_of_days(ranked, days[begin], depth))
            begin, hits = _walk(days, best, k)
            if begin is None:
                return hits / (k * len(days))
    finally:
        ranked.unpersist()


def _best_of_days(ranked: DataFrame, first_day, depth: int) -> dict:
    """The best ``depth`` cards of the days from ``first_day`` on, and whether a day has more."""
    out: dict = {}
    rows = ranked.filter((F.col("transaction_date") >= F.lit(first_day)) & (F.col("r") <= depth + 1)).orderBy("transaction_date", "r")
    for row in rows.toLocalIterator():
        cards, _ = out.setdefault(row["transaction_date"], ([], False))
        if row["r"] > depth:
            out[row["transaction_date"]] = (cards, True)
        else:
            cards.append((row["customer_id"], row["fraud"]))
    return out


def _walk(days: list, best: dict, k: int) -> tuple[int | None, int]:
    """Hits of all days, or the place of the first day whose list is too short."""
    caught, hits = set(), 0
    for i, day in enumerate(days):
        cards, more = best[day]
        top = [x for x in cards if x[0] not in caught][:k]
        if len(top) < k and more:
            return i, 0
        found = [c for c, fraud in top if fraud == 1]
        caught.update(found)
        hits += len(found)
    return None, hits


@dataclass(frozen=True)
class FoldResult:
    fold: int
    average_precision: float
    roc_auc: float
    card_precision_at_k: float


@dataclass(frozen=True)
class CandidateResult:
    model: str
    parameters: dict
    folds: list[FoldResult] = field(default_factory=list)

    def mean(self, name: str) -> float:
        return sum(getattr(f, name) for f in self.folds) / len(self.folds)


@dataclass(frozen=True)
class FoldTables:
    """A fold's rows on both sides, written once for all candidates."""

    number: int
    train: DataFrame
    assess: DataFrame


def write_folds(df: DataFrame, folds: list[Fold], label: str = "tx_fraud") -> list[FoldTables]:
    """Write the rows of each fold to the shared folder: one read of ``df`` a fold, whose training classes are observed in that pass."""
    root, spark, out = scratch(df.sparkSession), df.sparkSession, []
    for fold in folds:
        training = F.col("tx_datetime") < _moment(fold.train_end)
        assessed = (F.col("tx_datetime") >= _moment(fold.start)) & (F.col("tx_datetime") < _moment(fold.end))
        seen, place = Observation(), f"{root}/fold-{fold.number}"
        parts = df.withColumn("_side", F.when(training, "train").when(assessed, "assess")).filter(F.col("_side").isNotNull())
        counts = (F.count_if((F.col("_side") == "train") & (F.col(label) == value)).alias(f"c{value}") for value in (0, 1))
        parts.observe(seen, *counts).write.partitionBy("_side").parquet(place)
        if not all(seen.get[f"c{value}"] for value in (0, 1)):
            raise ValueError(f"fold {fold.number} trains on one class only")
        train, assess = (spark.read.schema(df.schema).parquet(f"{place}/_side={side}") for side in ("train", "assess"))
        out.append(FoldTables(fold.number, train, assess))
    return out


def evaluate_candidate(tables: list[FoldTables], model: str, parameters: dict, fit: Callable, *, k: int, label: str = "tx_fraud") -> CandidateResult:
    """Fit on each fold's training rows and measure on its assessment rows.

    ``fit(model, parameters, train)`` returns something whose ``score(df)`` adds
    the column score.
    """
    results = []
    for fold in tables:
        scored = fit(model, parameters, fold.train).score(fold.assess).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            require_scores(scored, label, "score")
            r = ranking_metrics(scored, label).first()
            results.append(FoldResult(fold.number, r["average_precision"], r["roc_auc"], card_precision_at_k(scored, k)))
        finally:
            scored.unpersist()
    return CandidateResult(model, parameters, results)


def best_candidate(results: list[CandidateResult]) -> CandidateResult:
    """Largest mean average precision, then Card Precision@k; the first wins ties."""
    if not results:
        raise ValueError("no candidates were evaluated")
    return max(results, key=lambda r: (r.mean("average_precision"), r.mean("card_precision_at_k")))


def run_together(spark: SparkSession, work: list[Callable], parallelism: int) -> list:
    """Results of all calls in their order, at most ``parallelism`` of them at a time.

    Each call's jobs have a pool of their own, so that with fair scheduling (see
    ``session``) a long fit does not hold back the others. If a call fails, calls
    that wait are dropped, jobs of those that run are cancelled, and its error is
    raised.
    """
    require_positive(parallelism, "parallelism")
    tag = f"together-{uuid.uuid4().hex}"

    def call(i: int, f: Callable):
        context = spark.sparkContext
        context.setLocalProperty("spark.scheduler.pool", f"{tag}-{i % parallelism}")
        context.addJobTag(tag)
        try:
            return f()
        finally:
            context.removeJobTag(tag)
            context.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(parallelism) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(call), i, f) for i, f in enumerate(work)]
        done, _ = wait(futures, return_when=FIRST_EXCEPTION)
        failed = next((f.exception() for f in futures if f in done and not f.cancelled() and f.exception()), None)
        if failed:
            for f in futures:
                f.cancel()
            while not all(f.done() for f in futures):  # a call between two jobs starts its next one after a cancellation
                spark.sparkContext.cancelJobsWithTag(tag)
                wait(futures, timeout=1)
            raise failed
    return [f.result() for f in futures]


def search(df: DataFrame, model: str, folds: list[Fold], fit: Callable, *, n_candidates: int, k: int, seed: int = 42, parallelism: int = 4) -> tuple[CandidateResult, list[CandidateResult]]:
    """The best of ``n_candidates`` sampled parameter sets, and all results in the order of sampling.

    Folds are written once; ``parallelism`` candidates are fitted at a time,
    which changes neither results nor winner.
    """
    chosen = sample_candidates(model, n_candidates, seed)
    tables = write_folds(df, folds)
    results = run_together(df.sparkSession, [partial(evaluate_candidate, tables, model, p, fit, k=k) for p in chosen], parallelism)
    return best_candidate(results), results
