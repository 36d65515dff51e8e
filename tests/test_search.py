"""The search over candidates, several at a time."""

import threading
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from riskweave.ml.tuning import Fold, prequential_folds, run_together, search, write_folds


def dataset(spark, days=12, a_day=20):
    rows = spark.range(days * a_day).withColumn("tx_datetime", F.to_timestamp(F.lit("2026-01-01")) + F.make_interval(days=(F.col("id") / a_day).cast("int"), hours=(F.col("id") % a_day).cast("int")))
    amount = (F.col("id") * 7919 % 101).cast("double")
    return rows.select(F.col("id").alias("transaction_id"), "tx_datetime", F.to_date("tx_datetime").alias("transaction_date"), (F.col("id") % 13).alias("customer_id"), amount.alias("tx_amount"), (amount > 80).cast("int").alias("tx_fraud"))


class Ranking:
    """A stand-in whose quality depends on C: scores by amount, the wrong way round for small C."""

    def __init__(self, c):
        self.c = c

    def score(self, df):
        p = F.col("tx_amount") / 101
        return df.withColumn("score", p if self.c >= 1 else 1 - p)


def fit(model, parameters, train):
    assert train.count() > 0
    return Ranking(parameters["C"])


def test_same_winner_and_results_as_serially(spark):
    df = dataset(spark)
    folds = prequential_folds(df, folds=2, assessment_days=2, gap_days=1)
    runs = [search(df, "logistic_regression", folds, fit, n_candidates=4, k=3, parallelism=n) for n in (1, 3)]
    assert runs[0] == runs[1] and len(runs[0][1]) == 4
    assert runs[0][0].parameters["C"] >= 1 and runs[0][0].mean("roc_auc") == 1.0


def test_folds_are_written_once(spark):
    df = dataset(spark)
    folds = prequential_folds(df, folds=2, assessment_days=2, gap_days=1)
    seen = spark.sparkContext.accumulator(0)
    reads = df.select("transaction_id", "tx_datetime", "transaction_date", "customer_id", "tx_amount", "tx_fraud").rdd.map(lambda r: (seen.add(1), r)[1]).toDF(df.schema)
    tables = write_folds(reads, folds)
    for table, fold in zip(tables, folds, strict=True):
        assert table.train.exceptAll(fold.train(df)).isEmpty() and fold.train(df).exceptAll(table.train).isEmpty()
        assert table.assess.exceptAll(fold.assess(df)).isEmpty() and fold.assess(df).exceptAll(table.assess).isEmpty()
    assert seen.value == 2 * 240
    with pytest.raises(ValueError, match="one class"):
        write_folds(df.withColumn("tx_fraud", F.lit(0)), folds)
    early = datetime(2025, 1, 1, tzinfo=timezone.utc)
    with pytest.raises(ValueError, match="one class"):
        write_folds(df, [Fold(1, early, folds[0].start, folds[0].end)])


def test_limit_pools_and_failures(spark):
    running, most, pools, lock = 0, 0, set(), threading.Lock()

    def work(i):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        pools.add(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
        n = spark.range(1000 * (i + 1)).count()
        time.sleep(0.05)
        with lock:
            running -= 1
        return n

    assert run_together(spark, [lambda i=i: work(i) for i in range(8)], 3) == [1000 * (i + 1) for i in range(8)]
    assert 1 < most <= 3 and 1 < len(pools) <= 3 and None not in pools
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    late = []

    def fail():
        raise ValueError("no fit")

    slow = lambda: spark.range(4).select(F.udf(lambda x: time.sleep(20) or x, "long")("id")).collect()
    begin = time.time()
    with pytest.raises(ValueError, match="no fit"):
        run_together(spark, [slow, fail, lambda: late.append(1), lambda: late.append(2)], 2)
    assert time.time() - begin < 15 and len(late) < 2
    with pytest.raises(ValueError):
        run_together(spark, [], 0)
