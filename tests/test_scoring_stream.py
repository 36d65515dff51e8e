"""Requests scored as a stream: refusals, predictions and counters."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from riskweave.ml.policy import IDENTITY, INPUT_TYPES
from riskweave.schemas import MODEL_FEATURES
from riskweave.streaming.ingest import StreamPaths, start_queries
from riskweave.streaming.scoring import LATENCY_BUCKETS, REQUEST, SCORE_BUCKETS, ScoringCounters, judge_requests, refused_requests, score_counters, score_stream

MOMENT = datetime(2026, 9, 3, 12, tzinfo=timezone.utc)


def tx(id_=1, **changes):
    row = {"transaction_id": id_, "tx_datetime": MOMENT, "customer_id": 7, "terminal_id": 9, **{f: 1.0 if t == "double" else 1 for f, t in INPUT_TYPES.items()}}
    return tuple({**row, **changes}[c] for c in (*IDENTITY, *MODEL_FEATURES))


def requests(spark, named):
    return spark.createDataFrame(list(named.items()), REQUEST)


def predict(df):
    p = F.least(F.col("tx_amount") / 100, F.lit(1.0))
    return df.withColumn("fraud_probability", p).withColumn("threshold_decision", p >= 0.5)


CASES = {
    "good": ([tx(1), tx(2, customer_previous_mean_amount=None, amount_to_customer_previous_mean=None)], []),
    "null": (None, ["no_transactions"]),
    "empty": ([], ["no_transactions"]),
    "many": ([tx(i) for i in range(1, 5)], ["too_many_transactions"]),
    "twice": ([tx(1), tx(1)], ["repeated_transaction_id"]),
    "hole": ([tx(1), None], ["missing_value"]),
    "nulls": ([tx(None), tx(None)], ["missing_value"]),
    "no amount": ([tx(1, tx_amount=None)], ["missing_value"]),
    "id": ([tx(1, customer_id=0)], ["id_not_positive"]),
    "nan": ([tx(1, customer_previous_mean_amount=float("nan"))], ["amount_not_finite_or_negative"]),
    "inf": ([tx(1, tx_amount=float("inf"))], ["amount_not_finite_or_negative"]),
    "hour": ([tx(1), tx(2, transaction_hour=24)], ["value_out_of_range"]),
    "all": ([tx(1, is_night=2, tx_amount=-1.0), tx(1, terminal_previous_transaction_count=-1, terminal_id=None)], ["repeated_transaction_id", "missing_value", "amount_not_finite_or_negative", "value_out_of_range", "history_count_negative"]),
}


def test_reasons(spark):
    df = requests(spark, {n: r for n, (r, _) in CASES.items()})
    assert {r["request_id"]: r["reasons"] for r in judge_requests(df, 3).collect()} == {n: reasons for n, (_, reasons) in CASES.items()}
    assert {r[0] for r in refused_requests(df, 3).collect()} == set(CASES) - {"good"}
    with pytest.raises(ValueError):
        judge_requests(df, 0)
    with pytest.raises(ValueError, match="missing"):
        judge_requests(df.drop("transactions"))


def test_counters_equal_a_batch_over_the_same_requests(spark, tmp_path):
    rng = range(60)
    named = {f"r{i}": [tx(100 * i + j + 1, tx_amount=float((i * 7 + j * 13) % 120) - (1 if i % 9 == 0 else 0)) for j in range(1 + i % 5)] for i in rng}
    df = requests(spark, named)
    batch = score_stream(df, predict, "batch")
    expected = batch.select(*(c for c in score_counters())).first().asDict()
    counters, paths = ScoringCounters("live"), StreamPaths(str(tmp_path / "out"), str(tmp_path / "check"))
    spark.streams.addListener(counters)
    try:
        for part in (0, 1):  # stopped between the parts
            df.filter(F.pmod(F.hash("request_id"), F.lit(2)) == part).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            query = start_queries({"p": score_stream(stream, predict, "live")}, paths, prefix="live", trigger=None)["p"]
            query.awaitTermination()
            counters.wait(query)
    finally:
        spark.streams.removeListener(counters)
    out = spark.read.parquet(str(tmp_path / "out/p"))
    assert out.exceptAll(batch).isEmpty() and batch.exceptAll(out).isEmpty()
    refused = refused_requests(df).count()
    assert refused > 0 and counters.totals == {**expected, "accepted": 60 - refused, "refused": refused}
    assert sum(counters.latencies) == 60 and counters.latency_sum > 0
    text = counters.text()
    assert f"fraud_scoring_transactions_total {expected['rows']}\n" in text and 'fraud_scoring_requests_total{status="refused"} ' + str(refused) in text
    assert f'fraud_scoring_probability_bucket{{le="+Inf"}} {expected["rows"]}' in text and "fraud_scoring_request_duration_seconds_count 60\n" in text


def test_repeated_batches_count_once():
    c = ScoringCounters("x")
    c.add("q", 0, {"accepted": 2, "refused": 1, "rows": 5}, 0.2)
    c.add("q", 1, {"accepted": 1, "refused": 0, "rows": 1}, 100.0)
    c.add("q", 1, {"accepted": 1, "refused": 0, "rows": 2}, 0.001)  # run again after a restart
    c.add("q", 0, {"accepted": 2, "refused": 1, "rows": 5}, 0.2)
    c.add("other", 0, {"accepted": 1, "refused": 0, "rows": 1}, 0.001)
    assert c.totals == {"accepted": 4, "refused": 1, "rows": 8}
    assert sum(c.latencies) == 5 and c.latencies[0] == 2 and c.latencies[-1] == 0 and round(c.latency_sum, 6) == 0.602
    assert len(c.latencies) == len(LATENCY_BUCKETS) + 1 and list(SCORE_BUCKETS) == sorted(SCORE_BUCKETS)
    with pytest.raises(TimeoutError):
        c.wait(type("Q", (), {"runId": "none"})(), 0.01)
