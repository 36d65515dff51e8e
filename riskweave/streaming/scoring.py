"""Scoring requests as a stream, with counters that Spark observes while rows pass.

A request is a row with an id and an array of transactions. It is judged whole:
one bad transaction, a repeated id or too many transactions refuse it, with the
reasons in order, and no transaction of a refused request is scored. Counters
are observed metrics of each batch; a query listener adds them up. They cost no
job of their own, and a batch that is repeated after a restart replaces its own
counts instead of adding to them.
"""

from __future__ import annotations

import threading
from bisect import bisect_left
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..contracts import require_columns, require_positive
from ..functions.rules import evaluate_once
from ..functions.scalars import any_true
from ..ml.policy import IDENTITY, INPUT_TYPES
from ..schemas import MODEL_FEATURES

#: The upper bounds of the score histogram, and those of the latency histogram in seconds (the usual ones of a Prometheus client).
SCORE_BUCKETS = (0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0)
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
#: Most transactions of a request, and the names of the exported metrics.
MAX_TRANSACTIONS = 100
REQUESTS_TOTAL, LATENCY, SCORED_TOTAL, DECISIONS_TOTAL, PROBABILITY = (
    "fraud_scoring_requests_total", "fraud_scoring_request_duration_seconds", "fraud_scoring_transactions_total", "fraud_scoring_threshold_decisions_total", "fraud_scoring_probability",
)
TRANSACTION = "struct<" + ",".join(["transaction_id:bigint", "tx_datetime:timestamp", "customer_id:bigint", "terminal_id:bigint", *(f"{f}:{INPUT_TYPES[f]}" for f in MODEL_FEATURES)]) + ">"
REQUEST = f"request_id string, transactions array<{TRANSACTION}>"
OPTIONAL = ("customer_previous_mean_amount", "amount_to_customer_previous_mean")


def transaction_rules(t: Column) -> dict[str, Column]:
    """What a transaction of a request must not be, by reason; null counts as no."""
    needed = [t[c] for c in (*IDENTITY, *MODEL_FEATURES) if c not in OPTIONAL]
    amounts = [t[f] for f in MODEL_FEATURES if INPUT_TYPES[f] == "double"]
    counts = [t[f] for f in MODEL_FEATURES if f.endswith("_count")]
    return {
        "missing_value": any_true(*(c.isNull() for c in needed)),
        "id_not_positive": any_true(*(t[c] <= 0 for c in ("transaction_id", "customer_id", "terminal_id"))),
        "amount_not_finite_or_negative": any_true(*(F.isnan(c) | (F.abs(c) == float("inf")) | (c < 0) for c in amounts)),
        "value_out_of_range": any_true(~t["is_weekend"].isin(0, 1), ~t["is_night"].isin(0, 1), ~t["transaction_hour"].between(0, 23), ~t["day_of_week"].between(0, 6)),
        "history_count_negative": any_true(*(c < 0 for c in counts)),
    }


def judge_requests(requests: DataFrame, max_transactions: int = MAX_TRANSACTIONS) -> DataFrame:
    """Requests with ``reasons``, in order; none means that the request is scored."""
    require_columns(requests, ["request_id", "transactions"], "scoring requests")
    require_positive(max_transactions, "max_transactions")
    rows, size = F.col("transactions"), F.coalesce(F.size("transactions"), F.lit(0))
    names = list(transaction_rules(F.lit(None).cast(TRANSACTION)))
    found = F.transform(rows, lambda t: F.array(*(F.when(c, F.lit(n)) for n, c in transaction_rules(t).items())))
    seen = F.coalesce(F.array_distinct(F.flatten(found)), F.array().cast("array<string>"))
    ids = F.filter(F.transform(rows, lambda t: t["transaction_id"]), lambda i: i.isNotNull())
    whole = {
        "no_transactions": size <= 0,
        "too_many_transactions": size > max_transactions,
        "repeated_transaction_id": F.coalesce(F.size(ids) > F.size(F.array_distinct(ids)), F.lit(False)),
    }
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in whole.items()), *(F.when(F.array_contains(seen, n), F.lit(n)) for n in names)))
    return evaluate_once(requests.select("request_id", "transactions"), {"reasons": reasons})


def request_counters() -> list[Column]:
    refused = F.size("reasons") > 0
    return [F.count_if(~refused).alias("accepted"), F.count_if(refused).alias("refused")]


def score_counters() -> list[Column]:
    """Scored rows, decisions, the sum of scores in millionths and cumulative counts of scores."""
    p = F.col("fraud_probability")
    buckets = [F.count_if(p <= b).alias(f"le{i}") for i, b in enumerate(SCORE_BUCKETS)]
    return [F.count(F.lit(1)).alias("rows"), F.count_if("threshold_decision").alias("decisions"), F.coalesce(F.sum(F.round(p * 1_000_000).cast("bigint")), F.lit(0)).alias("score_millionths"), *buckets]


def score_stream(requests: DataFrame, predict: Callable[[DataFrame], DataFrame], name: str, *, max_transactions: int = MAX_TRANSACTIONS) -> DataFrame:
    """Predictions of accepted requests, with observed counters under ``name``; stream or table.

    ``predict`` adds fraud_probability and threshold_decision, as an approved
    policy does. A transaction keeps its request's id.
    """
    judged = judge_requests(requests, max_transactions).observe(f"{name}-requests", *request_counters())
    rows = judged.filter(F.size("reasons") == 0).select("request_id", F.inline("transactions"))
    scored = predict(rows).select("request_id", *IDENTITY, "fraud_probability", "threshold_decision")
    return scored.observe(f"{name}-scores", *score_counters())


def refused_requests(requests: DataFrame, max_transactions: int = MAX_TRANSACTIONS) -> DataFrame:
    """Refused requests with their reasons."""
    return judge_requests(requests, max_transactions).filter(F.size("reasons") > 0).select("request_id", "reasons")


class ScoringCounters(StreamingQueryListener):
    """Adds up what the batches of the scoring streams of one name observed.

    Batches are told apart by query and number, so a batch that is reported
    again counts once. Every request of a batch waits for that batch, so its
    latency is the batch's; batches without requests have none. The driver holds
    totals, and for each query only the counts of its newest batch.
    """

    def __init__(self, name: str):
        self.name = name
        self.totals: dict[str, int] = {}
        self.latencies = [0] * (len(LATENCY_BUCKETS) + 1)
        self.latency_sum = 0.0
        self._newest: dict[str, tuple[int, dict, float]] = {}
        self._ended: set[str] = set()
        self._lock = threading.Condition()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        observed: dict = {}
        for part in ("requests", "scores"):
            row = progress.observedMetrics.get(f"{self.name}-{part}")
            observed |= row.asDict() if row is not None else {}
        if observed:
            self.add(str(progress.id), progress.batchId, {k: int(v or 0) for k, v in observed.items()}, progress.batchDuration / 1000)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self._lock:
            self._ended.add(str(event.runId))
            self._lock.notify_all()

    def add(self, query: str, batch: int, observed: dict, seconds: float) -> None:
        """Count a batch; one that is not newer than the newest replaces it or is known already."""
        with self._lock:
            number, before, took = self._newest.get(query, (-1, {}, 0.0))
            if batch < number:
                return
            if batch == number:
                self._count(before, took, -1)
            self._count(observed, seconds, 1)
            self._newest[query] = (batch, observed, seconds)

    def _count(self, observed: dict, seconds: float, sign: int) -> None:
        for k, v in observed.items():
            self.totals[k] = self.totals.get(k, 0) + sign * v
        requests = sign * (observed.get("accepted", 0) + observed.get("refused", 0))
        self.latencies[bisect_left(LATENCY_BUCKETS, seconds)] += requests
        self.latency_sum += requests * seconds

    def wait(self, query, timeout: float = 60.0) -> None:
        """Until the end of a query has been reported, and with it all of its batches."""
        with self._lock:
            if not self._lock.wait_for(lambda: str(query.runId) in self._ended, timeout):
                raise TimeoutError("the end of the query was not reported")

    def samples(self) -> Iterator[tuple[str, dict, float]]:
        """(metric, labels, value) of everything that was counted; histograms are cumulative."""
        with self._lock:
            t = dict(self.totals)
            latencies, latency_sum = list(self.latencies), self.latency_sum
        for status in ("accepted", "refused"):
            yield REQUESTS_TOTAL, {"status": status}, t.get(status, 0)
        yield SCORED_TOTAL, {}, t.get("rows", 0)
        yield DECISIONS_TOTAL, {}, t.get("decisions", 0)
        for i, b in enumerate(SCORE_BUCKETS):
            yield f"{PROBABILITY}_bucket", {"le": str(b)}, t.get(f"le{i}", 0)
        yield f"{PROBABILITY}_bucket", {"le": "+Inf"}, t.get("rows", 0)
        yield f"{PROBABILITY}_sum", {}, t.get("score_millionths", 0) / 1_000_000
        yield f"{PROBABILITY}_count", {}, t.get("rows", 0)
        running = 0
        for bound, n in zip((*map(str, LATENCY_BUCKETS), "+Inf"), latencies, strict=True):
            running += n
            yield f"{LATENCY}_bucket", {"le": bound}, running
        yield f"{LATENCY}_sum", {}, latency_sum
        yield f"{LATENCY}_count", {}, running

    def text(self) -> str:
        """The counters in Prometheus' text format."""
        kinds = {REQUESTS_TOTAL: "counter", SCORED_TOTAL: "counter", DECISIONS_TOTAL: "counter", PROBABILITY: "histogram", LATENCY: "histogram"}
        lines, last = [], None
        for metric, labels, value in self.samples():
            family = next(k for k in kinds if metric.startswith(k))
            if family != last:
                lines.append(f"# TYPE {family} {kinds[family]}")
                last = family
            shown = ",".join(f'{k}="{v}"' for k, v in labels.items())
            lines.append(f"{metric}{{{shown}}} {value}" if shown else f"{metric} {value}")
        return "\n".join(lines) + "\n"
