"""The approved policy: a model, its threshold and the evidence for both; batch scoring with it."""

from __future__ import annotations

import math
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import require_columns, require_none
from ..schemas import MODEL_FEATURES
from ..sources.files import load_json_object
from .models import FittedModel, load_model
from .publish import read_locked_policy
from .thresholds import CAPACITY_SCOPE

IDENTITY = ("transaction_id", "tx_datetime", "customer_id", "terminal_id")
#: Types of the model's inputs in a scoring request.
INPUT_TYPES = {f: "double" if "amount" in f else "bigint" if "count" in f else "int" for f in MODEL_FEATURES}


@dataclass(frozen=True)
class PolicyMetadata:
    model_name: str
    model_artifact: str
    threshold: float
    daily_card_capacity: int
    capacity_scope: str
    policy_source: str
    evaluation_source: str
    validation: dict
    test: dict


@dataclass(frozen=True)
class ApprovedPolicy:
    model: FittedModel
    metadata: PolicyMetadata

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds fraud_probability and threshold_decision; the columns of each row stay on it."""
        require_columns(df, MODEL_FEATURES, "scoring input")
        scored = self.model.score(df).withColumnRenamed("score", "fraud_probability")
        return scored.withColumn("threshold_decision", F.col("fraud_probability") >= self.metadata.threshold)


def _need(holder: dict, path: str, wanted, what: str):
    """The value at a dotted path, which must be of the wanted type."""
    value = holder
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    if not isinstance(value, wanted) or isinstance(value, bool) or (wanted is str and not value.strip()):
        raise ValueError(f"{what}: {path} is missing or invalid")
    return value


def _capacity_evidence(metrics: dict, threshold: float, capacity: int, what: str) -> None:
    """Card-day metrics must be about this threshold and capacity, and within it."""
    if not math.isclose(_need(metrics, "threshold", int | float, what), threshold, rel_tol=0, abs_tol=1e-12):
        raise ValueError(f"{what}: the threshold is not the policy's")
    if _need(metrics, "daily_card_capacity", int, what) != capacity:
        raise ValueError(f"{what}: the capacity is not the policy's")
    if _need(metrics, "budget_exceeded_days", int, what) != 0:
        raise ValueError(f"{what}: the daily capacity is exceeded")
    if not 0 <= _need(metrics, "max_daily_card_alerts", int, what) <= capacity:
        raise ValueError(f"{what}: the largest number of daily alerts is out of bounds")


def check_approval(policy_path: str, evaluation_path: str) -> PolicyMetadata:
    """Cross-check the threshold policy and its final evaluation."""
    locked = read_locked_policy(policy_path)
    policy, evaluation = locked["document"], load_json_object(evaluation_path, "final evaluation")
    name, artifact, threshold, capacity = (locked[k] for k in ("model_name", "model_artifact", "threshold", "daily_card_capacity"))
    if Path(artifact).name != artifact:
        raise ValueError("the selected model artifact must be a plain name")
    if _need(policy, "operating_constraint.scope", str, "policy") != CAPACITY_SCOPE:
        raise ValueError(f"the capacity scope must be {CAPACITY_SCOPE}")
    chosen = policy.get("models", {}).get(name)
    if not isinstance(chosen, dict) or chosen.get("model_artifact") != artifact:
        raise ValueError("the policy lacks the metrics of the selected model")
    if not math.isclose(_need(chosen, "threshold", int | float, "selected model"), threshold, rel_tol=0, abs_tol=1e-12):
        raise ValueError("the selected threshold is not that of its validation metrics")
    _capacity_evidence(_need(chosen, "card_day_metrics", dict, "selected model"), threshold, capacity, "validation metrics")
    expected = {"schema_version": 1, "evaluation_data": "test", "selection_locked": True, "policy_source": Path(policy_path).name, "model_name": name, "model_artifact": artifact}
    for field, value in expected.items():
        if evaluation.get(field) != value or isinstance(evaluation.get(field), bool) != isinstance(value, bool):
            raise ValueError(f"final evaluation: {field} must be {value}")
    if not math.isclose(_need(evaluation, "threshold", int | float, "final evaluation"), threshold, rel_tol=0, abs_tol=1e-12):
        raise ValueError("final evaluation: the threshold is not the policy's")
    if _need(evaluation, "operating_constraint.daily_card_capacity", int, "final evaluation") != capacity or _need(evaluation, "operating_constraint.scope", str, "final evaluation") != CAPACITY_SCOPE:
        raise ValueError("final evaluation: the constraint is not the policy's")
    _capacity_evidence(_need(evaluation, "card_day_metrics", dict, "final evaluation"), threshold, capacity, "test metrics")
    part = lambda d: {"transaction_metrics": _need(d, "transaction_metrics", dict, "metrics"), "card_day_metrics": d["card_day_metrics"]}
    return PolicyMetadata(name, artifact, threshold, capacity, CAPACITY_SCOPE, Path(policy_path).name, Path(evaluation_path).name, part(chosen), part(evaluation))


def load_approved_policy(models_folder: str, policy_path: str, evaluation_path: str) -> ApprovedPolicy:
    """The policy with its model, after the cross-check."""
    metadata = check_approval(policy_path, evaluation_path)
    return ApprovedPolicy(load_model(f"{models_folder}/{metadata.model_artifact}"), metadata)


def validate_requests(df: DataFrame, *, max_rows: int | None = 100) -> DataFrame:
    """Scoring requests: exact columns, positive unique ids, ranges, finite numbers. Returns typed rows."""
    require_columns(df, [*IDENTITY, *MODEL_FEATURES], "scoring request", exact=True)
    kinds = dict(df.dtypes)
    if kinds["tx_datetime"] not in ("timestamp", "timestamp_ntz"):
        raise ValueError("tx_datetime must be a timestamp")
    if wrong := [c for c in (*IDENTITY, *MODEL_FEATURES) if c != "tx_datetime" and kinds[c] in ("string", "boolean", "binary")]:
        raise ValueError(f"not numeric: {', '.join(wrong)}")
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"a request must not hold more than {max_rows} rows")
    col = F.col
    amounts = [f for f in MODEL_FEATURES if INPUT_TYPES[f] == "double"]
    history = ("customer_previous_mean_amount", "amount_to_customer_previous_mean")
    require_none(df, {
        **{f"{c} must not be missing": col(c).isNull() for c in (*IDENTITY, *MODEL_FEATURES) if c not in history},
        **{f"{c} must be greater than zero": col(c) <= 0 for c in ("transaction_id", "customer_id", "terminal_id")},
        **{f"{c} must be finite and not negative": F.isnan(col(c).cast("double")) | (F.abs(col(c).cast("double")) == float("inf")) | (col(c) < 0) for c in amounts},
        **{f"{c} must be 0 or 1": ~col(c).isin(0, 1) for c in ("is_weekend", "is_night")},
        "transaction_hour must be within 0..23": ~col("transaction_hour").between(0, 23),
        "day_of_week must be within 0..6": ~col("day_of_week").between(0, 6),
        "history counts must not be negative": (col("customer_previous_transaction_count") < 0) | (col("terminal_previous_transaction_count") < 0),
    })
    if not df.groupBy("transaction_id").count().filter("count > 1").isEmpty():
        raise ValueError("transaction ids of a request must be unique")
    return df.select(*IDENTITY, *(col(f).cast(t).alias(f) for f, t in INPUT_TYPES.items()))


def validate_predictions(requests: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions must have a row per request, finite probabilities within 0..1 and boolean decisions."""
    require_columns(predictions, ["fraud_probability", "threshold_decision"], "predictions")
    kinds = {f.name: f.dataType for f in predictions.schema.fields}
    if not isinstance(kinds["threshold_decision"], T.BooleanType):
        raise ValueError("threshold_decision must be boolean")
    require_none(predictions, {"probabilities must be finite and within 0..1": F.col("fraud_probability").isNull() | F.isnan("fraud_probability") | ~F.col("fraud_probability").between(0, 1)})
    if requests.count() != predictions.count():
        raise ValueError("predictions and requests differ in their number of rows")
    return predictions


def score_requests(policy: ApprovedPolicy, df: DataFrame, *, max_rows: int | None = 100) -> DataFrame:
    """Identity, probability and decision of every request. Daily capacity is not enforced here."""
    requests = validate_requests(df, max_rows=max_rows)
    predictions = validate_predictions(requests, policy.predict(requests))
    return predictions.select(*IDENTITY, "fraud_probability", "threshold_decision")
