"""Training, tuning, threshold choice and final evaluation, each published with a manifest that comes last."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame

from ..contracts import require_positive
from ..schemas import MODEL_FEATURES, MODEL_TARGET
from ..sources.files import load_json_object
from ..sources.publish import write_json
from .metrics import BinaryMetrics, evaluate_binary
from .models import BASELINES, FittedModel, fit_model, load_model
from .thresholds import CAPACITY_SCOPE, PolicyCandidate, capacity_threshold, evaluate_card_days, select_policy
from .tuning import prequential_folds, search


@dataclass(frozen=True)
class Published:
    manifest: str
    models: dict[str, str]


def publish_baselines(train: DataFrame, validation: DataFrame, test: DataFrame, folder: str, *, threshold: float = 0.5, models: dict[str, dict] | None = None) -> Published:
    """Fit the baselines on train and measure them on validation and test."""
    metrics, places = {}, {}
    for kind, parameters in (models or BASELINES).items():
        model = fit_model(kind, parameters, train)
        model.save(f"{folder}/{kind}")
        places[kind] = f"{folder}/{kind}"
        metrics[kind] = {name: evaluate_binary(model.score(part), threshold).as_dict() for name, part in (("validation", validation), ("test", test))}
    manifest = write_json(f"{folder}/metrics.json", {"schema_version": 1, "threshold": threshold, "features": list(MODEL_FEATURES), "target": MODEL_TARGET, "models": metrics})
    return Published(manifest, places)


def publish_tuned(train: DataFrame, folder: str, *, candidates: dict[str, int], folds: int = 3, assessment_days: int = 14, gap_days: int = 7, k: int = 100, seed: int = 42, parallelism: int = 4) -> Published:
    """Search each model's space on prequential folds of train, refit the winners on all of it."""
    plan = prequential_folds(train, folds=folds, assessment_days=assessment_days, gap_days=gap_days)
    found, places = {}, {}
    for kind, n in candidates.items():
        best, results = search(train, kind, plan, fit_model, n_candidates=n, k=k, seed=seed, parallelism=parallelism)
        fit_model(kind, best.parameters, train).save(f"{folder}/{kind}")
        places[kind] = f"{folder}/{kind}"
        found[kind] = {
            "best_parameters": best.parameters,
            "mean_average_precision": best.mean("average_precision"),
            "mean_roc_auc": best.mean("roc_auc"),
            "mean_card_precision_at_k": best.mean("card_precision_at_k"),
            "candidates": [{"parameters": r.parameters, "mean_average_precision": r.mean("average_precision"), "mean_card_precision_at_k": r.mean("card_precision_at_k")} for r in results],
        }
    manifest = write_json(f"{folder}/tuning.json", {"schema_version": 1, "folds": folds, "assessment_days": assessment_days, "gap_days": gap_days, "k": k, "seed": seed, "models": found})
    return Published(manifest, places)


def publish_thresholds(validation: DataFrame, models_folder: str, names: list[str], path: str, *, capacity: int) -> str:
    """Choose each model's threshold under the capacity on validation data, and the policy among them."""
    require_positive(capacity, "capacity")
    described, candidates = {}, []
    for name in names:
        scored = load_model(f"{models_folder}/{name}").score(validation).persist()
        try:
            cards = capacity_threshold(scored, capacity)
            binary = evaluate_binary(scored, cards.threshold)
        finally:
            scored.unpersist()
        candidates.append(PolicyCandidate(name, binary.average_precision, cards))
        described[name] = {"model_artifact": name, "threshold": cards.threshold, "transaction_metrics": binary.as_dict(), "card_day_metrics": cards.as_dict()}
    chosen = select_policy(candidates)
    return write_json(path, {
        "schema_version": 1,
        "selection_data": "validation",
        "test_evaluation": {"performed": False},
        "operating_constraint": {"daily_card_capacity": capacity, "scope": CAPACITY_SCOPE},
        "selected_policy": {"model_name": chosen.model_name, "model_artifact": chosen.model_name, "threshold": chosen.card_days.threshold},
        "models": described,
    })


def publish_final_evaluation(test: DataFrame, models_folder: str, policy_path: str, path: str) -> str:
    """Measure the locked policy on the test rows, without choosing anything again."""
    policy = read_locked_policy(policy_path)
    scored = load_model(f"{models_folder}/{policy['model_artifact']}").score(test).persist()
    try:
        binary = evaluate_binary(scored, policy["threshold"])
        cards = evaluate_card_days(scored, policy["threshold"], policy["daily_card_capacity"])
    finally:
        scored.unpersist()
    return write_json(path, {
        "schema_version": 1,
        "evaluation_data": "test",
        "selection_locked": True,
        "policy_source": Path(policy_path).name,
        "model_name": policy["model_name"],
        "model_artifact": policy["model_artifact"],
        "threshold": policy["threshold"],
        "operating_constraint": {"daily_card_capacity": policy["daily_card_capacity"], "scope": CAPACITY_SCOPE},
        "transaction_metrics": binary.as_dict(),
        "card_day_metrics": cards.as_dict(),
    })


def read_locked_policy(path: str) -> dict:
    """Model, artifact, threshold and capacity of a threshold policy that no test result has influenced."""
    policy = load_json_object(path, "threshold policy")
    if policy.get("schema_version") != 1 or policy.get("selection_data") != "validation" or policy.get("test_evaluation") != {"performed": False}:
        raise ValueError("the threshold policy must have version 1 and be selected on validation data, before any test")
    chosen, constraint = policy.get("selected_policy"), policy.get("operating_constraint")
    if not isinstance(chosen, dict) or not isinstance(constraint, dict):
        raise ValueError("the threshold policy lacks its selection or constraint")
    threshold, capacity = chosen.get("threshold"), constraint.get("daily_card_capacity")
    if isinstance(threshold, bool) or not isinstance(threshold, int | float) or not 0 <= threshold <= 1:
        raise ValueError("the policy's threshold must be within 0..1")
    if isinstance(capacity, bool) or not isinstance(capacity, int) or capacity <= 0:
        raise ValueError("the policy's capacity must be a positive integer")
    for name in ("model_name", "model_artifact"):
        if not isinstance(chosen.get(name), str) or not chosen[name].strip():
            raise ValueError(f"the policy's {name} must not be blank")
    return {"model_name": chosen["model_name"], "model_artifact": chosen["model_artifact"], "threshold": float(threshold), "daily_card_capacity": capacity, "document": policy}


__all__ = ["BinaryMetrics", "FittedModel", "Published", "publish_baselines", "publish_final_evaluation", "publish_thresholds", "publish_tuned", "read_locked_policy"]
