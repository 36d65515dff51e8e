"""A registry of approved policies in a folder of any store: numbered versions, tags, and an alias that is set last."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import require_text
from ..sources import store
from ..sources.files import load_json_object
from ..sources.publish import write_json
from .policy import ApprovedPolicy, load_approved_policy

TAGS = ("approval_status", "source_revision", "threshold", "daily_card_capacity")


@dataclass(frozen=True)
class RegisteredVersion:
    name: str
    version: int
    folder: str
    tags: dict[str, str]


def same_predictions(a: ApprovedPolicy, b: ApprovedPolicy, example: DataFrame) -> bool:
    """Whether two policies predict alike on the example rows."""
    example = example.withColumn("_row", F.monotonically_increasing_id()).persist()
    try:
        left = a.predict(example).select("_row", F.col("fraud_probability").alias("p"), F.col("threshold_decision").alias("d"))
        right = b.predict(example).select("_row", F.col("fraud_probability").alias("q"), F.col("threshold_decision").alias("e"))
        return left.join(right, "_row", "full_outer").filter(~F.coalesce((F.abs(F.col("p") - F.col("q")) <= 1e-12) & (F.col("d") == F.col("e")), F.lit(False))).isEmpty()
    finally:
        example.unpersist()


def publish_policy(root: str, name: str, *, models_folder: str, policy_path: str, evaluation_path: str, source_revision: str, example: DataFrame, alias: str = "champion") -> RegisteredVersion:
    """Copy a policy's files, verify the copy, register the version, verify again, tag it, then set the alias."""
    require_text(name, "registry name")
    revision, alias = require_text(source_revision, "source revision"), require_text(alias, "alias")
    source = load_approved_policy(models_folder, policy_path, evaluation_path)
    base = f"{root}/{name}"
    version = 1 + max((int(n) for n in store.children(base) if n.isdigit()), default=0)
    staging, place = f"{base}/.staging-{uuid.uuid4().hex}", f"{base}/{version}"
    try:
        store.copy(f"{models_folder}/{source.metadata.model_artifact}", f"{staging}/models/{source.metadata.model_artifact}")
        for path in (policy_path, evaluation_path):
            store.copy(path, f"{staging}/{Path(path).name}")
        if not same_predictions(source, _open(staging, source), example):
            raise ValueError("the copied policy predicts differently")
        store.move(staging, place)
    finally:
        store.delete(staging)
    if not same_predictions(source, _open(place, source), example):
        raise ValueError("the registered policy predicts differently")
    tags = {
        "approval_status": "approved",
        "source_revision": revision,
        "threshold": repr(source.metadata.threshold),
        "daily_card_capacity": str(source.metadata.daily_card_capacity),
        "policy": Path(policy_path).name,
        "evaluation": Path(evaluation_path).name,
    }
    write_json(f"{place}/tags.json", tags)
    write_json(f"{base}/{alias}.json", {"version": version})
    return RegisteredVersion(name, version, place, tags)


def _open(folder: str, like: ApprovedPolicy) -> ApprovedPolicy:
    return load_approved_policy(f"{folder}/models", f"{folder}/{like.metadata.policy_source}", f"{folder}/{like.metadata.evaluation_source}")


def resolve(root: str, name: str, alias: str = "champion") -> RegisteredVersion:
    """The version that an alias stands for; its tags must say that it is approved."""
    base = f"{root}/{require_text(name, 'registry name')}"
    version = load_json_object(f"{base}/{require_text(alias, 'alias')}.json", "registry alias").get("version")
    if isinstance(version, bool) or not isinstance(version, int) or version < 1:
        raise ValueError("the alias does not name a version")
    tags = load_json_object(f"{base}/{version}/tags.json", "version tags")
    for tag in TAGS:
        if not isinstance(tags.get(tag), str) or not tags[tag].strip():
            raise ValueError(f"version {version} lacks the tag {tag}")
    if tags["approval_status"] != "approved":
        raise ValueError(f"version {version} is not approved")
    return RegisteredVersion(name, version, f"{base}/{version}", tags)


def load_registered(root: str, name: str, alias: str = "champion") -> ApprovedPolicy:
    """The approved policy behind an alias, pinned to its version."""
    found = resolve(root, name, alias)
    policy = load_approved_policy(f"{found.folder}/models", f"{found.folder}/{found.tags['policy']}", f"{found.folder}/{found.tags['evaluation']}")
    if float(found.tags["threshold"]) != policy.metadata.threshold or int(found.tags["daily_card_capacity"]) != policy.metadata.daily_card_capacity:
        raise ValueError("the tags of the version contradict its policy")
    return policy
