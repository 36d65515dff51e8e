"""Command line: ``python -m riskweave.cli COMMAND``."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime

from .contracts import require_aware
from .session import create_session


def moment(text: str) -> datetime:
    """An ISO timestamp with an offset."""
    try:
        return require_aware(datetime.fromisoformat(text), "the timestamp")
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="riskweave")
    commands = p.add_subparsers(dest="command", required=True)

    run = commands.add_parser("run", help="daily files to Bronze, Silver and Gold")
    run.add_argument("--source", required=True)
    run.add_argument("--root", required=True)
    run.add_argument("--ingested-at", type=moment)
    run.add_argument("--incremental", action="store_true", help="continue Gold by day")

    replay = commands.add_parser("replay-transactions", help="Bronze rows as messages")
    replay.add_argument("--bronze", required=True)
    replay.add_argument("--servers")
    replay.add_argument("--topic", default="transactions")
    replay.add_argument("--message-folder", help="write Kafka-shaped files instead of sending")
    replay.add_argument("--events-per-second", type=float, default=100.0)
    replay.add_argument("--max-events", type=int)
    replay.add_argument("--produced-at", type=moment, required=True)

    analytics = commands.add_parser("build-analytics", help="views, marts and data tests")
    analytics.add_argument("--silver", required=True)
    analytics.add_argument("--gold", required=True)
    analytics.add_argument("--database")

    dataset = commands.add_parser("build-ml-dataset", help="chronological model dataset")
    dataset.add_argument("--gold", required=True)
    dataset.add_argument("--output", required=True)
    dataset.add_argument("--manifest", required=True)
    dataset.add_argument("--train-end", type=moment, required=True)
    dataset.add_argument("--validation-end", type=moment, required=True)

    baselines = commands.add_parser("train-baselines", help="baseline models")
    baselines.add_argument("--dataset", required=True)
    baselines.add_argument("--output", required=True)
    baselines.add_argument("--threshold", type=float, default=0.5)

    tune = commands.add_parser("tune-hyperparameters", help="search on prequential folds")
    tune.add_argument("--dataset", required=True)
    tune.add_argument("--output", required=True)
    tune.add_argument("--logistic-candidates", type=int, default=12)
    tune.add_argument("--boosted-candidates", type=int, default=20)
    tune.add_argument("--folds", type=int, default=3)
    tune.add_argument("--assessment-days", type=int, default=14)
    tune.add_argument("--gap-days", type=int, default=7)
    tune.add_argument("--k", type=int, default=100)
    tune.add_argument("--seed", type=int, default=42)
    tune.add_argument("--parallelism", type=int, default=4, help="candidates that are fitted at a time")

    thresholds = commands.add_parser("optimize-thresholds", help="thresholds under a daily capacity")
    thresholds.add_argument("--dataset", required=True)
    thresholds.add_argument("--models", required=True)
    thresholds.add_argument("--policy", required=True)
    thresholds.add_argument("--capacity", type=int, default=100)
    thresholds.add_argument("--names", nargs="+", default=["logistic_regression", "boosted_trees"])

    final = commands.add_parser("evaluate-final-policy", help="the locked policy on the test split")
    final.add_argument("--dataset", required=True)
    final.add_argument("--models", required=True)
    final.add_argument("--policy", required=True)
    final.add_argument("--output", required=True)

    register = commands.add_parser("register-policy", help="publish an approved policy in a registry folder")
    for name in ("registry", "name", "models", "policy", "evaluation", "source-revision", "dataset"):
        register.add_argument(f"--{name}", required=True)
    register.add_argument("--alias", default="champion")
    return p


def dispatch(spark, a: argparse.Namespace) -> object:
    """Run one parsed command."""
    from .ml import dataset, publish, registry
    from .operators.gold_days import open_table
    from .plans.checks import violation_counts
    from .plans.daily import run_daily
    from .plans.marts import build_catalog, build_marts
    from .schemas import MODEL_FEATURES
    from .sources.files import model_example, read_bronze, read_split
    from .streaming.replay import file_writer, kafka_writer, replay

    if a.command == "run":
        return run_daily(spark, a.source, a.root, a.ingested_at, incremental=a.incremental)
    if a.command == "replay-transactions":
        write = file_writer(a.message_folder) if a.message_folder else kafka_writer(a.servers or "", a.topic)
        return replay(read_bronze(spark, a.bronze), write, produced_at=a.produced_at, topic=a.topic, events_per_second=a.events_per_second, max_events=a.max_events)
    if a.command == "build-analytics":
        frames = build_marts(spark, build_catalog(spark, a.silver, a.gold), database=a.database, materialize=a.database is not None)
        broken = {r["check"]: r["violations"] for r in violation_counts(frames).filter("violations > 0").collect()}
        if broken:
            raise ValueError(f"data tests failed: {broken}")
        return sorted(frames)
    if a.command == "build-ml-dataset":
        df = dataset.build_dataset(open_table(spark, a.gold, "transaction_features"))
        return dataset.write_dataset(df, a.output, a.train_end, a.validation_end, a.manifest)
    if a.command == "register-policy":
        example = model_example(spark, f"{a.dataset}/split=train", list(MODEL_FEATURES))
        return registry.publish_policy(a.registry, a.name, models_folder=a.models, policy_path=a.policy, evaluation_path=a.evaluation, source_revision=a.source_revision, example=example, alias=a.alias)
    split = lambda name: read_split(spark, a.dataset, name)
    if a.command == "train-baselines":
        return publish.publish_baselines(split("train"), split("validation"), split("test"), a.output, threshold=a.threshold)
    if a.command == "tune-hyperparameters":
        candidates = {"logistic_regression": a.logistic_candidates, "boosted_trees": a.boosted_candidates}
        return publish.publish_tuned(split("train"), a.output, candidates=candidates, folds=a.folds, assessment_days=a.assessment_days, gap_days=a.gap_days, k=a.k, seed=a.seed, parallelism=a.parallelism)
    if a.command == "optimize-thresholds":
        return publish.publish_thresholds(split("validation"), a.models, a.names, a.policy, capacity=a.capacity)
    return publish.publish_final_evaluation(split("test"), a.models, a.policy, a.output)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        print(dispatch(create_session(f"riskweave {args.command}"), args))
    except (FileNotFoundError, RuntimeError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
