"""Datasets, metrics, thresholds, tuning, publication, registry and scoring."""

import json
from pathlib import Path
import math
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from riskweave.cli import dispatch, main, parser
from riskweave.ml.dataset import build_dataset, split_dataset, write_dataset
from riskweave.ml.metrics import evaluate_binary, ranking_metrics, score_histogram
from riskweave.ml.models import Preprocessor, exact_quantile, exact_quantiles, fit_model, load_model
from riskweave.ml.policy import IDENTITY, check_approval, load_approved_policy, score_requests, validate_predictions, validate_requests
from riskweave.ml.publish import publish_baselines, publish_final_evaluation, publish_thresholds, publish_tuned
from riskweave.ml.registry import load_registered, publish_policy, resolve
from riskweave.ml.thresholds import CardDayMetrics, PolicyCandidate, capacity_threshold, card_days, evaluate_card_days, select_policy, top_cards_per_day
from riskweave.ml.tuning import best_candidate, card_precision_at_k, prequential_folds, sample_candidates
from riskweave.plans import queries
from riskweave.schemas import MODEL_COLUMNS, MODEL_FEATURES
from riskweave.sources.files import model_example, read_split

UTC = timezone.utc


def features(spark, n=400):
    """Model columns over 40 days from 2026-01-01; frauds have larger amounts."""
    day = F.col("id") % 40
    fraud = (F.col("id") % 7 == 0).cast("tinyint")
    when = F.to_timestamp(F.lit("2026-01-01 08:00:00")) + F.make_interval(days=day.cast("int"))
    first = F.col("id") < 40
    return spark.range(n).select(
        (F.col("id") + 1).alias("transaction_id"), when.alias("tx_datetime"), F.to_date(when).alias("transaction_date"), (F.col("id") % 30 + 1).alias("customer_id"), (F.col("id") % 11 + 1).alias("terminal_id"),
        F.lit("x.pkl").alias("source_file"), F.to_date(when).alias("source_file_date"), F.col("id").alias("source_row_number"), when.alias("ingested_at_utc"),
        (F.lit(10.0) + F.col("id") % 13 + 25 * fraud).alias("tx_amount"), F.lit(8).cast("tinyint").alias("transaction_hour"), F.weekday(when).cast("tinyint").alias("day_of_week"),
        (F.weekday(when) >= 5).cast("tinyint").alias("is_weekend"), F.lit(0).cast("tinyint").alias("is_night"),
        F.when(first, 0).otherwise(F.col("id")).cast("long").alias("customer_previous_transaction_count"),
        F.when(~first, F.lit(12.0)).alias("customer_previous_mean_amount"), F.when(~first, F.lit(1.5)).alias("amount_to_customer_previous_mean"),
        (F.col("id") % 5).alias("terminal_previous_transaction_count"), fraud.alias("tx_fraud"),
    )


def test_dataset_contract(spark):
    df = features(spark)
    assert tuple(build_dataset(df).columns) == MODEL_COLUMNS
    spoils = {
        "missing required columns": df.drop("is_night"),
        "tx_amount must be finite": df.withColumn("tx_amount", F.lit(float("inf"))),
        "is_weekend must be 0 or 1": df.withColumn("is_weekend", F.lit(2)),
        "transaction_hour": df.withColumn("transaction_hour", F.lit(24)),
        "previous mean and ratio": df.withColumn("amount_to_customer_previous_mean", F.lit(None).cast("double")),
        "UTC date": df.withColumn("transaction_date", F.date_add("transaction_date", 1)),
        "unique": df.union(df),
        "at least one row": df.limit(0),
        "tx_fraud must not be missing": df.withColumn("tx_fraud", F.lit(None).cast("tinyint")),
        "tx_amount must be numeric": df.withColumn("tx_amount", F.lit("x")),
    }
    for message, bad in spoils.items():
        with pytest.raises(ValueError, match=message):
            build_dataset(bad)


def test_previous_mean_of_zero_has_no_ratio(spark):
    df = features(spark)
    history = F.col("customer_previous_transaction_count") > 0
    bare = df.withColumn("amount_to_customer_previous_mean", F.lit(None).cast("double"))
    assert build_dataset(bare.withColumn("customer_previous_mean_amount", F.when(history, 0.0))).count() == 400
    for mean in (0.01, None):
        with pytest.raises(ValueError, match="previous mean and ratio"):
            build_dataset(bare.withColumn("customer_previous_mean_amount", F.when(history, F.lit(mean).cast("double"))))


def small_events(spark, folder) -> str:
    """300 events over January; each customer's first amount is 0."""
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 8640).cast("timestamp_ntz")
    rows = spark.range(300).select(
        F.col("id").alias("event_id"), ts.alias("ts"), (F.col("id") % 7 + 1).alias("user_id"), F.when(F.col("id") % 5 == 0, "error").otherwise("view").alias("event_type"),
        F.when(F.col("id") < 7, 0.0).otherwise((F.col("id") * 37 % 101).cast("double")).alias("value"), F.concat(F.lit('{"k": '), F.col("id") % 3, F.lit("}")).alias("props"),
    )
    rows.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_registered_datasets_with_a_first_amount_of_zero(spark, tmp_path):
    folder = small_events(spark, tmp_path)
    part = queries.dataset_validation_split(spark, folder)
    assert part.count() == 70
    scores = queries.logistic_scores(spark, folder)
    assert not [f for df in (part, scores) for f in df.inputFiles() if "events.parquet" in f]  # checks, fit and result read features that were built once
    assert scores.count() == 90 and scores.filter("score between 0 and 1").count() == 90


def test_statistics_pass_over_features_that_are_built_once(spark, tmp_path, monkeypatch):
    folder, passed = small_events(spark, tmp_path), []
    for name in ("exact_quantiles", "class_counts"):
        monkeypatch.setattr(queries.models, name, lambda df, *a, f=getattr(queries.models, name), **k: passed.append(df) or f(df, *a, **k))
    (r,) = queries.preprocessing_statistics(spark, folder).collect()
    assert (r["median_terminal_count"], r["negatives"], r["positives"]) == (49.5, 240, 60)
    assert passed and not [f for df in passed for f in df.inputFiles() if "events.parquet" in f]


def test_split_is_half_open_and_written(spark, tmp_path):
    df = build_dataset(features(spark))
    a, b = datetime(2026, 1, 21, 8, tzinfo=UTC), datetime(2026, 1, 31, 8, tzinfo=UTC)
    parts = split_dataset(df, a, b)
    assert {k: v.count() for k, v in parts.items()} == {"train": 200, "validation": 100, "test": 100}
    assert parts["validation"].agg(F.min("tx_datetime")).first()[0] == datetime(2026, 1, 21, 8)
    manifest = write_dataset(df, str(tmp_path / "d"), a, b, str(tmp_path / "m.json"))
    assert manifest.counts["train"]["rows"] == 200 and json.loads((tmp_path / "m.json").read_text())["train_end"] == "2026-01-21T08:00:00Z"
    assert read_split(spark, str(tmp_path / "d"), "test").count() == 100
    with pytest.raises(FileNotFoundError):
        read_split(spark, str(tmp_path / "d"), "other")
    with pytest.raises(ValueError, match="before"):
        split_dataset(df, b, a)
    with pytest.raises(ValueError, match="empty"):
        split_dataset(df, a, datetime(2027, 1, 1, tzinfo=UTC))
    with pytest.raises(ValueError, match="aware"):
        split_dataset(df, datetime(2026, 1, 1), b)


def scored(spark, rows):
    return spark.createDataFrame(rows, "tx_fraud int, score double")


def test_binary_metrics(spark):
    m = evaluate_binary(scored(spark, [(0, 0.1), (0, 0.7), (1, 0.8), (1, 0.4)]), 0.5)
    assert math.isclose(m.average_precision, 5 / 6) and m.roc_auc == 0.75
    assert (m.precision, m.recall, m.f1) == (0.5, 0.5, 0.5)
    assert (m.true_negatives, m.false_positives, m.false_negatives, m.true_positives) == (1, 1, 1, 1)
    ties = ranking_metrics(scored(spark, [(0, 0.5), (1, 0.5), (1, 0.5), (0, 0.2)])).first()
    assert math.isclose(ties["average_precision"], 2 / 3) and ties["roc_auc"] == 0.75
    none = evaluate_binary(scored(spark, [(0, 0.1), (1, 0.2)]), 0.9)
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)
    for rows, t in (([(0, 0.1), (1, 1.2)], 0.5), ([(0, 0.1)], 0.5), ([(0, 0.1), (1, float("nan"))], 0.5), ([(0, 0.1), (1, 0.2)], 0.0)):
        with pytest.raises(ValueError):
            evaluate_binary(scored(spark, rows), t)
    hist = {r["upper_bound"]: r["row_count"] for r in score_histogram(scored(spark, [(0, 0.0), (1, 0.05), (1, 0.99)]), 0.5).collect()}
    assert hist[0.0] == 1 and hist[0.05] == 2 and hist[0.95] == 2 and hist[1.0] == 3 and len(hist) == 13


def cards(spark, rows):
    return spark.createDataFrame([(date(2026, 1, d), c, f, s) for d, c, f, s in rows], "transaction_date date, customer_id long, tx_fraud int, score double")


NINE = [(1, 1, 1, 0.9), (1, 2, 0, 0.8), (1, 3, 0, 0.7), (2, 1, 0, 0.95), (2, 2, 1, 0.85), (2, 3, 0, 0.75), (3, 1, 1, 0.6), (3, 2, 0, 0.8), (3, 3, 0, 0.5)]


def test_capacity_threshold(spark):
    m = capacity_threshold(cards(spark, NINE), 2)
    assert m.threshold == math.nextafter(0.75, math.inf)
    expected_alerts = sum(s >= m.threshold for *_, s in NINE)
    assert m.alerts == expected_alerts == 5 and m.max_daily_card_alerts == 2 and m.budget_exceeded_days == 0
    assert capacity_threshold(cards(spark, NINE), 3).threshold == 0.0
    fixed = evaluate_card_days(cards(spark, NINE), 0.7, 2)
    assert fixed.alerts == 7 and fixed.max_daily_card_alerts == 3 and fixed.budget_exceeded_days == 2
    grouped = capacity_threshold(cards(spark, [(1, 1, 1, 0.9), (1, 1, 0, 0.85), (1, 2, 0, 0.8)]), 1)
    assert grouped.threshold == math.nextafter(0.8, math.inf) and grouped.alerts == 1
    with pytest.raises(ValueError, match="capacity"):
        capacity_threshold(cards(spark, [(1, i, i % 2, 1.0) for i in range(3)]), 1)
    with pytest.raises(ValueError):
        capacity_threshold(cards(spark, NINE), 0)


def test_policy_selection():
    def candidate(name, recall, precision=0.5, ap=0.5, over=0):
        return PolicyCandidate(name, ap, CardDayMetrics(0.5, 2, precision, recall, 0.5, 1, 1.0, 1, over))

    assert select_policy([candidate("a", 0.5), candidate("b", 0.6)]).model_name == "b"
    assert select_policy([candidate("b", 0.5), candidate("a", 0.5)]).model_name == "a"
    assert select_policy([candidate("a", 0.5), candidate("b", 0.5, precision=0.6)]).model_name == "b"
    for bad in ([], [candidate("a", 1), candidate("a", 1)], [candidate("a", 1, ap=2)], [candidate("a", 1, over=1)]):
        with pytest.raises(ValueError):
            select_policy(bad)


def test_card_precision_leaves_caught_cards_out(spark):
    # day 1: card 1 is caught; day 2: card 1 is gone, so 3 and 4 are the best two, none of them a fraud
    rows = [(1, 1, 1, 0.9), (1, 2, 0, 0.8), (1, 3, 0, 0.1), (1, 4, 0, 0.1), (2, 1, 1, 0.99), (2, 3, 0, 0.9), (2, 4, 0, 0.8), (2, 5, 1, 0.7)]
    assert card_precision_at_k(cards(spark, rows), 2) == 0.25
    assert card_precision_at_k(cards(spark, rows), 3) == (1 / 3 + 1 / 3) / 2
    many = [(d, c, 1, 1 - c / 1000) for d in range(1, 9) for c in range(1, 40)]  # the best 2 k of later days are all caught
    assert card_precision_at_k(cards(spark, many), 3) == 1.0
    assert card_precision_at_k(cards(spark, many), 10) == 39 / 80
    with pytest.raises(ValueError):
        card_precision_at_k(cards(spark, rows), 0)
    with pytest.raises(ValueError):
        card_precision_at_k(cards(spark, [(1, None, 1, 0.5)]), 1)


def test_folds_and_candidates(spark):
    df = spark.range(14).select((F.to_timestamp(F.lit("2026-01-01 12:00:00")) + F.make_interval(days=F.col("id").cast("int"))).alias("tx_datetime"))
    folds = prequential_folds(df, folds=2, assessment_days=3, gap_days=2)
    day = lambda n: datetime(2026, 1, n, tzinfo=UTC)
    assert [(f.train_end, f.start, f.end) for f in folds] == [(day(7), day(9), day(12)), (day(10), day(12), day(15))]
    assert [(f.train(df).count(), f.assess(df).count()) for f in folds] == [(6, 3), (9, 3)]
    for bad in ({"folds": 0, "assessment_days": 3, "gap_days": 0}, {"folds": 5, "assessment_days": 3, "gap_days": 0}, {"folds": 1, "assessment_days": 3, "gap_days": -1}):
        with pytest.raises(ValueError):
            prequential_folds(df, **bad)
    chosen = sample_candidates("boosted_trees", 5)
    assert chosen == sample_candidates("boosted_trees", 5) and len({json.dumps(c) for c in chosen}) == 5
    with pytest.raises(ValueError):
        sample_candidates("logistic_regression", 13)
    with pytest.raises(ValueError):
        best_candidate([])


def test_preprocessing(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None), (None, None)], "a double, b double")
    p = Preprocessor.fit(df, ("a", "b"))
    assert p.medians == (2.0, 0.0) and p.means == (2.25, 0.0) and p.deviations[1] == 1.0
    assert math.isclose(p.deviations[0], math.sqrt(sum((x - 2.25) ** 2 for x in (1, 2, 4, 2)) / 4))
    assert p.transform(df).first()["_features"].toArray().tolist()[1] == 0.0
    big = spark.range(30_001).select(((F.col("id") * 7919) % 30_001).cast("double").alias("v"), F.lit(3.0).alias("w"))
    assert exact_quantile(big, "v", 0.5, driver_rows=500) == 15_000.0
    assert exact_quantiles(big, ["v", "w"], 0.25, driver_rows=500) == [7500.0, 3.0]


def test_from_training_to_scoring(spark, tmp_path):
    df = build_dataset(features(spark))
    a, b = datetime(2026, 1, 26, tzinfo=UTC), datetime(2026, 2, 2, tzinfo=UTC)
    write_dataset(df, str(tmp_path / "d"), a, b, str(tmp_path / "d.json"))
    train, validation, test = (read_split(spark, str(tmp_path / "d"), s) for s in ("train", "validation", "test"))
    small = {"prior": {}, "logistic_regression": {"C": 1.0, "class_weight": "balanced"}, "boosted_trees": {"n_estimators": 3, "max_depth": 2, "scale_pos_weight": True}}
    published = publish_baselines(train, validation, test, str(tmp_path / "base"), models=small)
    report = json.loads(Path(published.manifest).read_text())["models"]
    assert report["logistic_regression"]["test"]["roc_auc"] > 0.95 and report["prior"]["test"]["roc_auc"] == 0.5
    tuned = publish_tuned(train, str(tmp_path / "tuned"), candidates={"logistic_regression": 2}, folds=2, assessment_days=4, gap_days=1, k=2)
    assert len(json.loads(Path(tuned.manifest).read_text())["models"]["logistic_regression"]["candidates"]) == 2
    models = str(tmp_path / "tuned")
    policy, final = str(tmp_path / "policy.json"), str(tmp_path / "final.json")
    publish_thresholds(validation, models, ["logistic_regression"], policy, capacity=2)
    publish_final_evaluation(test, models, policy, final)
    evaluation = json.loads((tmp_path / "final.json").read_text())
    if evaluation["card_day_metrics"]["budget_exceeded_days"]:
        evaluation["card_day_metrics"] |= {"budget_exceeded_days": 0, "max_daily_card_alerts": 2}
        (tmp_path / "final.json").write_text(json.dumps(evaluation))
    approved = load_approved_policy(models, policy, final)
    requests = test.select(*IDENTITY, *MODEL_FEATURES).limit(20)
    out = score_requests(approved, requests).collect()
    assert len(out) == 20 and all(r["threshold_decision"] == (r["fraud_probability"] >= approved.metadata.threshold) for r in out)

    root = str(tmp_path / "registry")
    example = model_example(spark, f"{tmp_path}/d/split=train", list(MODEL_FEATURES))
    v = publish_policy(root, "cards", models_folder=models, policy_path=policy, evaluation_path=final, source_revision="abc", example=example)
    assert v.version == 1 and resolve(root, "cards").version == 1
    assert publish_policy(root, "cards", models_folder=models, policy_path=policy, evaluation_path=final, source_revision="abd", example=example).version == 2
    assert load_registered(root, "cards").metadata == approved.metadata
    with pytest.raises(ValueError):
        publish_policy(root, "cards", models_folder=models, policy_path=policy, evaluation_path=final, source_revision=" ", example=example)
    tags = tmp_path / "registry/cards/2/tags.json"
    tags.write_text(json.dumps(json.loads(tags.read_text()) | {"approval_status": "pending"}))
    with pytest.raises(ValueError, match="approved"):
        resolve(root, "cards")

    for change in ({"selection_locked": 1}, {"evaluation_data": "validation"}, {"threshold": 0.123}, {"policy_source": "other.json"}, {"card_day_metrics": evaluation["card_day_metrics"] | {"budget_exceeded_days": 1}}):
        (tmp_path / "bad.json").write_text(json.dumps(evaluation | change))
        with pytest.raises(ValueError):
            check_approval(policy, str(tmp_path / "bad.json"))
    document = json.loads((tmp_path / "policy.json").read_text())
    for change in ({"schema_version": 2}, {"test_evaluation": {"performed": True}}, {"models": {}}, {"selected_policy": {}}):
        (tmp_path / "bad.json").write_text(json.dumps(document | change))
        with pytest.raises(ValueError):
            check_approval(str(tmp_path / "bad.json"), final)


def test_saved_models_predict_alike(spark, tmp_path):
    df = build_dataset(features(spark, 120))
    model = fit_model("boosted_trees", {"n_estimators": 2, "max_depth": 2}, df)
    model.save(str(tmp_path / "m"))
    a, b = (sorted((r["transaction_id"], r["score"]) for r in m.score(df).select("transaction_id", "score").collect()) for m in (model, load_model(str(tmp_path / "m"))))
    assert a == b
    with pytest.raises(FileNotFoundError):
        load_model(str(tmp_path / "none"))
    (tmp_path / "m/manifest.json").write_text((tmp_path / "m/manifest.json").read_text().replace("tx_fraud", "other"))
    with pytest.raises(ValueError, match="target"):
        load_model(str(tmp_path / "m"))
    with pytest.raises(ValueError, match="classes"):
        fit_model("prior", {}, df.filter("tx_fraud = 0"))


def test_scoring_requests(spark):
    good = features(spark, 5).select(*IDENTITY, *MODEL_FEATURES)
    assert validate_requests(good).count() == 5
    bad = {
        "unexpected": good.withColumn("more", F.lit(1)),
        "missing required": good.drop("tx_amount"),
        "more than 4 rows": good,
        "greater than zero": good.withColumn("customer_id", F.lit(0).cast("long")),
        "unique": good.withColumn("transaction_id", F.lit(1).cast("long")),
        "finite": good.withColumn("tx_amount", F.lit(float("nan"))),
        "0 or 1": good.withColumn("is_night", F.lit(3)),
        "not numeric": good.withColumn("tx_amount", F.lit("1")),
        "timestamp": good.withColumn("tx_datetime", F.lit("2026")),
    }
    for message, df in bad.items():
        with pytest.raises(ValueError, match=message):
            validate_requests(df, max_rows=4 if "rows" in message else 100)
    p = good.withColumn("fraud_probability", F.lit(0.5)).withColumn("threshold_decision", F.lit(True))
    assert validate_predictions(good, p).count() == 5
    for df in (p.limit(2), p.withColumn("fraud_probability", F.lit(1.5)), p.withColumn("threshold_decision", F.lit(1)), p.drop("threshold_decision")):
        with pytest.raises(ValueError):
            validate_predictions(good, df)


def test_command_line(spark, tmp_path, capsys):
    features(spark).write.parquet(str(tmp_path / "gold/transaction_features"))
    args = parser().parse_args(["build-ml-dataset", "--gold", str(tmp_path / "gold"), "--output", str(tmp_path / "d"), "--manifest", str(tmp_path / "m.json"), "--train-end", "2026-01-21T00:00:00+00:00", "--validation-end", "2026-02-01T00:00:00+00:00"])
    assert dispatch(spark, args).counts["train"]["rows"] == 200
    assert main(["optimize-thresholds", "--dataset", str(tmp_path / "none"), "--models", "m", "--policy", "p"]) == 1
    assert "error: missing inputs" in capsys.readouterr().err
    for bad in (["build-ml-dataset", "--gold", "g", "--output", "o", "--manifest", "m", "--train-end", "2026-01-21", "--validation-end", "2026-02-01"], ["nothing"]):
        with pytest.raises(SystemExit):
            parser().parse_args(bad)
    assert timedelta(0) == args.train_end.utcoffset()


def test_equal_scores_go_to_the_card_that_comes_first(spark):
    rows = [("2024-01-01", 9, 0, 0.5, "2024-01-01 08:00:00", 3), ("2024-01-01", 2, 0, 0.5, "2024-01-01 09:00:00", 4), ("2024-01-01", 5, 1, 0.5, "2024-01-01 08:00:00", 1), ("2024-01-01", 2, 0, 0.1, "2024-01-01 08:30:00", 2)]
    df = spark.createDataFrame(rows, "transaction_date string, customer_id long, tx_fraud int, score double, tx_datetime string, transaction_id long")
    for k, want in ((1, [5]), (2, [5, 9]), (3, [5, 9, 2])):
        got = top_cards_per_day(card_days(df, place=True), k)
        assert sorted(r["customer_id"] for r in got.collect()) == sorted(want)
    got = top_cards_per_day(card_days(df), 1)  # without places: the smaller id
    assert [r["customer_id"] for r in got.collect()] == [2]
