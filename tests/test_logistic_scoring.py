"""Logistic scores as column expressions."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Observation
from pyspark.sql import functions as F

from riskweave.ml.models import BASELINES, fit_model, load_model
from test_ml import features


def test_scores_are_those_of_mllib_also_after_an_observation(spark, tmp_path):
    df, seen = features(spark), Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()  # from now on the session cannot be sent to tasks
    assert seen.get == {"n": 3}
    model = fit_model("logistic_regression", BASELINES["logistic_regression"], df)
    extreme = df.withColumn("tx_amount", F.when(F.col("transaction_id") == 1, 1e9).when(F.col("transaction_id") == 2, -1e9).otherwise(F.col("tx_amount")))
    ours = {r[0]: r[1] for r in model.score(extreme).select("transaction_id", "score").collect()}
    assert model.score(extreme).columns == [*df.columns, "score"]
    model.save(str(tmp_path / "m"))
    loaded = load_model(str(tmp_path / "m"))  # a loaded model has no summary, so MLlib's own expression works
    theirs = loaded.model.transform(loaded.preprocessor.transform(extreme)).select("transaction_id", vector_to_array("probability")[1].alias("p")).collect()
    assert len(theirs) == len(ours) and all(abs(ours[r["transaction_id"]] - r["p"]) < 1e-12 for r in theirs)
    assert {ours[1], ours[2]} == {0.0, 1.0}
    again = {r[0]: r[1] for r in loaded.score(extreme).select("transaction_id", "score").collect()}
    assert again == ours
