"""Preprocessing and models. Everything is fitted on training rows and applied as columns."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import require_columns, require_none
from ..schemas import MODEL_FEATURES, MODEL_TARGET
from ..sources import store
from ..sources.publish import write_json
from . import boosting

#: Parameters of the baseline models.
BASELINES = {
    "prior": {},
    "logistic_regression": {"C": 1.0, "class_weight": "balanced"},
    "boosted_trees": {"n_estimators": 200, "max_depth": 4, "learning_rate": 0.05, "subsample": 0.8, "colsample_bytree": 0.8, "scale_pos_weight": True, "reg_alpha": 0.0, "reg_lambda": 1.0},
}
SEED = 42
TREES = "trees.json"
#: L1 and L2 terms; with either, trees are boosted by second-order histograms, else by MLlib.
REGULARISED = ("reg_alpha", "reg_lambda")
PARAMETERS = {
    "prior": set(),
    "logistic_regression": {"C", "class_weight", "max_iter"},
    "boosted_trees": {"n_estimators", "max_depth", "learning_rate", "subsample", "colsample_bytree", "scale_pos_weight", "min_child_weight", *REGULARISED},
}


def exact_quantiles(df: DataFrame, columns: list[str], q: float, *, driver_rows: int = 100_000) -> list[float | None]:
    """The q-quantile of every column with linear interpolation, exact on any number of rows.

    One pass brackets the two order statistics of each column with approximate
    quantiles, a second counts what lies below and inside the bracket, and the
    third brings the values inside to the driver, at most ``driver_rows`` a
    column. A column with more is bracketed again within its bracket.
    """
    values = df.select(*(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)))
    n = values.agg(*(F.count(f"v{i}").alias(f"v{i}") for i in range(len(columns)))).first()
    spots = [(math.floor(q * (n[f"v{i}"] - 1)), math.ceil(q * (n[f"v{i}"] - 1))) for i in range(len(columns))]
    state = {i: (-math.inf, math.inf, 0, n[f"v{i}"]) for i in range(len(columns)) if n[f"v{i}"]}
    found: list[float | None] = [None] * len(columns)
    for _ in range(6):
        wide = [i for i, s in state.items() if s[3] > driver_rows]
        if not wide:
            break
        inside = {i: F.when(F.col(f"v{i}").between(*state[i][:2]), F.col(f"v{i}")) for i in wide}
        places = {i: [min(1.0, max(0.0, (x - state[i][2]) / state[i][3] + m)) for x, m in zip(spots[i], (-3e-4, 3e-4), strict=True)] for i in wide}
        bounds = values.agg(*(F.percentile_approx(inside[i], places[i], 10_000).alias(f"b{i}") for i in wide)).first()
        counts = values.agg(*(F.struct(F.count_if(F.col(f"v{i}") < bounds[f"b{i}"][0]).alias("below"), F.count_if(F.col(f"v{i}").between(*bounds[f"b{i}"])).alias("inside")).alias(f"c{i}") for i in wide)).first()
        for i in wide:
            (low, high), c = bounds[f"b{i}"], counts[f"c{i}"]
            if c["below"] <= spots[i][0] and spots[i][1] < c["below"] + c["inside"]:
                state[i] = (low, high, c["below"], c["inside"])
                if low == high:
                    found[i] = low
                    del state[i]
    for i in [i for i, s in state.items() if s[3] > driver_rows]:
        found[i] = values.agg(F.percentile(f"v{i}", q).alias("q")).first()["q"]
        del state[i]
    if state:
        pieces = F.array(*(F.when(F.col(f"v{i}").between(*s[:2]), F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v"))) for i, s in state.items()))
        kept: dict[int, list[float]] = {i: [] for i in state}
        for row in values.select(F.explode(F.array_compact(pieces)).alias("p")).select("p.i", "p.v").collect():
            kept[row["i"]].append(row["v"])
        for i, (_, _, below, _) in state.items():
            part = sorted(kept[i])
            a, b = part[spots[i][0] - below], part[spots[i][1] - below]
            found[i] = a + (b - a) * (q * (n[f"v{i}"] - 1) - spots[i][0])
    return found


def exact_quantile(df: DataFrame, column: str, q: float, *, driver_rows: int = 100_000) -> float | None:
    """``exact_quantiles`` of one column."""
    return exact_quantiles(df, [column], q, driver_rows=driver_rows)[0]


@dataclass(frozen=True)
class Preprocessor:
    """Median imputation and standardisation by population deviation."""

    features: tuple[str, ...]
    medians: tuple[float, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]

    @classmethod
    def fit(cls, train: DataFrame, features: tuple[str, ...] = MODEL_FEATURES) -> Preprocessor:
        """Statistics of training rows; an all-null column counts as 0, one without spread is only centred."""
        medians = [m or 0.0 for m in exact_quantiles(train, list(features), 0.5)]
        filled = [F.coalesce(F.col(f).cast("double"), F.lit(m)) for f, m in zip(features, medians, strict=True)]
        row = train.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(filled)), *(F.stddev_pop(c).alias(f"d{i}") for i, c in enumerate(filled))).first()
        n = range(len(features))
        return cls(tuple(features), tuple(medians), tuple(row[f"m{i}"] or 0.0 for i in n), tuple(row[f"d{i}"] or 1.0 for i in n))

    def columns(self) -> list[Column]:
        parts = zip(self.features, self.medians, self.means, self.deviations, strict=True)
        return [((F.coalesce(F.col(f).cast("double"), F.lit(m)) - mean) / dev).alias(f"_x{i}") for i, (f, m, mean, dev) in enumerate(parts)]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the vector column _features."""
        names = [f"_x{i}" for i in range(len(self.features))]
        return VectorAssembler(inputCols=names, outputCol="_features").transform(df.select("*", *self.columns())).drop(*names)


def require_inputs(df: DataFrame, features=MODEL_FEATURES) -> None:
    """Features must be there, numeric and not infinite."""
    require_columns(df, features, "model input")
    text = [c for c, kind in df.dtypes if c in features and kind == "string"]
    require_none(df, {
        **{f"{c} must be numeric": F.col(c).isNotNull() & F.col(c).try_cast("double").isNull() for c in text},
        **{f"{c} must not be infinite": F.abs(F.col(c).try_cast("double")) == float("inf") for c in features},
    })


def class_counts(train: DataFrame, label: str = MODEL_TARGET) -> tuple[int, int]:
    """Rows of class 0 and of class 1; both must be there."""
    row = train.agg(F.count_if(F.col(label) == 0).alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    if not row["n"] or not row["p"]:
        raise ValueError("training rows need both classes")
    return row["n"], row["p"]


@dataclass(frozen=True)
class FittedModel:
    """A fitted classifier with its preprocessing and contract."""

    kind: str
    parameters: dict
    preprocessor: Preprocessor
    model: LogisticRegressionModel | GBTClassificationModel | boosting.BoostedTrees | None
    prior: float
    target: str = MODEL_TARGET
    features: tuple[str, ...] = field(default=MODEL_FEATURES)

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``score``, the probability of class 1."""
        if self.model is None:
            return df.withColumn("score", F.lit(self.prior))
        if isinstance(self.model, boosting.BoostedTrees):
            return self.model.score(df.select("*", *self.preprocessor.columns())).drop(*self.model.columns)
        if isinstance(self.model, LogisticRegressionModel):
            # a column expression: MLlib's own one drags the training summary, and with it the session, into every task
            weights = [float(w) for w in self.model.coefficients]
            margin = sum((F.col(f"_x{i}") * w for i, w in enumerate(weights)), F.lit(float(self.model.intercept)))
            names = [f"_x{i}" for i in range(len(weights))]
            return df.select("*", *self.preprocessor.columns()).withColumn("score", 1 / (1 + F.exp(-margin))).drop(*names)
        out = self.model.transform(self.preprocessor.transform(df))
        extra = [c for c in ("_features", "rawPrediction", "probability", "prediction") if c in out.columns]
        return out.withColumn("score", vector_to_array("probability")[1]).drop(*extra)

    def save(self, folder: str) -> None:
        """The model's files first, the manifest last."""
        if isinstance(self.model, boosting.BoostedTrees):
            store.delete(f"{folder}/model")
            write_json(f"{folder}/{TREES}", json.loads(self.model.to_json()))
        elif self.model is not None:
            self.model.write().overwrite().save(f"{folder}/model")
        p = self.preprocessor
        write_json(f"{folder}/manifest.json", {
            "kind": self.kind, "parameters": self.parameters, "prior": self.prior, "target": self.target,
            "features": list(p.features), "medians": list(p.medians), "means": list(p.means), "deviations": list(p.deviations),
        })


def load_model(folder: str) -> FittedModel:
    """A saved model, checked against the feature and target contract."""
    if not store.is_file(f"{folder}/manifest.json"):
        raise FileNotFoundError(f"model artifact not found: {folder}")
    m = json.loads(store.read_text(f"{folder}/manifest.json"))
    if tuple(m["features"]) != MODEL_FEATURES or m["target"] != MODEL_TARGET:
        raise ValueError("the model was trained for other features or another target")
    loaders = {"logistic_regression": LogisticRegressionModel, "boosted_trees": GBTClassificationModel, "prior": None}
    if m["kind"] not in loaders:
        raise ValueError(f"unknown model kind: {m['kind']}")
    loader = loaders[m["kind"]]
    pre = Preprocessor(tuple(m["features"]), tuple(m["medians"]), tuple(m["means"]), tuple(m["deviations"]))
    if m["kind"] == "boosted_trees" and set(REGULARISED) & set(m["parameters"]):
        return FittedModel(m["kind"], m["parameters"], pre, boosting.BoostedTrees.from_json(store.read_text(f"{folder}/{TREES}")), m["prior"])
    return FittedModel(m["kind"], m["parameters"], pre, loader.load(f"{folder}/model") if loader else None, m["prior"])


def fit_model(kind: str, parameters: dict, train: DataFrame) -> FittedModel:
    """Fit one model; a parameter that would change nothing is an error."""
    unknown = set(parameters) - PARAMETERS.get(kind, set(parameters))
    if unknown:
        raise ValueError(f"{kind} has no parameters {sorted(unknown)}")
    require_inputs(train)
    train = train.select(*MODEL_FEATURES, MODEL_TARGET).persist()
    try:
        return _fit(kind, parameters, train)
    finally:
        train.unpersist()


def _fit(kind: str, parameters: dict, train: DataFrame) -> FittedModel:
    negative, positive = class_counts(train)
    total = negative + positive
    pre = Preprocessor.fit(train)
    if kind == "prior":
        return FittedModel(kind, parameters, pre, None, positive / total)
    label = F.col(MODEL_TARGET).cast("double").alias("label")
    weight, weight_sum = F.lit(1.0), float(total)
    if parameters.get("class_weight") == "balanced":
        weight = F.when(F.col(MODEL_TARGET) == 1, total / (2.0 * positive)).otherwise(total / (2.0 * negative))
    elif parameters.get("scale_pos_weight"):
        weight = F.when(F.col(MODEL_TARGET) == 1, negative / positive).otherwise(1.0)
    if kind == "boosted_trees" and set(REGULARISED) & set(parameters):
        names = [f"_x{i}" for i in range(len(pre.features))]
        settings = {"n_estimators": 100, "max_depth": 4, "learning_rate": 0.1} | {k: v for k, v in parameters.items() if k != "scale_pos_weight"}
        trees = boosting.fit(train.select(MODEL_TARGET, *pre.columns(), weight.alias("_weight")), names, MODEL_TARGET, weight=F.col("_weight"), seed=SEED, **settings)
        return FittedModel(kind, parameters, pre, trees, positive / total)
    rows = pre.transform(train).select("_features", label, weight.alias("_weight")).persist()
    try:
        if kind == "logistic_regression":
            ridge = 1 / (parameters.get("C", 1.0) * weight_sum)
            learner = LogisticRegression(featuresCol="_features", labelCol="label", weightCol="_weight", regParam=ridge, elasticNetParam=0.0, standardization=False, maxIter=parameters.get("max_iter", 1000))
        elif kind == "boosted_trees":
            learner = GBTClassifier(
                featuresCol="_features", labelCol="label", weightCol="_weight", seed=SEED,
                maxIter=parameters.get("n_estimators", 100), maxDepth=parameters.get("max_depth", 4), stepSize=parameters.get("learning_rate", 0.1),
                subsamplingRate=parameters.get("subsample", 1.0), minInstancesPerNode=parameters.get("min_child_weight", 1),
                featureSubsetStrategy=str(float(parameters.get("colsample_bytree", 1.0))),
            )
        else:
            raise ValueError(f"unknown model: {kind}")
        return FittedModel(kind, parameters, pre, learner.fit(rows), positive / total)
    finally:
        rows.unpersist()
