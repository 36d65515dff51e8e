"""Quality scores that combine a document's own evidence with what its site is like.

A logistic model over text statistics gives every document evidence. Sums of
it per host and per path of a host, by grouped aggregation over all documents,
give Beta posteriors: a path is shrunk toward its host and a host toward the
global rate, the more the fewer documents it has; how strongly is estimated
from how much hosts (and paths within hosts) differ. The final log odds are
those of the document plus the shift of its path's posterior from the global
rate.

The model is fitted on at most ``max_train_rows`` labelled rows. Texts are read
once: the rows with their evidence are a table, from which sites are summed (as
decimals, so that no rate depends on the order of rows) and rows are scored.
The table of sites is broadcast if it has at most ``broadcast_sites`` rows and
joined by a shuffle otherwise. Hosts and paths are any two columns; ``url_host``
and ``url_path`` take them from URLs. Defined cases: null and empty texts have the statistics of
an empty text; null hosts and paths are values of their own; without labels of
both kinds every document's evidence is neutral; repeated rows get equal
scores; an empty table gives no rows; input columns stay as they are, under any
name, but for those of the result's names, which are replaced; a URL that does
not parse has neither host nor path.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .logistic import fit_logistic
from .toxicity import labelled_sample
from .workspace import Workspace

SYMBOLS = re.compile(r"[#$%&*|<>{}\[\]=~^\\]")


def text_statistics(text: str | None) -> list[float]:
    """Numbers on case, symbols, repetition, word lengths and lines of a whole text."""
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    letters = max(1, sum(map(str.isalpha, text))) if not text.isascii() else max(1, len(re.findall("[A-Za-z]", text)))
    upper = len(re.findall("[A-Z]", text)) if text.isascii() else sum(map(str.isupper, text))
    counts = Counter(words)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    top = max(counts.values(), default=0)
    sentences = text.count(". ") + text.count(".\n") + text.count(".") / 10
    capital = sum(w[:1].isupper() for w in words)
    return [
        math.log1p(len(words)),
        upper / letters,
        letters / chars,
        len(SYMBOLS.findall(text)) / chars * 10,
        math.log1p(100 * text.count("!!") / n),
        math.log1p(100 * (text.count("|") + text.count("\t")) / n),
        math.log1p(100 * len(re.findall(r"[0-9]", text)) / chars),
        len(text) / n / 10,
        len(counts) / n,
        repeats / n,
        top / n,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
        min(5.0, 10 * sentences / n),
        capital / n,
        sum(len(w) <= 3 for w in words) / n,
        sum(len(w) > 14 for w in words) / n,
        len(re.findall(r"https?:|www\.|@", text)) / n * 10,
        1.0 if not words else 0.0,
    ]


N_FEATURES = 19


def expand(rows: np.ndarray) -> np.ndarray:
    """The statistics and their squares, so that a middle range can be best."""
    return np.concatenate([rows, rows * rows], axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logit(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((expand(rows) - self.mean) / self.scale @ self.weights[1:] + self.weights[0], -12, 12)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", usable: Column | None = None, max_train_rows: int = 20_000) -> Model:
    sample = labelled_sample(docs, labels, label_col, id_col=id_col, text_col=text_col, usable=usable, max_train_rows=max_train_rows)

    def rows(batches):
        for batch in batches:
            x = np.array([text_statistics(t) for t in batch.column(0).to_pylist()], dtype=np.float64).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(N_FEATURES)), batch.column(1)], [*(f"f{i}" for i in range(N_FEATURES)), "y"])

    table = sample.mapInArrow(rows, ", ".join(f"f{i} double" for i in range(N_FEATURES)) + ", y int").toPandas()
    table = table.sort_values(list(table.columns))  # sums that do not depend on the order of arrival
    y = table["y"].to_numpy()
    if len(set(y)) < 2:
        return Model(np.zeros(2 * N_FEATURES), np.ones(2 * N_FEATURES), np.zeros(2 * N_FEATURES + 1))
    return Model(*fit_logistic(expand(table.drop(columns="y").to_numpy()), y))


def evidence(docs: DataFrame, model: Model, *, text_col: str, host_col: str, path_col: str, keep: list[str]) -> DataFrame:
    """Rows of row (the kept columns), host, path and logit, the document's own log odds of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast((model.mean, model.scale, model.weights))

    def run(batches):
        model = Model(*shared.value)
        for batch in batches:
            x = np.array([text_statistics(t.as_py()) for t in batch.column(3)], dtype=np.float64).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(model.logit(x))], ["row", "host", "path", "logit"])

    whole = F.struct(*(F.col(c) for c in keep)) if keep else F.struct(F.lit(True).alias("_"))
    rows = docs.select(whole.alias("row"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:3], T.StructField("logit", T.DoubleType())]))


def url_host(url: Column) -> Column:
    """The host of a URL, in lower case."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def url_path(url: Column) -> Column:
    """The first folder of a URL's path, "" at the top."""
    return F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"^/([^/]*)/", 1)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _strength(groups: DataFrame, n: Column, mean: Column, center: Column) -> float:
    """The prior's weight in documents, from the spread of group means around their centers."""
    def total(value: Column) -> Column:
        return F.sum(value.cast("decimal(38,15)")).cast("double")

    got = groups.agg(
        F.sum(n).alias("n"), F.count(F.lit(1)).alias("g"), total(n * (mean - center) ** 2).alias("between"), total(n * center * (1 - center)).alias("within"), F.sum(n.cast("decimal(19,0)") * n).cast("double").alias("squares")
    ).first()
    total_n = got["n"] or 0
    if not total_n or got["g"] < 2:
        return 100.0
    within = max(got["within"] / total_n, 1e-6)
    spare = total_n - got["squares"] / total_n
    tau = max((got["between"] - (got["g"] - 1) * within) / max(spare, 1e-9), 1e-9)
    return float(np.clip(within / tau - 1, 1.0, 1e6))


NEW = ("_evidence", "_host_rate", "_path_rate", "_score", "_kept")


def classify(docs: DataFrame, model: Model, ws: Workspace, *, text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5, broadcast_sites: int = 50_000, keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (all by default) and _evidence, _host_rate, _path_rate, _score and _kept of every document."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in NEW]
    rows = ws.table("evidence", evidence(docs, model, text_col=text_col, host_col=host_col, path_col=path_col, keep=keep))
    weight = F.sum(sigmoid(F.col("logit")).cast("decimal(20,15)"))
    paths = ws.narrow_table("paths", rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), weight.alias("s")))
    hosts = paths.groupBy(F.col("host").alias("at")).agg(F.sum("n").alias("hn"), F.sum("s").cast("double").alias("hs"))
    totals = paths.agg(F.sum("n").alias("n"), F.sum("s").cast("double").alias("s")).first()
    rate = min(max((totals["s"] or 0.0) / (totals["n"] or 1), 1e-6), 1 - 1e-6)
    k_host = _strength(hosts, F.col("hn"), F.col("hs") / F.col("hn"), F.lit(rate))
    hosts = hosts.select("at", ((F.col("hs") + k_host * rate) / (F.col("hn") + k_host)).alias("host_rate"))
    pairs = paths.withColumn("s", F.col("s").cast("double")).join(hosts, F.col("host").eqNullSafe(F.col("at")))
    k_path = _strength(pairs, F.col("n"), F.col("s") / F.col("n"), F.col("host_rate"))
    sites = ws.narrow_table("sites", pairs.select(F.col("host").alias("h"), F.col("path").alias("p"), "host_rate", ((F.col("s") + k_path * F.col("host_rate")) / (F.col("n") + k_path)).alias("path_rate")))
    if sites.count() <= broadcast_sites:
        sites = F.broadcast(sites)
    joined = rows.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    shift = F.log(F.col("path_rate") / (1 - F.col("path_rate"))) - math.log(rate / (1 - rate))
    score = sigmoid(F.col("logit") + shift)
    return joined.select(*(F.col(f"row.`{c}`").alias(c) for c in keep), sigmoid(F.col("logit")).alias("_evidence"), F.col("host_rate").alias("_host_rate"), F.col("path_rate").alias("_path_rate"), score.alias("_score"), (score >= threshold).alias("_kept"))
