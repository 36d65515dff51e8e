"""Batch sources: dated files, tables in Parquet, JSON artifacts."""

from __future__ import annotations

import io
import json
import re
from datetime import date
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import require_columns, require_rows, require_unique
from ..schemas import BRONZE, SILVER, SOURCE, SOURCE_COLUMNS
from . import store


def discover_daily_files(folder: str | Path, suffix: str = ".pkl") -> list[str]:
    """Names of the files named by a real date, in date order; one with another name fails the listing."""
    found = []
    for name in store.children(folder):
        stem, dot, _ = name.rpartition(suffix)
        if not dot or not name.endswith(suffix) or name.startswith((".", "_")):
            continue
        try:
            if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", stem):
                raise ValueError
            found.append((date.fromisoformat(stem), name))
        except ValueError:
            raise ValueError(f"file name is not a date: {name}") from None
    return [name for _, name in sorted(found)]


def file_days(rows: DataFrame, suffix: str = ".pkl") -> DataFrame:
    """The files that rows come from with their dates: source_file, source_file_date; null for a bad name."""
    return dated(rows.select("source_file").distinct(), suffix)


def require_dated(rows: DataFrame, suffix: str = ".pkl") -> None:
    """Raise if rows come from a file that is not named by a date."""
    bad = file_days(rows, suffix).filter("source_file_date is null").agg(F.min(F.coalesce("source_file", F.lit("(no name)"))).alias("name")).first()["name"]
    if bad is not None:
        raise ValueError(f"file name is not a date: {bad}")


def read_source_csv(spark: SparkSession, path: str, *, null_value: str | None = "") -> DataFrame:
    """Source rows as text; ``null_value`` is the spelling of a missing value (None: an empty field stays text)."""
    reader = spark.read.schema(SOURCE).option("header", True)
    return reader.option("nullValue", null_value).csv(path) if null_value is not None else reader.csv(path).na.fill("")


def read_source_pickles(spark: SparkSession, folder: str) -> DataFrame:
    """Source rows of trusted pickled data frames: the columns as text, source_file and row_in_file.

    Pickles execute code, so only files from a trusted place may be read. Files
    are read by Spark and unpickled one at a time in the tasks.
    """
    def load(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                frame = pd.read_pickle(io.BytesIO(content))
                if not isinstance(frame, pd.DataFrame):
                    raise ValueError(f"{path} does not hold a data frame")
                missing, extra = set(SOURCE_COLUMNS) - set(frame.columns), set(frame.columns) - set(SOURCE_COLUMNS)
                if missing or extra:
                    raise ValueError(f"{path}: missing columns {sorted(missing)}, unexpected columns {sorted(extra)}")
                text = frame[list(SOURCE_COLUMNS)].astype(object).map(lambda x: None if pd.isna(x) else str(x)).reset_index(drop=True)
                yield text.assign(source_file=path.rsplit("/", 1)[-1], row_in_file=range(len(text)))

    schema = T.StructType([*SOURCE.fields, T.StructField("source_file", T.StringType()), T.StructField("row_in_file", T.LongType())])
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pkl").load(folder).select("path", "content").mapInPandas(load, schema)


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BRONZE).parquet(path)


def read_ids(spark: SparkSession, path: str, days: DataFrame | None = None) -> DataFrame:
    """Known transaction ids, of the given days only if there are any given; only that column is read."""
    silver = spark.read.parquet(path)
    silver = silver if days is None else silver.join(F.broadcast(days.select("source_file_date")), "source_file_date", "left_semi")
    return silver.select("transaction_id")


def load_silver(spark: SparkSession, path: str) -> DataFrame:
    """All Silver rows, checked: layout, at least one row, unique ids."""
    silver = spark.read.parquet(path)
    require_columns(silver, SILVER.names, "Silver data")
    require_rows(silver, "Silver data")
    require_unique(silver, "transaction_id", "Silver data")
    return silver.select(*SILVER.names)


def union_view(spark: SparkSession, name: str, paths: list[str]) -> DataFrame:
    """A view over Parquet files, united by column name."""
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    df.createOrReplaceTempView(name)
    return df


def require_inputs(spark: SparkSession, paths: list[str]) -> None:
    """Raise with the names of all inputs that are missing."""
    missing = []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            missing.append(path.rstrip("/").rsplit("/", 1)[-1])
    if missing:
        raise FileNotFoundError(f"missing inputs: {', '.join(sorted(missing))}")


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """One split of a model dataset; fails if it is missing or empty."""
    require_inputs(spark, [f"{folder}/split={split}"])
    df = spark.read.parquet(f"{folder}/split={split}")
    require_rows(df, f"split {split}")
    return df


def model_example(spark: SparkSession, path: str, features: list[str], n: int = 5) -> DataFrame:
    """The first rows of the feature columns, for a model's signature."""
    return spark.read.parquet(path).select(*features).limit(n)


def load_json_object(path: str | Path, what: str) -> dict:
    """A JSON file that must exist, parse and be an object."""
    if not store.is_file(path):
        raise FileNotFoundError(f"{what} not found: {path}")
    try:
        content = json.loads(store.read_text(path))
    except json.JSONDecodeError as e:
        raise ValueError(f"{what} is not valid JSON: {path}") from e
    if not isinstance(content, dict):
        raise ValueError(f"{what} must be a JSON object")
    return content


def dated(df: DataFrame, suffix: str = ".pkl") -> DataFrame:
    """Adds source_file_date from source_file."""
    return df.withColumn("source_file_date", F.regexp_extract("source_file", rf"^(\d{{4}}-\d{{2}}-\d{{2}}){re.escape(suffix)}$", 1).try_cast("date"))
