"""Gold day by day: new days are joined with what their entities did before, without reading the history.

Every table is kept by day. Beside them is state of two kinds: ``entity_days``,
the count and the sum of each customer and terminal a day, and ``entity_totals``,
the same up to the end of a day, a row an entity. New days start from the totals
before the first of them. A late day is one before the newest: features of the
days from it on are computed again, from the newest totals that are older than
it plus the days between; summaries of other days do not change and stay.

A run writes new folders and replaces the manifest last, so an interrupted run
leaves the tables as they were and is repeated whole. The folders of the version
before stay for readers that have begun. One run at a time may write.
"""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import require_columns, require_none
from ..functions.scalars import MONEY
from ..schemas import SILVER
from ..sources import store
from ..sources.files import require_inputs
from ..sources.publish import loaded_dates, table_path, write_json
from .gold import GoldTables, daily_summary, require_silver, transaction_features

MANIFEST = "_days.json"
TABLES = ("transaction_features", "customer_daily_summary", "terminal_daily_summary")
ENTITIES = ("customer", "terminal")
STATE = "entity string, key bigint, n bigint, total decimal(28,4)"
#: Totals that are kept; a day later than all of them starts from the sums of all days.
SNAPSHOTS = 8


def manifest(root: str) -> dict:
    """Which version of each table holds which day; what an empty store has if there is none."""
    place = f"{root}/{MANIFEST}"
    empty = {"done": [], "tables": {t: {} for t in (*TABLES, "entity_days")}, "totals": {}, "before": []}
    return json.loads(store.read_text(place)) if store.exists(place) else empty


def day_paths(root: str, name: str, known: dict) -> list[str]:
    """The folders of a table's days."""
    return [f"{root}/{name}/version={v}/day={d}" for d, v in sorted(known["tables"][name].items())]


def read_days(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the store as it stands now."""
    paths = day_paths(root, name, manifest(root))
    if not paths:
        raise FileNotFoundError(f"{root} holds no day of {name}")
    return spark.read.option("basePath", f"{root}/{name}").parquet(*paths).drop("version", "day")


def entity_days(silver: DataFrame) -> DataFrame:
    """Rows of STATE with their day."""
    amount = F.sum(F.col("tx_amount").cast(MONEY)).cast("decimal(28,4)")
    parts = [silver.groupBy(F.lit(e).alias("entity"), F.col(f"{e}_id").alias("key"), F.col("source_file_date").alias("day")).agg(F.count(F.lit(1)).alias("n"), amount.alias("total")) for e in ENTITIES]
    return parts[0].unionByName(parts[1])


def add_up(rows: DataFrame) -> DataFrame:
    return rows.groupBy("entity", "key").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(28,4)").alias("total"))


def totals_before(spark: SparkSession, root: str, known: dict, first: str) -> DataFrame:
    """What every entity did before the day ``first``: the newest totals that are older, and the days since."""
    since = max((d for d in known["totals"] if d < first), default=None)
    totals = spark.read.schema(STATE).parquet(f"{root}/entity_totals/version={known['totals'][since]}") if since else None
    days = {d: v for d, v in known["tables"]["entity_days"].items() if d < first and (since is None or d > since)}
    if not days:
        return totals if totals is not None else spark.createDataFrame([], STATE)
    between = spark.read.schema(STATE).parquet(*(f"{root}/entity_days/version={v}/day={d}" for d, v in sorted(days.items())))
    return add_up(between if totals is None else totals.unionByName(between))


def continue_days(spark: SparkSession, silver: DataFrame, days: list[date], root: str) -> list[str]:
    """Bring Gold up to date with the given days of Silver; returns the days whose features were written.

    Silver's days must be those of its timestamps and its ids unique, as its
    ingestion sees to; ids are checked within the given days. Days that Gold has
    already, and repeated ones, are left out.
    """
    require_columns(silver, SILVER.names, "Silver data")
    root, known = root.rstrip("/"), manifest(root.rstrip("/"))
    new = sorted({d.isoformat() for d in days} - set(known["done"]))
    if not new:
        return []
    changed = sorted({*new, *(d for d in known["done"] if d > new[0])})
    fresh = silver.filter(F.col("source_file_date").isin([date.fromisoformat(d) for d in new]))
    require_silver(fresh)
    require_none(fresh, {"Silver timestamps must be of their file's date": F.to_date("tx_datetime") != F.col("source_file_date")})
    rows = silver.filter(F.col("source_file_date").isin([date.fromisoformat(d) for d in changed]))
    before = totals_before(spark, root, known, new[0])
    version = f"v{uuid.uuid4().hex}"
    dated = fresh.withColumn("transaction_date", F.col("source_file_date"))
    written = {
        "transaction_features": transaction_features(rows, before).withColumn("day", F.col("source_file_date")),
        **{f"{e}_daily_summary": daily_summary(dated, e).withColumn("day", F.col("transaction_date")) for e in ENTITIES},
        "entity_days": entity_days(fresh),
    }
    tables = {name: dict(at) for name, at in known["tables"].items()}
    for name, df in written.items():
        place = f"{root}/{name}/version={version}"
        df.hint("rebalance", "day").write.partitionBy("day").parquet(place)
        tables[name] |= {d.removeprefix("day="): version for d in store.children(place) if d.startswith("day=")}
    later = [f"{root}/entity_days/version={v}/day={d}" for d, v in sorted(tables["entity_days"].items()) if d >= new[0]]
    totals = before if not later else add_up(before.unionByName(spark.read.schema(STATE).parquet(*later)))
    totals.write.parquet(f"{root}/entity_totals/version={version}")
    kept = dict(sorted(((d, v) for d, v in known["totals"].items() if d < new[0]), reverse=True)[: SNAPSHOTS - 1])
    now = {"done": sorted({*known["done"], *new}), "tables": tables, "totals": {**kept, changed[-1]: version}, "before": references(known)}
    write_json(f"{root}/{MANIFEST}", now)
    drop_unused(root, now)
    return changed


def references(known: dict) -> list[str]:
    """The folders that a manifest names."""
    folders = {f"{name}/version={v}" for name, at in known["tables"].items() for v in at.values()}
    return sorted(folders | {f"entity_totals/version={v}" for v in known["totals"].values()})


def drop_unused(root: str, known: dict) -> None:
    """Remove folders that neither this manifest nor the one before names."""
    used = {*references(known), *known["before"]}
    for name in (*known["tables"], "entity_totals"):
        for folder in store.children(f"{root}/{name}"):
            if f"{name}/{folder}" not in used:
                store.delete(f"{root}/{name}/{folder}")


def continue_gold(spark: SparkSession, silver_path: str, gold_path: str) -> list[str]:
    """Bring Gold up to date with Silver's finished days; only partitions that are needed are read."""
    days = [r[0] for r in loaded_dates(spark, f"{silver_path.rstrip('/')}-days").collect()]
    return continue_days(spark, spark.read.schema(SILVER).parquet(silver_path), days, gold_path) if days else []


def open_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A Gold table of a folder, kept by day or rebuilt whole."""
    root = root.rstrip("/")
    return read_days(spark, root, name) if store.exists(f"{root}/{MANIFEST}") else spark.read.parquet(table_path(root, name))


def open_gold(spark: SparkSession, root: str) -> GoldTables:
    """All Gold tables of a folder, after checking that they are there."""
    root = root.rstrip("/")
    if not store.exists(f"{root}/{MANIFEST}"):
        require_inputs(spark, [table_path(root, name) for name in TABLES])
    return GoldTables(*(open_table(spark, root, name) for name in TABLES))
