"""Marts, data tests and registered queries."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from riskweave.operators.gold import GoldTables
from riskweave.plans import queries as plan_queries
from riskweave.plans.checks import accepted_values, all_checks, duplicates, not_null, unique, violation_counts
from riskweave.plans.marts import LAYERS, build_marts, rolling_risk

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def gold(spark):
    tx = spark.createDataFrame([(1, "2018-04-01", 10.0, 0), (2, "2018-04-01", 30.0, 1), (3, "2018-04-08", 20.0, 0)], "transaction_id long, d string, tx_amount double, tx_fraud int").withColumn("transaction_date", F.to_date("d"))
    customer = spark.createDataFrame([("2018-04-01", 1, 2, 40.0, 20.0, 30.0, 1, 0.5), ("2018-04-08", 1, 1, 20.0, 20.0, 20.0, 0, 0.0)], "d string, customer_id long, transaction_count long, total_amount double, average_amount double, maximum_amount double, fraud_count long, fraud_rate double").withColumn("transaction_date", F.to_date("d")).drop("d")
    terminal = spark.createDataFrame([("2018-04-01", 7, 2, 1, 40.0, 20.0, 1, 0.5), ("2018-04-08", 8, 1, 1, 20.0, 20.0, 0, 0.0)], "d string, terminal_id long, transaction_count long, unique_customers long, total_amount double, average_amount double, fraud_count long, fraud_rate double").withColumn("transaction_date", F.to_date("d")).drop("d")
    return GoldTables(tx, customer, terminal)


def test_mart_rows(spark, gold):
    built = build_marts(spark, gold)
    assert set(built) == set(LAYERS)
    daily = [tuple(r)[1:] for r in built["fct_daily_fraud"].orderBy("transaction_date").collect()]
    assert daily == [(2, 40.0, 1, 0.5), (1, 20.0, 0, 0.0)]
    report = [tuple(r)[1:] for r in built["rpt_daily_fraud_overview"].orderBy("transaction_date").collect()]
    assert report == [(2, 40.0, 1, 0.5, 1, 1, 1, 1), (1, 20.0, 0, 0.0, 1, 0, 1, 0)]
    assert all(r["violations"] == 0 for r in violation_counts(built).collect())


def test_rolling_frame_is_seven_calendar_days(spark):
    rows = [("2018-04-01", 1, 1), ("2018-04-07", 1, 2), ("2018-04-08", 1, 4), ("2018-04-20", 1, 8)]
    df = spark.createDataFrame(rows, "d string, customer_id long, transaction_count long").select(F.to_date("d").alias("transaction_date"), "customer_id", "transaction_count", F.lit(1.0).alias("total_amount"), F.lit(0).cast("long").alias("fraud_count"))
    out = rolling_risk(df, "customer").orderBy("transaction_date").collect()
    assert [r["rolling_7d_transaction_count"] for r in out] == [1, 3, 6, 8]


def test_materialized_marts(spark, gold):
    built = build_marts(spark, gold, materialize=True)
    assert spark.catalog.tableExists("fct_daily_fraud") and built["fct_daily_fraud"].count() == 2


def test_data_tests_find_what_is_wrong(spark, gold):
    built = dict(build_marts(spark, gold))
    built["fct_daily_fraud"] = built["fct_daily_fraud"].withColumn("total_amount", F.col("total_amount") + 1)
    built["stg_customer_daily_summary"] = built["stg_customer_daily_summary"].union(built["stg_customer_daily_summary"])
    bad = {name for name, df in all_checks(built).items() if not df.isEmpty()}
    assert bad == {"daily_fraud_reconciles", "daily_risk_marts_reconcile", "stg_customer_daily_summary_unique"}
    df = spark.createDataFrame([(1, None), (1, 3)], "a long, b long")
    assert duplicates(df, "a").count() == unique(df, "a").count() == not_null(df, "b").count() == accepted_values(df, "b", (0, 1)).count() == 1


def canonical(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    text = lambda v: "" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v).removesuffix(" 00:00:00")
    return sorted(tuple(text(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(plan_queries.ORACLE_SQL) - {"union_by_name", "lenient_casts"}))
def test_query_matches_its_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    got = __spark_entry__.queries()[name](spark, DATA).toPandas()
    want = con.execute(plan_queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
