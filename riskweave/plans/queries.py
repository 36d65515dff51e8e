"""Registered queries over the driver's tables, and their DuckDB equivalents.

Every query runs over whole tables. Sums of money go through DECIMAL on both
sides, so results do not depend on the order of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..ml import boosting, dataset, metrics, models, policy, thresholds, tuning
from ..operators import bronze, gold, gold_days, known_ids, silver
from ..schemas import MODEL_FEATURES, SILVER, SILVER_NAMES, SOURCE_TO_SILVER
from ..sources import files
from ..sources.store import scratch
from ..streaming import events, ingest, replay, risk, scoring
from . import checks, marts
from .adapter import FEATURES_SQL, RAW_SQL, RISK_SQL, SCORED_SQL, SUMMARY_SQL, TX_SQL, raw_bronze, scored, transactions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TRAIN_END, VALIDATION_END = datetime(2024, 1, 15, tzinfo=timezone.utc), datetime(2024, 1, 22, tzinfo=timezone.utc)
CAPACITY, THRESHOLD = 20, 0.6


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def plain(df: DataFrame) -> DataFrame:
    """Small integers as bigint and timestamps as text, so that types agree between engines."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("tinyint", "smallint", "int"):
            out.append(F.col(name).cast("bigint").alias(name))
        elif kind.startswith("timestamp"):
            out.append(F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def with_sql(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"


# --- sources, Bronze, Silver -------------------------------------------------

@query(with_sql(TX_SQL, """
SELECT source_file, CAST(left(source_file, 10) AS DATE) AS source_file_date FROM (SELECT DISTINCT source_file FROM tx UNION ALL SELECT '2018-02-30.pkl' WHERE false)
UNION ALL SELECT 'notes.pkl', NULL UNION ALL SELECT '2018-02-30.pkl', NULL"""))
def source_file_days(spark, sf_dir):
    """The dates of the source files; names that are no date have none (a run refuses them)."""
    bad = spark.createDataFrame([("notes.pkl",), ("2018-02-30.pkl",)], "source_file string")
    return files.file_days(transactions(spark, sf_dir).select("source_file").unionByName(bad))


@query(with_sql(TX_SQL, """
SELECT CAST(transaction_id AS VARCHAR) AS "TRANSACTION_ID", CAST(customer_id AS VARCHAR) AS "CUSTOMER_ID", source_file, source_file_date,
       row_number() OVER (PARTITION BY source_file ORDER BY transaction_id) - 1 AS source_row_number FROM tx"""))
def bronze_records(spark, sf_dir):
    """Source rows with file, date and zero-based row number."""
    tx = transactions(spark, sf_dir)
    rows = tx.select(*(F.col(n).cast("string").alias(s) for s, (n, _) in SOURCE_TO_SILVER.items()), "source_file", F.col("transaction_id").alias("row_in_file"))
    return bronze.bronze_records(rows, datetime(2024, 6, 1, tzinfo=timezone.utc)).select("TRANSACTION_ID", "CUSTOMER_ID", "source_file", "source_file_date", "source_row_number")


JUDGED_SQL = RAW_SQL + """,
typed AS (
  SELECT *, TRY_CAST("TRANSACTION_ID" AS BIGINT) AS t_id, TRY_CAST("CUSTOMER_ID" AS BIGINT) AS c_id, TRY_CAST("TERMINAL_ID" AS BIGINT) AS e_id,
         TRY_CAST("TX_AMOUNT" AS DOUBLE) AS amount, TRY_CAST("TX_TIME_SECONDS" AS BIGINT) AS secs, TRY_CAST("TX_TIME_DAYS" AS BIGINT) AS dys,
         TRY_CAST("TX_FRAUD" AS BIGINT) AS label, TRY_CAST("TX_FRAUD_SCENARIO" AS BIGINT) AS scen, TRY_CAST("TX_DATETIME" AS TIMESTAMP) AS moment
  FROM raw
), ruled AS (
  SELECT *, list_filter([
    CASE WHEN "TX_AMOUNT" IS NULL THEN 'missing_required_value' END,
    CASE WHEN c_id IS NULL OR ("TX_AMOUNT" IS NOT NULL AND amount IS NULL) OR t_id < 0 OR c_id < 0 OR e_id < 0 THEN 'invalid_data_type' END,
    CASE WHEN amount < 0 THEN 'negative_transaction_amount' END,
    CASE WHEN label NOT IN (0, 1) THEN 'invalid_fraud_label' END,
    CASE WHEN scen NOT BETWEEN 0 AND 3 OR (label IN (0, 1) AND (scen > 0) <> (label = 1)) THEN 'invalid_fraud_scenario' END,
    CASE WHEN secs < 0 OR dys < 0 OR dys <> floor(secs / 86400) THEN 'inconsistent_time_fields' END,
    CASE WHEN CAST(moment AS DATE) <> source_file_date THEN 'source_date_mismatch' END], lambda x: x IS NOT NULL) AS reasons
  FROM typed
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY CASE WHEN len(reasons) = 0 THEN t_id END, len(reasons) = 0 ORDER BY source_file_date, source_row_number) AS nth FROM ruled
), judged AS (
  SELECT *, CASE WHEN len(reasons) = 0 AND nth > 1 THEN 'duplicate_transaction_id' ELSE array_to_string(reasons, ',') END AS rejection_reasons FROM ranked
)"""


@query(with_sql(JUDGED_SQL, """
SELECT t_id AS transaction_id, strftime(moment, '%Y-%m-%d %H:%M:%S') AS tx_datetime, c_id AS customer_id, e_id AS terminal_id, amount AS tx_amount,
       secs AS tx_time_seconds, dys AS tx_time_days, label AS tx_fraud, scen AS tx_fraud_scenario, source_file, source_file_date, source_row_number
FROM judged WHERE rejection_reasons = ''"""))
def silver_transactions(spark, sf_dir):
    """Accepted rows."""
    return plain(silver.validate_bronze(raw_bronze(spark, sf_dir)).silver.drop("ingested_at_utc"))


@query(with_sql(JUDGED_SQL, """
SELECT "TRANSACTION_ID", "CUSTOMER_ID", "TX_AMOUNT", source_file_date, source_row_number, rejection_reasons FROM judged WHERE rejection_reasons <> ''"""))
def silver_quarantine(spark, sf_dir):
    """Rejected rows with their reasons in order."""
    q = silver.validate_bronze(raw_bronze(spark, sf_dir)).quarantine
    return q.select("TRANSACTION_ID", "CUSTOMER_ID", "TX_AMOUNT", "source_file_date", "source_row_number", F.array_join("rejection_reasons", ",").alias("rejection_reasons"))


@query(with_sql(JUDGED_SQL + ", known AS (SELECT event_id FROM events WHERE event_id % 5 = 0)", """
SELECT reason, count(*) AS row_count FROM (
  SELECT CASE WHEN rejection_reasons = '' AND t_id IN (SELECT event_id FROM known) THEN 'duplicate_transaction_id' ELSE rejection_reasons END AS reason FROM judged)
GROUP BY 1"""))
def silver_reasons_with_known_ids(spark, sf_dir):
    """How often each outcome occurs if some ids are in Silver already."""
    known = transactions(spark, sf_dir).filter("transaction_id % 5 = 0").select("transaction_id")
    judged = silver.judge(raw_bronze(spark, sf_dir), known)
    return judged.groupBy(F.array_join("rejection_reasons", ",").alias("reason")).agg(F.count(F.lit(1)).alias("row_count"))


@query(with_sql(JUDGED_SQL + ", known AS (SELECT event_id FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-12' OR CAST(ts AS DATE) > DATE '2024-01-20')", """
SELECT DISTINCT t_id AS transaction_id FROM judged WHERE len(reasons) = 0 AND t_id IN (SELECT event_id FROM known)"""))
def known_ids_by_filters(spark, sf_dir):
    """Ids of new rows that finished days have, by their filters and a look at what these hit."""
    root = scratch(spark)
    days = F.col("source_file_date")
    finished = transactions(spark, sf_dir).filter((days < F.lit("2024-01-12").cast("date")) | (days > F.lit("2024-01-20").cast("date"))).select("transaction_id", "source_file_date")
    finished.write.partitionBy("source_file_date").parquet(f"{root}/silver")
    finished = spark.read.parquet(f"{root}/silver")
    known_ids.build_filters(finished).write.partitionBy("source_file_date").parquet(known_ids.filters_path(f"{root}/silver"))
    new = silver.apply_rules_once(raw_bronze(spark, sf_dir)).filter("valid_id is not null").select(F.col("valid_id").alias("transaction_id")).distinct()
    return known_ids.known_ids(spark, new, f"{root}/silver", finished.select("source_file_date").distinct())


# --- Gold --------------------------------------------------------------------

@query(with_sql(TX_SQL, """
SELECT transaction_id, CAST(tx_datetime AS DATE) AS transaction_date, CAST(hour(tx_datetime) AS BIGINT) AS transaction_hour, CAST(isodow(tx_datetime) - 1 AS BIGINT) AS day_of_week,
       CAST(isodow(tx_datetime) >= 6 AS BIGINT) AS is_weekend, CAST(hour(tx_datetime) BETWEEN 0 AND 5 AS BIGINT) AS is_night FROM tx"""))
def calendar_features(spark, sf_dir):
    """UTC date, hour, weekday, weekend and night."""
    return plain(transactions(spark, sf_dir).select("transaction_id", *(c.alias(n) for n, c in scalars.calendar_features(F.col("tx_datetime")).items())))


FEATURE_OUT = "transaction_id, tx_amount, tx_fraud, transaction_date, transaction_hour, day_of_week, is_weekend, is_night, customer_previous_transaction_count, customer_previous_mean_amount, amount_to_customer_previous_mean, terminal_previous_transaction_count"


@query(with_sql(FEATURES_SQL, f"""
SELECT {FEATURE_OUT} FROM (SELECT *, CASE WHEN customer_previous_mean_amount > 0 THEN tx_amount / customer_previous_mean_amount END AS amount_to_customer_previous_mean FROM features)"""))
def transaction_features(spark, sf_dir):
    """Point-in-time history of every transaction."""
    return plain(gold.transaction_features(transactions(spark, sf_dir)).selectExpr(*FEATURE_OUT.split(", ")))


@query(with_sql(SUMMARY_SQL, "SELECT * FROM customer_daily"))
def customer_daily_summary(spark, sf_dir):
    """A1."""
    return gold.daily_summary(transactions(spark, sf_dir).withColumn("transaction_date", F.to_date("tx_datetime")), "customer")


@query(with_sql(SUMMARY_SQL, "SELECT * FROM terminal_daily"))
def terminal_daily_summary(spark, sf_dir):
    """A2."""
    return gold.daily_summary(transactions(spark, sf_dir).withColumn("transaction_date", F.to_date("tx_datetime")), "terminal")


LATE_DAYS = "source_file_date IN (DATE '2024-01-06', DATE '2024-01-19')"


def gold_by_day(spark, sf_dir):
    """Gold in three runs: the days before the 16th, those from it on, and two late days between; rows are written by day first, as Silver is."""
    root = scratch(spark)
    transactions(spark, sf_dir).select(*SILVER.names).write.partitionBy("source_file_date").parquet(f"{root}/silver")
    rows = spark.read.parquet(f"{root}/silver").select(*SILVER.names)
    days = rows.select("source_file_date", F.expr(LATE_DAYS).alias("late"), (F.col("source_file_date") < "2024-01-16").alias("early")).distinct().collect()
    for run in ([d for d in days if d["early"] and not d["late"]], [d for d in days if not d["early"] and not d["late"]], days):
        gold_days.continue_days(spark, rows, [d["source_file_date"] for d in run], f"{root}/gold")
    return gold_days.open_gold(spark, f"{root}/gold")


@query(ORACLE_SQL["transaction_features"])
def continued_transaction_features(spark, sf_dir):
    """History of every transaction, continued from stored totals, with late days."""
    return plain(gold_by_day(spark, sf_dir).transaction_features.selectExpr(*FEATURE_OUT.split(", ")))


@query(with_sql(SUMMARY_SQL, """SELECT 'customer' AS entity, transaction_date, customer_id AS id, transaction_count, total_amount, fraud_count FROM customer_daily
UNION ALL SELECT 'terminal', transaction_date, terminal_id, transaction_count, total_amount, fraud_count FROM terminal_daily"""))
def continued_daily_summaries(spark, sf_dir):
    """A1, A2, K5: the summaries of the same three runs."""
    tables = gold_by_day(spark, sf_dir)
    parts = [getattr(tables, f"{e}_daily_summary").select(F.lit(e).alias("entity"), "transaction_date", F.col(f"{e}_id").alias("id"), "transaction_count", "total_amount", "fraud_count") for e in gold_days.ENTITIES]
    return parts[0].unionByName(parts[1])


# --- marts and data tests ----------------------------------------------------

def mart(spark, sf_dir, name):
    tx = transactions(spark, sf_dir).withColumn("transaction_date", F.to_date("tx_datetime"))
    tables = gold.GoldTables(tx, gold.daily_summary(tx, "customer"), gold.daily_summary(tx, "terminal"))
    frames = marts.mart_frames(tables)
    return frames if name is None else frames[name]


@query(with_sql(RISK_SQL, "SELECT * FROM daily"))
def fct_daily_fraud(spark, sf_dir):
    """A3."""
    return mart(spark, sf_dir, "fct_daily_fraud")


@query(with_sql(RISK_SQL, "SELECT * FROM customer_risk"))
def fct_customer_daily_risk(spark, sf_dir):
    """W1, P15."""
    return mart(spark, sf_dir, "fct_customer_daily_risk")


@query(with_sql(RISK_SQL, "SELECT * FROM terminal_risk"))
def fct_terminal_daily_risk(spark, sf_dir):
    """W2, P15."""
    return mart(spark, sf_dir, "fct_terminal_daily_risk")


@query(with_sql(RISK_SQL, "SELECT * FROM overview"))
def rpt_daily_fraud_overview(spark, sf_dir):
    """A4, J1."""
    return mart(spark, sf_dir, "rpt_daily_fraud_overview")


@query(with_sql(RISK_SQL, """
SELECT * FROM (VALUES ('daily_fraud_rate_valid', (SELECT count(*) FROM daily WHERE fraud_rate < 0 OR fraud_rate > 1)),
  ('transaction_id_unique', (SELECT count(*) FROM (SELECT transaction_id FROM tx GROUP BY 1 HAVING count(*) > 1))),
  ('tx_fraud_accepted', (SELECT count(*) FROM tx WHERE tx_fraud NOT IN (0, 1))),
  ('stg_customer_daily_summary_unique', (SELECT count(*) FROM (SELECT 1 FROM customer_daily GROUP BY transaction_date, customer_id HAVING count(*) > 1))),
  ('fct_terminal_daily_risk_unique', (SELECT count(*) FROM (SELECT 1 FROM terminal_risk GROUP BY transaction_date, terminal_id HAVING count(*) > 1))),
  ('daily_fraud_reconciles', (SELECT count(*) FROM daily d FULL JOIN (SELECT CAST(tx_datetime AS DATE) AS transaction_date, count(*) AS n FROM tx GROUP BY 1) e USING (transaction_date) WHERE d.transaction_count IS DISTINCT FROM e.n)),
  ('daily_risk_marts_reconcile', (SELECT count(*) FROM daily d FULL JOIN (SELECT transaction_date, sum(transaction_count) AS n FROM customer_risk GROUP BY 1) e USING (transaction_date) WHERE d.transaction_count IS DISTINCT FROM e.n)),
  ('daily_fraud_overview_valid', (SELECT count(*) FROM overview WHERE transaction_count <= 0 OR total_amount < 0 OR fraud_count NOT BETWEEN 0 AND transaction_count OR fraud_rate NOT BETWEEN 0 AND 1
    OR active_customer_count <= 0 OR customers_with_fraud NOT BETWEEN 0 AND active_customer_count OR (fraud_count > 0) <> (customers_with_fraud > 0)
    OR active_terminal_count <= 0 OR terminals_with_fraud NOT BETWEEN 0 AND active_terminal_count OR (fraud_count > 0) <> (terminals_with_fraud > 0))),
  ('daily_risk_metrics_valid', (SELECT count(*) FROM (SELECT * EXCLUDE (customer_id, maximum_amount) FROM customer_risk UNION ALL BY NAME SELECT * EXCLUDE (terminal_id, unique_customers) FROM terminal_risk) WHERE transaction_count <= 0 OR total_amount < 0
    OR fraud_count NOT BETWEEN 0 AND transaction_count OR fraud_rate NOT BETWEEN 0 AND 1 OR rolling_7d_transaction_count < transaction_count OR rolling_7d_total_amount < 0
    OR rolling_7d_fraud_count NOT BETWEEN fraud_count AND rolling_7d_transaction_count OR rolling_7d_fraud_rate NOT BETWEEN 0 AND 1)),
  ('transaction_id_not_null', (SELECT count(*) FROM tx WHERE transaction_id IS NULL)),
  ('daily_fraud_date_unique', (SELECT count(*) FROM (SELECT 1 FROM daily GROUP BY transaction_date HAVING count(*) > 1))),
  ('overview_date_unique', (SELECT count(*) FROM (SELECT 1 FROM overview GROUP BY transaction_date HAVING count(*) > 1))),
  ('stg_terminal_daily_summary_unique', (SELECT count(*) FROM (SELECT 1 FROM terminal_daily GROUP BY transaction_date, terminal_id HAVING count(*) > 1))),
  ('fct_customer_daily_risk_unique', (SELECT count(*) FROM (SELECT 1 FROM customer_risk GROUP BY transaction_date, customer_id HAVING count(*) > 1))),
  ('stg_customer_daily_summary_customer_not_null', (SELECT count(*) FROM customer_daily WHERE customer_id IS NULL)),
  ('stg_terminal_daily_summary_terminal_not_null', (SELECT count(*) FROM terminal_daily WHERE terminal_id IS NULL)),
  ('fct_customer_daily_risk_customer_not_null', (SELECT count(*) FROM customer_risk WHERE customer_id IS NULL)),
  ('fct_terminal_daily_risk_terminal_not_null', (SELECT count(*) FROM terminal_risk WHERE terminal_id IS NULL))
) AS t("check", violations)"""))
def data_test_violations(spark, sf_dir):
    """Rows that break each invariant of the marts, all data tests."""
    return checks.violation_counts(mart(spark, sf_dir, None))


@query(with_sql(RISK_SQL + """,
broken AS (SELECT * REPLACE (CASE WHEN day(transaction_date) = 3 THEN fraud_count + 1 ELSE fraud_count END AS fraud_count) FROM daily WHERE day(transaction_date) <> 5),
sums AS (SELECT transaction_date, sum(fraud_count) AS f, sum(transaction_count) AS n FROM customer_risk GROUP BY 1)""", """
SELECT coalesce(b.transaction_date, s.transaction_date) AS transaction_date FROM broken b FULL JOIN sums s ON b.transaction_date = s.transaction_date
WHERE b.fraud_count IS DISTINCT FROM s.f OR b.transaction_count IS DISTINCT FROM s.n"""))
def reconciliation_of_broken_mart(spark, sf_dir):
    """The days on which a mart with planted errors disagrees with the others."""
    frames = mart(spark, sf_dir, None)
    day = F.dayofmonth("transaction_date")
    broken = frames["fct_daily_fraud"].filter(day != 5).withColumn("fraud_count", F.col("fraud_count") + F.when(day == 3, 1).otherwise(0))
    return checks.unreconciled_risk(broken, frames["fct_customer_daily_risk"], frames["fct_terminal_daily_risk"])


@query(with_sql(RISK_SQL, """
SELECT 'customer' AS entity_type, transaction_date, customer_id AS entity_id FROM customer_risk WHERE rolling_7d_fraud_count - 1 < fraud_count
UNION ALL
SELECT 'terminal', transaction_date, terminal_id FROM terminal_risk WHERE rolling_7d_fraud_count - 1 < fraud_count"""))
def invalid_risk_of_broken_marts(spark, sf_dir):
    """Rolling counts that were lowered by one and so fall below the day's."""
    frames = mart(spark, sf_dir, None)
    lower = lambda df: df.withColumn("rolling_7d_fraud_count", F.col("rolling_7d_fraud_count") - 1)
    return checks.invalid_risk(lower(frames["fct_customer_daily_risk"]), lower(frames["fct_terminal_daily_risk"]))


# --- event stream, on batches ------------------------------------------------

def messages(spark, sf_dir, rows=None):
    """The transactions as Kafka-shaped messages, some of them spoilt."""
    rows = raw_bronze(spark, sf_dir) if rows is None else rows
    sent = events.build_messages(rows, datetime(2024, 6, 1, tzinfo=timezone.utc), "transactions")
    n = F.col("source_row_number")
    value = F.when(n % 101 == 0, F.lit("{not json").cast("binary")).otherwise(F.col("value"))
    key = F.when(n % 103 == 0, F.lit("1").cast("binary")).otherwise(F.col("key"))
    return sent.select(key.alias("key"), value.alias("value"), "topic", F.lit(0).alias("partition"), n.alias("offset"), F.to_timestamp(F.lit("2024-06-01 00:00:00")).alias("timestamp"))


@query(with_sql(TX_SQL, """
SELECT transaction_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS event_id
FROM (SELECT transaction_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('riskweave://transactions/' || source_file || '#' || source_row_number)) AS h FROM tx)"""))
def event_ids(spark, sf_dir):
    """version-5 UUIDs."""
    return transactions(spark, sf_dir).select("transaction_id", scalars.event_id(F.col("source_file"), F.col("source_row_number")).alias("event_id"))


@query(with_sql(RAW_SQL, """
SELECT source_row_number, "TRANSACTION_ID" AS message_key, "TX_AMOUNT" AS tx_amount, "CUSTOMER_ID" AS customer_id, source_file, CAST(source_file_date AS VARCHAR) AS source_file_date FROM raw"""))
def event_round_trip(spark, sf_dir):
    """What comes out of the messages that were built."""
    sent = events.build_messages(raw_bronze(spark, sf_dir), datetime(2024, 6, 1, tzinfo=timezone.utc), "transactions")
    shaped = sent.withColumns({"partition": F.lit(0), "offset": F.col("source_row_number"), "timestamp": F.lit(None).cast("timestamp")})
    flat = events.flatten_events(events.parse_messages(shaped))
    return flat.select("source_row_number", F.col("kafka_key").alias("message_key"), F.col("TX_AMOUNT").alias("tx_amount"), F.col("CUSTOMER_ID").alias("customer_id"), "source_file", "source_file_date")


STREAM_SQL = JUDGED_SQL + """,
streamed AS (
  SELECT source_row_number AS n, CASE WHEN source_row_number % 101 = 0 THEN 'invalid_event_json'
    ELSE array_to_string(list_concat(reasons, CASE WHEN source_row_number % 103 = 0 AND t_id <> 1 THEN ['kafka_key_mismatch'] ELSE [] END), ',') END AS rejection_reasons, t_id, amount
  FROM judged
)"""


@query(with_sql(STREAM_SQL, "SELECT n AS kafka_offset, rejection_reasons FROM streamed"))
def stream_rejection_reasons(spark, sf_dir):
    """The reasons of every message."""
    return events.judged_messages(messages(spark, sf_dir)).select("kafka_offset", F.array_join("rejection_reasons", ",").alias("rejection_reasons"))


@query(with_sql(STREAM_SQL, "SELECT t_id AS transaction_id, amount AS tx_amount, n AS kafka_offset FROM streamed WHERE rejection_reasons = ''"))
def stream_silver(spark, sf_dir):
    """Valid messages as Silver events, before de-duplication."""
    return events.silver_events(events.judged_messages(messages(spark, sf_dir)).filter("is_valid")).select("transaction_id", "tx_amount", "kafka_offset")


@query(with_sql(STREAM_SQL, "SELECT n AS kafka_offset, rejection_reasons, 'transactions' AS kafka_topic FROM streamed WHERE rejection_reasons <> ''"))
def stream_quarantine(spark, sf_dir):
    """Rejected messages."""
    q = events.quarantine_events(events.judged_messages(messages(spark, sf_dir)).filter("not is_valid"))
    return q.select("kafka_offset", F.array_join("rejection_reasons", ",").alias("rejection_reasons"), "kafka_topic")


@query(with_sql(RAW_SQL, "SELECT CASE WHEN source_row_number % 103 = 0 THEN '1' ELSE \"TRANSACTION_ID\" END AS kafka_key, source_row_number AS kafka_offset, 'transactions' AS kafka_topic FROM raw"))
def stream_bronze(spark, sf_dir):
    """Messages as they came."""
    return events.bronze_events(events.parse_messages(messages(spark, sf_dir))).select("kafka_key", "kafka_offset", "kafka_topic")


def windows_sql(entity: str, other: str) -> str:
    return with_sql(TX_SQL, f"""
SELECT strftime(time_bucket(INTERVAL 1 HOUR, tx_datetime), '%Y-%m-%d %H:%M:%S') AS window_start, {entity}_id, count(*) AS transaction_count,
       CAST(sum(CAST(tx_amount AS DECIMAL(18,4))) AS DOUBLE) AS total_amount, max(tx_amount) AS maximum_amount, count(DISTINCT {other}_id) AS distinct_{other}_count,
       count(*) FILTER (hour(tx_datetime) BETWEEN 0 AND 5) AS night_transaction_count
FROM tx GROUP BY 1, 2""")


def windows(spark, sf_dir, entity: str, other: str) -> DataFrame:
    rows = transactions(spark, sf_dir).withColumn("tx_amount", F.col("tx_amount").cast("decimal(18,4)"))
    out = risk.risk_windows(rows, entity, watermark=None, exact_distinct=True)
    out = out.withColumns({"total_amount": F.col("total_amount").cast("double"), "maximum_amount": F.col("maximum_amount").cast("double")})
    return plain(out.select("window_start", f"{entity}_id", "transaction_count", "total_amount", "maximum_amount", f"distinct_{other}_count", "night_transaction_count"))


@query(windows_sql("customer", "terminal"))
def customer_risk_windows(spark, sf_dir):
    """A7, T4, P11."""
    return windows(spark, sf_dir, "customer", "terminal")


@query(windows_sql("terminal", "customer"))
def terminal_risk_windows(spark, sf_dir):
    """A8, T4, P11."""
    return windows(spark, sf_dir, "terminal", "customer")


@query(with_sql(TX_SQL, """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, tx_datetime), '%Y-%m-%d %H:%M:%S') AS window_start, customer_id, count(*) AS transaction_count, count(DISTINCT terminal_id) AS exact_terminals, true AS within_bound
FROM tx GROUP BY 1, 2"""))
def approximate_risk_windows(spark, sf_dir):
    """The windows as the stream computes them; their approximate counts lie within four deviations of the exact ones."""
    return approximate_windows(spark, sf_dir, "customer", "terminal")


def approximate_windows(spark, sf_dir, entity: str, other: str) -> DataFrame:
    tx, place = transactions(spark, sf_dir), ("window_start", f"{entity}_id")
    near = risk.risk_windows(tx, entity, watermark=None).select(*place, "transaction_count", F.col(f"approx_unique_{other}s").alias("near"))
    exact = risk.risk_windows(tx, entity, watermark=None, exact_distinct=True).select(*(F.col(c).alias(f"_{c}") for c in place), F.col(f"distinct_{other}_count").alias("exact"))
    both = near.join(exact, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place])
    within = F.abs(F.col("near") - F.col("exact")) <= F.ceil(4 * risk.DISTINCT_ERROR * F.col("exact"))
    return plain(both.select(*place, "transaction_count", F.col("exact").alias(f"exact_{other}s"), within.alias("within_bound")))


@query(with_sql(TX_SQL, """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, tx_datetime), '%Y-%m-%d %H:%M:%S') AS window_start, terminal_id, count(*) AS transaction_count, count(DISTINCT customer_id) AS exact_customers, true AS within_bound
FROM tx GROUP BY 1, 2"""))
def approximate_terminal_windows(spark, sf_dir):
    """The same of the terminals' side."""
    return approximate_windows(spark, sf_dir, "terminal", "customer")


#: crc32 of the bytes of a key, by a table of 256 values.
CRC_SQL = """,
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (
  SELECT "TRANSACTION_ID" AS message_key, source_file_date, source_row_number, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(coalesce("TRANSACTION_ID", '')))),
    lambda i: CAST('0x' || substr(hex(encode("TRANSACTION_ID")), 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(t[CAST(xor(c & 255, b) AS INTEGER) + 1], c >> 8))) % 3 AS partition FROM raw, crc
)"""


@query(with_sql(RAW_SQL + CRC_SQL, """
SELECT message_key, source_row_number, CAST(partition AS BIGINT) AS partition, row_number() OVER (PARTITION BY partition ORDER BY source_file_date, source_row_number) - 1 AS "offset" FROM keyed"""))
def replayed_offsets(spark, sf_dir):
    """Offsets that a stream over a replayed log delivers in batches, stopped once and resumed."""
    root, rows = scratch(spark), raw_bronze(spark, sf_dir)
    log = replay.write_log(rows, f"{root}/log", produced_at=datetime(2024, 6, 1, tzinfo=timezone.utc), topic="transactions", segment_events=2_000)
    batch = -(-log.events // 7)  # batches end inside segments
    for end in (log.events // 2, None):
        stream = replay.replayed_messages(log, spark, progress=f"{root}/checkpoints/progress.json", events_per_second=0, max_events=end or None, batch_events=batch)
        running = ingest.start_queries({"replayed": stream}, ingest.StreamPaths(f"{root}/out", f"{root}/checkpoints"), prefix=f"replay-{root[-8:]}", trigger="0 seconds")
        for one in running.values():
            one.processAllAvailable()
            one.stop()
    flat = events.flatten_events(events.parse_messages(spark.read.parquet(f"{root}/out/replayed")))
    return plain(flat.select(F.col("kafka_key").alias("message_key"), "source_row_number", F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset")))


@query(with_sql(STREAM_SQL, "SELECT DISTINCT t_id AS transaction_id FROM streamed WHERE rejection_reasons = ''"))
def stream_deduplicated(spark, sf_dir):
    """The ids that a real stream over message files writes to Silver."""
    root = scratch(spark)
    messages(spark, sf_dir).write.parquet(f"{root}/messages")
    valid = events.judged_messages(ingest.file_messages(spark, f"{root}/messages")).filter("is_valid")
    frames = {"silver": events.silver_events(events.deduplicate(valid))}
    ingest.drain(ingest.start_queries(frames, ingest.StreamPaths(f"{root}/out", f"{root}/checkpoints"), prefix=f"dedup-{root[-8:]}", trigger=None).values())
    return spark.read.parquet(f"{root}/out/silver").select("transaction_id")


@query(with_sql(TX_SQL + ", m AS (SELECT max(tx_datetime) - INTERVAL 10 MINUTES AS mark FROM tx)", """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, tx_datetime), '%Y-%m-%d %H:%M:%S') AS window_start, customer_id, count(*) AS transaction_count, max(tx_amount) AS maximum_amount,
       count(*) FILTER (hour(tx_datetime) BETWEEN 0 AND 5) AS night_transaction_count
FROM tx, m WHERE time_bucket(INTERVAL 1 HOUR, tx_datetime) + INTERVAL 1 HOUR <= mark GROUP BY 1, 2"""))
def stream_closed_windows(spark, sf_dir):
    """The windows that a real stream emits once the watermark has passed them."""
    root = scratch(spark)
    transactions(spark, sf_dir).write.parquet(f"{root}/silver")
    stream = spark.readStream.schema(spark.read.parquet(f"{root}/silver").schema).parquet(f"{root}/silver")
    frames = {"windows": risk.risk_windows(stream, "customer")}
    ingest.drain(ingest.start_queries(frames, ingest.StreamPaths(f"{root}/out", f"{root}/checkpoints"), prefix=f"windows-{root[-8:]}", trigger=None).values())
    return plain(spark.read.parquet(f"{root}/out/windows").select("window_start", "customer_id", "transaction_count", "maximum_amount", "night_transaction_count"))


#: Messages in a file of a batch; more of them are more files.
MESSAGES_A_FILE = 200_000


@query(with_sql(STREAM_SQL, "SELECT DISTINCT t_id AS transaction_id FROM streamed WHERE rejection_reasons = '' AND t_id NOT IN (SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-06' AND event_id % 7 = 0)"))
def stream_late_rows_and_restarts(spark, sf_dir):
    """What a stream that is stopped twice keeps: nothing is repeated after a restart, and rows behind the watermark are dropped."""
    root, rows = scratch(spark), raw_bronze(spark, sf_dir)
    files_a_batch = max(2 * spark.sparkContext.defaultParallelism, -(-transactions(spark, sf_dir).count() // MESSAGES_A_FILE))  # a file is written and read by a task
    late = F.coalesce((F.col("TX_DATETIME") < "2024-01-06") & (F.col("TRANSACTION_ID").try_cast("long") % 7 == 0), F.lit(False))
    early = F.coalesce(F.col("TX_DATETIME") < "2024-01-16", F.lit(False))
    for phase in (early & ~late, ~early & ~late, late):  # a phase is one batch of its files
        messages(spark, sf_dir, rows.filter(phase)).repartition(files_a_batch, "offset").write.mode("append").parquet(f"{root}/messages")
        valid = events.judged_messages(ingest.file_messages(spark, f"{root}/messages", max_files=files_a_batch)).filter("is_valid")
        frames = {"silver": events.silver_events(events.deduplicate(valid))}
        ingest.drain(ingest.start_queries(frames, ingest.StreamPaths(f"{root}/out", f"{root}/checkpoints"), prefix=f"late-{root[-8:]}", trigger=None).values())
    return spark.read.parquet(f"{root}/out/silver").select("transaction_id")


# --- model dataset and evaluation --------------------------------------------

DATASET_SQL = FEATURES_SQL + """,
named AS (SELECT *, CASE WHEN tx_datetime < TIMESTAMP '2024-01-15' THEN 'train' WHEN tx_datetime < TIMESTAMP '2024-01-22' THEN 'validation' ELSE 'test' END AS split FROM features)"""


def model_rows(spark, sf_dir):
    return gold.transaction_features(transactions(spark, sf_dir))


def stored(rows: DataFrame) -> DataFrame:
    """Rows written once, for steps that pass over them many times; as Gold's tables are, so histories are built once."""
    path = f"{scratch(rows.sparkSession)}/rows"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@query(with_sql(DATASET_SQL, "SELECT split, count(*) AS row_count, CAST(sum(tx_fraud) AS BIGINT) AS fraud_count FROM named GROUP BY 1"))
def dataset_split_counts(spark, sf_dir):
    """V18, A12."""
    return dataset.split_counts(transactions(spark, sf_dir), TRAIN_END, VALIDATION_END)


@query(with_sql(DATASET_SQL, """
SELECT transaction_id, customer_id, tx_amount, customer_previous_transaction_count, tx_fraud FROM named WHERE split = 'validation'"""))
def dataset_validation_split(spark, sf_dir):
    """The checked dataset's validation rows."""
    part = dataset.split_dataset(dataset.build_dataset(stored(model_rows(spark, sf_dir))), TRAIN_END, VALIDATION_END)["validation"]
    return plain(part.select("transaction_id", "customer_id", "tx_amount", "customer_previous_transaction_count", "tx_fraud"))


@query(with_sql(SCORED_SQL + """,
bs AS (SELECT score, sum(tx_fraud) AS pos, sum(1 - tx_fraud) AS neg FROM scored GROUP BY 1),
cum AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM bs)""", """
SELECT round(sum(CAST(pos AS DOUBLE) * tp / (tp + fp)) / sum(pos), 9) AS average_precision,
       round(sum(CAST(neg AS DOUBLE) * (2 * (tp - pos) + pos)) / 2 / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 9) AS roc_auc FROM cum"""))
def ranking_metrics(spark, sf_dir):
    """M5, M6, W9."""
    out = metrics.ranking_metrics(scored(transactions(spark, sf_dir)))
    return out.select(F.round("average_precision", 9).alias("average_precision"), F.round("roc_auc", 9).alias("roc_auc"))


@query(with_sql(SCORED_SQL + f""",
c AS (SELECT count(*) FILTER (score < {THRESHOLD} AND tx_fraud = 0) AS true_negatives, count(*) FILTER (score >= {THRESHOLD} AND tx_fraud = 0) AS false_positives,
             count(*) FILTER (score < {THRESHOLD} AND tx_fraud = 1) AS false_negatives, count(*) FILTER (score >= {THRESHOLD} AND tx_fraud = 1) AS true_positives FROM scored)""", """
SELECT *, coalesce(true_positives / nullif(CAST(true_positives + false_positives AS DOUBLE), 0), 0) AS precision,
       coalesce(true_positives / nullif(CAST(true_positives + false_negatives AS DOUBLE), 0), 0) AS recall,
       coalesce(2 * true_positives / nullif(CAST(2 * true_positives + false_positives + false_negatives AS DOUBLE), 0), 0) AS f1 FROM c"""))
def confusion_at_threshold(spark, sf_dir):
    """M4, A11, V21."""
    return metrics.confusion(scored(transactions(spark, sf_dir)), THRESHOLD)


@query(with_sql(SCORED_SQL, "SELECT * FROM cards"))
def card_days(spark, sf_dir):
    """A9."""
    return plain(thresholds.card_days(scored(transactions(spark, sf_dir))))


@query(with_sql(SCORED_SQL, f"""
SELECT transaction_date, score AS boundary_score FROM (SELECT *, row_number() OVER (PARTITION BY transaction_date ORDER BY score DESC, customer_id) AS r FROM cards) WHERE r = {CAPACITY + 1}"""))
def capacity_boundaries(spark, sf_dir):
    """W8, M14."""
    return thresholds.daily_boundaries(thresholds.card_days(scored(transactions(spark, sf_dir))), CAPACITY)


@query(with_sql(SCORED_SQL + f", d AS (SELECT transaction_date, count(*) FILTER (score >= {THRESHOLD}) AS n FROM cards GROUP BY 1)", f"""
SELECT CAST(sum(n) AS BIGINT) AS alerts, CAST(sum(n) AS DOUBLE) / count(*) AS mean_daily_card_alerts, max(n) AS max_daily_card_alerts, count(*) FILTER (n > {CAPACITY}) AS budget_exceeded_days FROM d"""))
def alert_load(spark, sf_dir):
    """A10, M15."""
    return thresholds.alert_load(thresholds.card_days(scored(transactions(spark, sf_dir))), THRESHOLD, CAPACITY)


@query(with_sql(SCORED_SQL, f"""
SELECT transaction_date, customer_id, score FROM (
  SELECT transaction_date, customer_id, max(score) AS score, min({{'moment': tx_datetime, 'id': transaction_id}}) AS place FROM scored GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY transaction_date ORDER BY score DESC, place, customer_id) <= {CAPACITY}"""))
def top_cards_per_day(spark, sf_dir):
    """The highest cards of every day; of equal ones those that come first."""
    return thresholds.top_cards_per_day(thresholds.card_days(scored(transactions(spark, sf_dir)), place=True), CAPACITY)


@query(with_sql(SCORED_SQL + f""",
b AS (SELECT max(score) AS s FROM (SELECT *, row_number() OVER (PARTITION BY transaction_date ORDER BY score DESC, customer_id) AS r FROM cards) WHERE r = {CAPACITY + 1}),
p AS (SELECT coalesce(nextafter(CAST(s AS DOUBLE), CAST(2 AS DOUBLE)), 0.0) AS threshold FROM b),
c AS (SELECT count(*) FILTER (score >= threshold AND tx_fraud = 0) AS fp, count(*) FILTER (score < threshold AND tx_fraud = 1) AS fn, count(*) FILTER (score >= threshold AND tx_fraud = 1) AS tp FROM cards, p),
d AS (SELECT transaction_date, count(*) FILTER (score >= threshold) AS n FROM cards, p GROUP BY 1)""", f"""
SELECT CAST(threshold AS DOUBLE) AS threshold, CAST({CAPACITY} AS BIGINT) AS daily_card_capacity, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall,
       coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1, CAST(sum(n) AS BIGINT) AS alerts, CAST(sum(n) AS DOUBLE) / count(*) AS mean_daily_card_alerts, max(n) AS max_daily_card_alerts,
       count(*) FILTER (n > {CAPACITY}) AS budget_exceeded_days
FROM d, c, p GROUP BY threshold, tp, fp, fn"""))
def capacity_policy(spark, sf_dir):
    """The threshold that keeps every day within capacity, with its metrics."""
    found = thresholds.capacity_threshold(scored(transactions(spark, sf_dir)), CAPACITY)
    return spark.createDataFrame([found.as_dict()], "threshold double, daily_card_capacity long, precision double, recall double, f1 double, alerts long, mean_daily_card_alerts double, max_daily_card_alerts long, budget_exceeded_days long")


@query("WITH RECURSIVE" + with_sql(SCORED_SQL + """,
best AS (SELECT transaction_date, customer_id, max(tx_fraud) AS fraud, max(score) AS s, min({'t': tx_datetime, 'i': transaction_id}) AS place FROM scored GROUP BY 1, 2),
days AS (SELECT transaction_date, row_number() OVER (ORDER BY transaction_date) AS d, list({'id': customer_id, 'fraud': fraud} ORDER BY s DESC, place, customer_id) AS ranked FROM best GROUP BY 1),
walk(d, caught, hits) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(0 AS BIGINT)
  UNION ALL
  SELECT n.d, list_concat(caught, found), hits + len(found) FROM (
    SELECT days.d, w.caught, w.hits, list_transform(list_filter(list_filter(days.ranked, lambda x: NOT list_contains(w.caught, x.id))[1:""" + str(CAPACITY) + """], lambda x: x.fraud = 1), lambda x: x.id) AS found
    FROM walk w JOIN days ON days.d = w.d + 1) n
)""", f"SELECT CAST(hits AS DOUBLE) / ({CAPACITY} * d) AS card_precision_at_k FROM walk ORDER BY d DESC LIMIT 1").removeprefix("WITH"))
def card_precision_at_k(spark, sf_dir):
    """Card Precision@k with caught cards left out."""
    return spark.createDataFrame([(tuning.card_precision_at_k(scored(transactions(spark, sf_dir)), CAPACITY),)], "card_precision_at_k double")


@query(with_sql(TX_SQL + ", b AS (SELECT CAST(max(tx_datetime) AS DATE) + 1 AS e FROM tx), f AS (SELECT i AS fold, CAST(e - 3 * (3 - i) - 2 AS TIMESTAMP) AS t, CAST(e - 3 * (3 - i) AS TIMESTAMP) AS s, CAST(e - 3 * (2 - i) AS TIMESTAMP) AS n FROM b, (VALUES (1), (2)) v(i))", """
SELECT CAST(fold AS BIGINT) AS fold, count(*) FILTER (tx_datetime < t) AS train_rows, count(*) FILTER (tx_datetime >= s AND tx_datetime < n) AS assess_rows FROM tx, f GROUP BY 1"""))
def fold_sizes(spark, sf_dir):
    """Rows of two prequential folds."""
    tx = transactions(spark, sf_dir)
    folds = tuning.prequential_folds(tx, folds=2, assessment_days=3, gap_days=2)
    rows = [f.train(tx).agg(F.count(F.lit(1)).alias("train_rows")).crossJoin(f.assess(tx).agg(F.count(F.lit(1)).alias("assess_rows"))).select(F.lit(f.number).cast("bigint").alias("fold"), "train_rows", "assess_rows") for f in folds]
    return rows[0].unionByName(rows[1])


@query(with_sql(FEATURES_SQL, """
SELECT median(tx_amount) AS median_amount, median(terminal_previous_transaction_count) AS median_terminal_count, count(*) FILTER (tx_fraud = 0) AS negatives, count(*) FILTER (tx_fraud = 1) AS positives FROM features"""))
def preprocessing_statistics(spark, sf_dir):
    """Exact medians and class counts."""
    columns = ["tx_amount", "terminal_previous_transaction_count"]
    df = stored(model_rows(spark, sf_dir).select(*columns, "tx_fraud"))
    return spark.createDataFrame([(*models.exact_quantiles(df, columns, 0.5), *models.class_counts(df))], "median_amount double, median_terminal_count double, negatives long, positives long")


@query(with_sql(SCORED_SQL + f", n AS (SELECT count(*) AS scored, count(*) FILTER (score >= {THRESHOLD}) AS alerts FROM scored), b(upper_bound) AS (VALUES " + ", ".join(f"(CAST({b} AS DOUBLE))" for b in metrics.SCORE_BUCKETS) + ")", """
SELECT b.upper_bound, count(*) FILTER (s.score <= b.upper_bound) AS row_count, any_value(n.alerts) AS alerts, any_value(n.scored) AS scored FROM b, scored s, n GROUP BY 1"""))
def score_histogram(spark, sf_dir):
    """Cumulative score counts."""
    return metrics.score_histogram(scored(transactions(spark, sf_dir)), THRESHOLD)


#: Candidate cuts of the boosting query, per column.
BOOST_CUTS = {"tx_amount": [20.0, 60.0, 120.0, 240.0, 480.0], "transaction_hour": [6.0, 12.0, 18.0], "customer_previous_transaction_count": [2.0, 5.0, 9.0], "terminal_previous_transaction_count": [4.0, 8.0, 16.0, 32.0]}
BOOST = {"n_estimators": 3, "max_depth": 2, "learning_rate": 0.3, "min_child_weight": 5.0, "reg_alpha": 0.01, "reg_lambda": 5.0}


CAST_DOUBLE = "CAST({} AS DOUBLE)"


def boosting_sql() -> tuple[str, str]:
    """The same trees grown by joins of rows with cuts: histograms, gains, best splits and leaves, level by level."""
    names = list(BOOST_CUTS)
    alpha, ridge, least, rate = (CAST_DOUBLE.format(BOOST[k]) for k in ("reg_alpha", "reg_lambda", "min_child_weight", "learning_rate"))
    value = "CASE f " + " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(names)) + " END"
    soft = lambda g: f"(sign({g}) * greatest(abs({g}) - {alpha}, 0))"
    part = lambda g, h: f"({soft(g)} * {soft(g)} / ({h} + {ridge}))"
    unit = CAST_DOUBLE.format(2**30)
    cuts = ", ".join(f"({i}, {CAST_DOUBLE.format(c)})" for i, n in enumerate(names) for c in BOOST_CUTS[n])
    ctes = [f"cuts(f, cut) AS (VALUES {cuts})", f"m0 AS (SELECT tx_fraud AS y, {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in names)}, CAST(0 AS DOUBLE) AS margin FROM features)"]
    out = []
    for t in range(BOOST["n_estimators"]):
        p = "(1 / (1 + exp(-margin)))"
        ctes.append(f"r{t}_0 AS (SELECT *, floor(({p} - y) * {unit}) / {unit} AS g, floor({p} * (1 - {p}) * {unit}) / {unit} AS h, 0 AS node, true AS open FROM m{t})")
        for d in range(BOOST["max_depth"]):
            ctes.append(f"b{t}_{d} AS (SELECT *, 0.5 * ({part('gl', 'hl')} + {part('(gt - gl)', '(ht - hl)')} - {part('gt', 'ht')}) AS gain FROM (SELECT node, f, cut, sum(g) FILTER ({value} < cut) AS gl, sum(h) FILTER ({value} < cut) AS hl, sum(g) AS gt, sum(h) AS ht FROM r{t}_{d}, cuts WHERE open GROUP BY 1, 2, 3) WHERE hl >= {least} AND ht - hl >= {least})")
            ctes.append(f"s{t}_{d} AS (SELECT * FROM b{t}_{d} WHERE gain > 1e-6 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, cut) = 1)")
            ctes.append(f"r{t}_{d + 1} AS (SELECT r.* EXCLUDE (node, open), CASE WHEN s.node IS NULL THEN 2 * r.node + 1 ELSE 2 * r.node + 1 + CAST({value} >= cut AS INTEGER) END AS node, s.node IS NOT NULL AS open FROM r{t}_{d} r LEFT JOIN s{t}_{d} s ON r.open AND s.node = r.node)")
            out.append(f"SELECT {t} AS tree, node, {names}[f + 1] AS feature, cut, round(gain, 6) AS gain, CAST(NULL AS DOUBLE) AS weight FROM s{t}_{d}")
        last = f"r{t}_{BOOST['max_depth']}"
        ctes.append(f"l{t} AS (SELECT node, -{soft('sum(g)')} / (sum(h) + {ridge}) AS weight FROM {last} GROUP BY 1)")
        ctes.append(f"m{t + 1} AS (SELECT r.* EXCLUDE (node, open, g, h, margin), margin + {rate} * weight AS margin FROM {last} r JOIN l{t} USING (node))")
        out.append(f"SELECT {t}, node, NULL, NULL, NULL, round(weight, 6) FROM l{t}")
    return FEATURES_SQL.strip() + ",\n" + ",\n".join(ctes), "\nUNION ALL ".join(out)


@query(with_sql(*boosting_sql()))
def boosted_splits(spark, sf_dir):
    """Splits, gains and leaf weights of boosted trees with L1 and L2 terms."""
    rows = stored(model_rows(spark, sf_dir).select(*BOOST_CUTS, "tx_fraud"))
    model = boosting.fit(rows, list(BOOST_CUTS), "tx_fraud", cuts=list(BOOST_CUTS.values()), **BOOST)
    inner = 2**model.depth - 1
    found = [(i, n, model.columns[t.feature[n]], t.cut[n], t.gain[n], None) for i, t in enumerate(model.trees) for n in range(inner) if t.gain[n] > 0]
    splits = spark.createDataFrame(found, "tree long, node long, feature string, cut double, gain double, weight double")
    weights = F.array(*(F.array(*map(F.lit, t.weight)) for t in model.trees))
    leaves = boosting.binned(rows, model.columns, list(BOOST_CUTS.values())).select(F.posexplode(F.array(*(boosting.leaf_of(t, model.depth) for t in model.trees))).alias("tree", "node")).distinct()
    leaves = leaves.select(F.col("tree").cast("long"), F.col("node").cast("long"), F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("cut"), F.lit(None).cast("double").alias("gain"), weights[F.col("tree")][F.col("node") - inner].alias("weight"))
    return splits.union(leaves).withColumns({c: F.round(c, 6) for c in ("gain", "weight")})


@query()
def logistic_scores(spark, sf_dir):
    """A logistic model fitted on the training split, applied to the test split."""
    parts = dataset.split_dataset(dataset.build_dataset(stored(model_rows(spark, sf_dir))), TRAIN_END, VALIDATION_END)
    model = models.fit_model("logistic_regression", models.BASELINES["logistic_regression"], parts["train"])
    return model.score(parts["test"]).select("transaction_id", "score")


@query(with_sql(FEATURES_SQL, "SELECT transaction_id, customer_id, tx_amount, transaction_hour FROM features WHERE transaction_id > 0 AND customer_id > 0 AND terminal_id > 0"))
def scoring_requests(spark, sf_dir):
    """Validated scoring requests."""
    rows = model_rows(spark, sf_dir).filter("transaction_id > 0 and customer_id > 0 and terminal_id > 0")
    checked = policy.validate_requests(stored(rows.select(*policy.IDENTITY, *MODEL_FEATURES)), max_rows=None)
    return plain(checked.select("transaction_id", "customer_id", "tx_amount", "transaction_hour"))


REQUEST_ROWS_SQL = FEATURES_SQL + """,
lines AS (
  SELECT CAST(transaction_id // 50 AS VARCHAR) AS request_id, transaction_id, CASE WHEN transaction_id % 499 = 3 THEN -1.0 ELSE tx_amount END AS tx_amount,
         CASE WHEN transaction_id % 311 = 4 THEN 24 ELSE transaction_hour END AS transaction_hour, copy
  FROM features, (VALUES (0), (1)) c(copy) WHERE transaction_id > 0 AND customer_id > 0 AND terminal_id > 0 AND (copy = 0 OR transaction_id % 401 = 5)
), requests AS (
  SELECT request_id, bool_or(copy = 1) AS repeated, bool_or(tx_amount < 0) AS negative, bool_or(transaction_hour > 23) AS hour FROM lines GROUP BY 1
), predictions AS (
  SELECT request_id, transaction_id, least(tx_amount / 500, 1.0) AS p FROM lines WHERE request_id NOT IN (SELECT request_id FROM requests WHERE repeated OR negative OR hour)
)"""


def request_rows(spark, sf_dir) -> DataFrame:
    """Requests of at most 50 neighbouring ids, some with a negative amount, an hour of 24 or a repeated id."""
    rows = model_rows(spark, sf_dir).filter("transaction_id > 0 and customer_id > 0 and terminal_id > 0")
    rows = rows.withColumn("_copy", F.explode(F.when(F.col("transaction_id") % 401 == 5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    planted = {"tx_amount": F.when(F.col("transaction_id") % 499 == 3, -1.0), "transaction_hour": F.when(F.col("transaction_id") % 311 == 4, 24)}
    one = F.struct(*(F.coalesce(planted[c], F.col(c)).alias(c) if c in planted else F.col(c) for c in (*policy.IDENTITY, *MODEL_FEATURES)))
    request = F.floor(F.col("transaction_id") / 50).cast("string")
    return rows.groupBy(request.alias("request_id")).agg(F.array_agg(one).cast(f"array<{scoring.TRANSACTION}>").alias("transactions"))


def amount_score(df: DataFrame) -> DataFrame:
    """A deterministic score in the place of a model's."""
    p = F.least(F.col("tx_amount") / 500, F.lit(1.0))
    return df.withColumn("fraud_probability", p).withColumn("threshold_decision", p >= THRESHOLD)


@query(with_sql(REQUEST_ROWS_SQL, """
SELECT request_id, concat_ws(',', CASE WHEN repeated THEN 'repeated_transaction_id' END, CASE WHEN negative THEN 'amount_not_finite_or_negative' END, CASE WHEN hour THEN 'value_out_of_range' END) AS reasons
FROM requests WHERE repeated OR negative OR hour"""))
def refused_scoring_requests(spark, sf_dir):
    """Requests that are refused, with their reasons."""
    return scoring.refused_requests(request_rows(spark, sf_dir)).select("request_id", F.array_join("reasons", ",").alias("reasons"))


@query(with_sql(REQUEST_ROWS_SQL, f"""
SELECT 'accepted' AS counter, count(*) FILTER (NOT (repeated OR negative OR hour)) AS value FROM requests
UNION ALL SELECT 'refused', count(*) FILTER (repeated OR negative OR hour) FROM requests
UNION ALL SELECT 'rows', count(*) FROM predictions
UNION ALL SELECT 'written', count(*) FROM predictions
UNION ALL SELECT 'decisions', count(*) FILTER (p >= {THRESHOLD}) FROM predictions
UNION ALL SELECT 'score_millionths', CAST(sum(CAST(round(p * 1000000) AS BIGINT)) AS BIGINT) FROM predictions
UNION ALL SELECT 'latencies', count(*) FROM requests
UNION ALL SELECT 'le' || i, count(*) FILTER (p <= b) FROM predictions, (VALUES {", ".join(f"({i}, {b})" for i, b in enumerate(scoring.SCORE_BUCKETS))}) v(i, b) GROUP BY i"""))
def scoring_stream_counters(spark, sf_dir):
    """What a listener counted while requests were scored as a stream, stopped once and resumed."""
    root, name = scratch(spark), f"scoring-{uuid.uuid4().hex[:8]}"
    counters = scoring.ScoringCounters(name)
    spark.streams.addListener(counters)
    try:
        requested = stored(request_rows(spark, sf_dir))
        for part in (0, 1):
            requested.filter(F.pmod(F.xxhash64("request_id"), F.lit(2)) == part).repartition(4).write.mode("append").parquet(f"{root}/requests")
            requests = spark.readStream.schema(scoring.REQUEST).option("maxFilesPerTrigger", 3).parquet(f"{root}/requests")
            frames = {"predictions": scoring.score_stream(requests, amount_score, name)}
            for q in ingest.start_queries(frames, ingest.StreamPaths(f"{root}/out", f"{root}/checkpoints"), prefix=name, trigger=None).values():
                q.awaitTermination()
                counters.wait(q)
    finally:
        spark.streams.removeListener(counters)
    written = spark.read.parquet(f"{root}/out/predictions").count()
    rows = [*counters.totals.items(), ("latencies", sum(counters.latencies)), ("written", written)]
    return spark.createDataFrame(rows, "counter string, value bigint")


@query(with_sql(TX_SQL, "SELECT DISTINCT CAST(tx_datetime AS DATE) AS transaction_date FROM tx"))
def distinct_days(spark, sf_dir):
    """U6."""
    return transactions(spark, sf_dir).select(F.to_date("tx_datetime").alias("transaction_date")).distinct()


@query(with_sql(TX_SQL, "SELECT transaction_id, customer_id, tx_amount FROM tx UNION ALL BY NAME SELECT transaction_id, tx_amount FROM tx"))
def union_by_name(spark, sf_dir):
    """Frames with different columns united by name."""
    tx = transactions(spark, sf_dir)
    return tx.select("transaction_id", "customer_id", "tx_amount").unionByName(tx.select("tx_amount", "transaction_id"), allowMissingColumns=True)


@query(with_sql(RAW_SQL, """
SELECT source_row_number, CASE WHEN regexp_full_match(trim("CUSTOMER_ID"), '[+-]?[0-9]+') THEN TRY_CAST("CUSTOMER_ID" AS BIGINT) END AS strict_customer, TRY_CAST("TX_AMOUNT" AS DOUBLE) AS amount,
       CAST(floor(TRY_CAST("TX_TIME_SECONDS" AS BIGINT) / 86400) AS BIGINT) AS days FROM raw"""))
def lenient_casts(spark, sf_dir):
    """Casts that give null instead of an error."""
    return raw_bronze(spark, sf_dir).select("source_row_number", scalars.strict_integer(F.col("CUSTOMER_ID")).alias("strict_customer"), scalars.finite_number(F.col("TX_AMOUNT")).alias("amount"), F.floor(scalars.whole_number(F.col("TX_TIME_SECONDS")) / 86400).cast("bigint").alias("days"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling seven-day risk of every customer: scan, aggregate, window."""
    return fct_customer_daily_risk(spark, sf_dir)


assert set(ORACLE_SQL) <= set(QUERIES) and SILVER_NAMES
