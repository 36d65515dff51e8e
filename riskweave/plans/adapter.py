"""The driver's ``events`` table as card transactions, clean and with planted errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SOURCE_TO_SILVER

EPOCH = "2024-01-01"


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver-shaped transactions; row numbers are the event ids of the day, so no window is needed."""
    ts = F.col("ts").cast("timestamp")
    seconds = F.unix_timestamp(ts) - F.unix_timestamp(F.to_timestamp(F.lit(EPOCH)))
    fraud = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("transaction_id"),
        ts.alias("tx_datetime"),
        F.col("user_id").alias("customer_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("terminal_id"),
        F.col("value").alias("tx_amount"),
        seconds.cast("bigint").alias("tx_time_seconds"),
        F.floor(seconds / 86400).cast("bigint").alias("tx_time_days"),
        fraud.cast("tinyint").alias("tx_fraud"),
        F.when(fraud == 0, 0).otherwise(1 + F.col("event_id") % 3).cast("tinyint").alias("tx_fraud_scenario"),
        F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit(".pkl")).alias("source_file"),
        F.to_date(ts).alias("source_file_date"),
        F.col("event_id").alias("source_row_number"),
        F.to_timestamp(F.lit("2024-06-01 00:00:00")).alias("ingested_at_utc"),
    )


def spread(rows: DataFrame) -> DataFrame:
    """Rows of fewer input splits than there are cores, dealt out before expensive expressions."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(2 * cores)


#: What is wrong with which rows: event_id % 97 and the changed column.
CORRUPTIONS = {
    1: ("TX_AMOUNT", "null"),
    2: ("TX_AMOUNT", "'-5.00'"),
    3: ("TX_FRAUD", "'2'"),
    4: ("TX_FRAUD_SCENARIO", "'4'"),
    5: ("TX_TIME_DAYS", "'9999'"),
    6: ("CUSTOMER_ID", "'not-a-number'"),
    8: ("TERMINAL_ID", "'-7'"),
    9: ("TX_AMOUNT", "'x'"),
}


def raw_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze rows as text, with the errors of CORRUPTIONS, wrong file dates (97: 7) and repeated rows (89: 0)."""
    clean = spread(transactions(spark, sf_dir))
    text = {source: F.col(name).cast("string") for source, (name, _) in SOURCE_TO_SILVER.items()}
    text["TX_DATETIME"] = F.date_format("tx_datetime", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    case = F.col("transaction_id") % 97
    for code, (column, value) in CORRUPTIONS.items():
        text[column] = F.when(case == code, F.expr(value).cast("string")).otherwise(text[column])
    day = F.when(case == 7, F.date_add("source_file_date", 1)).otherwise(F.col("source_file_date"))
    rows = clean.select(*(c.alias(n) for n, c in text.items()), "source_file", day.alias("source_file_date"), "source_row_number", "ingested_at_utc")
    copies = F.when(F.col("source_row_number") % 89 == 0, F.array(F.lit(0), F.lit(10_000_000))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_copy", F.explode(copies)).withColumn("source_row_number", F.col("source_row_number") + F.col("_copy")).drop("_copy")


def scored(df: DataFrame) -> DataFrame:
    """Transactions with a deterministic score, for operators that take a model's output."""
    return df.withColumn("transaction_date", F.to_date("tx_datetime")).withColumn("score", F.least(F.col("tx_amount") / 500, F.lit(1.0)))


#: DuckDB: the same tables as common table expressions.
TX_SQL = """
tx AS (
  SELECT event_id AS transaction_id, ts AS tx_datetime, user_id AS customer_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS terminal_id, value AS tx_amount,
         CAST(epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01') AS BIGINT) AS tx_time_seconds,
         CAST(floor((epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01')) / 86400) AS BIGINT) AS tx_time_days,
         CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS tx_fraud,
         CASE WHEN event_type = 'error' THEN 1 + event_id % 3 ELSE 0 END AS tx_fraud_scenario,
         CAST(ts AS DATE) AS source_file_date, event_id AS source_row_number,
         strftime(ts, '%Y-%m-%d') || '.pkl' AS source_file
  FROM events
)"""


def _changed(column: str, clean: str) -> str:
    cases = "".join(f" WHEN transaction_id % 97 = {code} THEN {value}" for code, (c, value) in CORRUPTIONS.items() if c == column)
    return f"CASE{cases} ELSE {clean} END AS {column}" if cases else f"{clean} AS {column}"


RAW_SQL = TX_SQL + ",\nraw0 AS (\n  SELECT " + ",\n         ".join(
    _changed(source, "strftime(tx_datetime, '%Y-%m-%d %H:%M:%S.%f')" if source == "TX_DATETIME" else f"CAST({name} AS VARCHAR)") for source, (name, _) in SOURCE_TO_SILVER.items()
) + """,
         source_file, CAST(CASE WHEN transaction_id % 97 = 7 THEN source_file_date + 1 ELSE source_file_date END AS DATE) AS source_file_date, source_row_number
  FROM tx
), raw AS (
  SELECT * FROM raw0 UNION ALL SELECT * REPLACE (source_row_number + 10000000 AS source_row_number) FROM raw0 WHERE source_row_number % 89 = 0
)"""

FEATURES_SQL = TX_SQL + """,
features AS (
  SELECT *, CAST(tx_datetime AS DATE) AS transaction_date,
         CAST(hour(tx_datetime) AS BIGINT) AS transaction_hour, CAST(isodow(tx_datetime) - 1 AS BIGINT) AS day_of_week,
         CAST(isodow(tx_datetime) >= 6 AS BIGINT) AS is_weekend, CAST(hour(tx_datetime) BETWEEN 0 AND 5 AS BIGINT) AS is_night,
         row_number() OVER c - 1 AS customer_previous_transaction_count,
         CAST(sum(CAST(tx_amount AS DECIMAL(18,4))) OVER (c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) / nullif(CAST(row_number() OVER c - 1 AS DOUBLE), 0) AS customer_previous_mean_amount,
         row_number() OVER t - 1 AS terminal_previous_transaction_count
  FROM tx WINDOW c AS (PARTITION BY customer_id ORDER BY tx_datetime, transaction_id), t AS (PARTITION BY terminal_id ORDER BY tx_datetime, transaction_id)
)"""

SUMMARY_SQL = TX_SQL + "".join(f""",
{entity}_daily AS (
  SELECT CAST(tx_datetime AS DATE) AS transaction_date, {entity}_id, count(*) AS transaction_count, {extra}
         CAST(sum(CAST(tx_amount AS DECIMAL(18,4))) AS DOUBLE) AS total_amount,
         CAST(sum(CAST(tx_amount AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS average_amount,
         CAST(sum(tx_fraud) AS BIGINT) AS fraud_count, CAST(sum(tx_fraud) AS DOUBLE) / count(*) AS fraud_rate
  FROM tx GROUP BY 1, 2
)""" for entity, extra in (("customer", "max(tx_amount) AS maximum_amount,"), ("terminal", "count(DISTINCT customer_id) AS unique_customers,")))

RISK_SQL = SUMMARY_SQL + "".join(f""",
{entity}_risk AS (
  SELECT *, CAST(rolling_7d_fraud_count AS DOUBLE) / nullif(CAST(rolling_7d_transaction_count AS DOUBLE), 0) AS rolling_7d_fraud_rate FROM (
    SELECT *, CAST(sum(transaction_count) OVER w AS BIGINT) AS rolling_7d_transaction_count,
           CAST(sum(CAST(total_amount AS DECIMAL(18,4))) OVER w AS DOUBLE) AS rolling_7d_total_amount,
           CAST(sum(fraud_count) OVER w AS BIGINT) AS rolling_7d_fraud_count
    FROM {entity}_daily WINDOW w AS (PARTITION BY {entity}_id ORDER BY transaction_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW))
)""" for entity in ("customer", "terminal")) + """,
daily AS (
  SELECT CAST(tx_datetime AS DATE) AS transaction_date, count(*) AS transaction_count, CAST(sum(CAST(tx_amount AS DECIMAL(18,4))) AS DOUBLE) AS total_amount,
         CAST(sum(tx_fraud) AS BIGINT) AS fraud_count, CAST(sum(tx_fraud) AS DOUBLE) / count(*) AS fraud_rate
  FROM tx GROUP BY 1
), overview AS (
  SELECT d.*, c.active_customer_count, c.customers_with_fraud, t.active_terminal_count, t.terminals_with_fraud
  FROM daily d
  JOIN (SELECT transaction_date, count(*) AS active_customer_count, count(*) FILTER (fraud_count > 0) AS customers_with_fraud FROM customer_risk GROUP BY 1) c USING (transaction_date)
  JOIN (SELECT transaction_date, count(*) AS active_terminal_count, count(*) FILTER (fraud_count > 0) AS terminals_with_fraud FROM terminal_risk GROUP BY 1) t USING (transaction_date)
)"""

SCORED_SQL = TX_SQL + """,
scored AS (SELECT *, CAST(tx_datetime AS DATE) AS transaction_date, least(tx_amount / 500, 1.0) AS score FROM tx),
cards AS (SELECT transaction_date, customer_id, max(tx_fraud) AS tx_fraud, max(score) AS score FROM scored GROUP BY 1, 2)"""
