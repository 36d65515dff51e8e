"""Bronze, Silver and Gold against literal rows."""

from datetime import date, datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave.contracts import require_positive, require_row_number, require_text, require_utc
from riskweave.operators.bronze import bronze_records, ingest_bronze
from riskweave.operators.gold import build_gold
from riskweave.operators.silver import ingest_silver, validate_bronze
from riskweave.plans.daily import run_daily
from riskweave.schemas import BRONZE, QUARANTINE, SILVER, SOURCE_COLUMNS
from riskweave.sources import store
from riskweave.sources.publish import publish_tables, table_path, write_json
from riskweave.sources.files import discover_daily_files, load_json_object, load_silver, read_source_csv, require_inputs, union_view

NOW = datetime(2026, 9, 3, 12, tzinfo=timezone.utc)
DAY = date(2018, 4, 1)


def source(id_, when="2018-04-01 08:00:00", customer="1", terminal="10", amount="25.5", seconds="28800", days="0", fraud="0", scenario="0"):
    return (str(id_), when, customer, terminal, amount, seconds, days, fraud, scenario)


def bronze(spark, rows, day=DAY):
    data = [(*r, f"{day}.pkl", day, i, NOW) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, BRONZE)


VALID = [source(1001), source(1002, "2018-04-01 23:59:59", seconds="86399"), source(1003, fraud="1", scenario="1"), source(1004, fraud="1", scenario="2"), source(1005, fraud="1", scenario="3")]
INVALID = {
    2001: (source(2001, amount=None), "missing_required_value"),
    2002: (source(2002, amount="-5"), "negative_transaction_amount"),
    2003: (source(2003, fraud="2"), "invalid_fraud_label"),
    2004: (source(2004, scenario="4"), "invalid_fraud_scenario"),
    2005: (source(2005, days="1"), "inconsistent_time_fields"),
    2006: (source(2006, customer="not-a-number"), "invalid_data_type"),
    2007: (source(2007, "2018-04-02 08:00:00"), "source_date_mismatch"),
}


def test_valid_rows_are_typed(spark):
    result = validate_bronze(bronze(spark, VALID))
    assert result.silver.count() == 5 and result.quarantine.count() == 0
    assert result.silver.schema.simpleString() == SILVER.simpleString()
    assert result.quarantine.schema.simpleString() == QUARANTINE.simpleString()


def test_every_invalid_row_has_its_reason(spark):
    q = validate_bronze(bronze(spark, [r for r, _ in INVALID.values()])).quarantine
    assert {int(r["TRANSACTION_ID"]): r["rejection_reasons"] for r in q.collect()} == {i: [reason] for i, (_, reason) in INVALID.items()}


def test_first_of_equal_ids_stays(spark):
    rows = [source(3001), source(3001), source(3002, amount="45.00"), source(3002, amount="450.00"), source(3003)]
    result = validate_bronze(bronze(spark, rows))
    assert sorted(r[0] for r in result.silver.select("transaction_id").collect()) == [3001, 3002, 3003]
    assert sorted(r[0] for r in result.quarantine.select("source_row_number").collect()) == [1, 3]
    assert {tuple(r["rejection_reasons"]) for r in result.quarantine.collect()} == {("duplicate_transaction_id",)}


def test_an_invalid_row_does_not_make_a_later_one_a_duplicate(spark):
    result = validate_bronze(bronze(spark, [source(1, amount="-1"), source(1)]))
    assert [r["source_row_number"] for r in result.silver.collect()] == [1]


def test_reasons_add_up_in_order(spark):
    q = validate_bronze(bronze(spark, [source("-1", "bad", amount="-3", days="7", fraud="1", scenario="0")])).quarantine
    assert q.first()["rejection_reasons"] == ["invalid_data_type", "negative_transaction_amount", "invalid_fraud_scenario", "inconsistent_time_fields"]


def test_known_ids_are_duplicates(spark):
    known = spark.createDataFrame([(1001,)], "transaction_id long")
    result = validate_bronze(bronze(spark, VALID[:2]), known)
    assert [r["transaction_id"] for r in result.silver.collect()] == [1002]


def test_whole_numbers_in_any_spelling_and_negative_time(spark):
    result = validate_bronze(bronze(spark, [source("1.0", customer="1e3"), source(2, customer="1.5"), source(3, seconds="-1", days="-1"), source(4, amount="inf"), source(5, amount="")]))
    assert [(r["transaction_id"], r["customer_id"]) for r in result.silver.collect()] == [(1, 1000)]
    reasons = {r["TRANSACTION_ID"]: r["rejection_reasons"] for r in result.quarantine.collect()}
    assert reasons == {"2": ["invalid_data_type"], "3": ["inconsistent_time_fields"], "4": ["invalid_data_type"], "5": ["invalid_data_type"]}


def test_missing_metadata_is_an_error(spark):
    with pytest.raises(ValueError, match="metadata"):
        validate_bronze(bronze(spark, VALID).withColumn("ingested_at_utc", F.lit(None).cast("timestamp")))
    with pytest.raises(ValueError, match="negative"):
        validate_bronze(bronze(spark, VALID).withColumn("source_row_number", F.lit(-1).cast("long")))
    with pytest.raises(ValueError, match="TX_FRAUD"):
        validate_bronze(bronze(spark, VALID).drop("TX_FRAUD"))


def files(spark, days):
    rows = [(*r, f"{d}.pkl", i) for d, day_rows in days.items() for i, r in enumerate(day_rows)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in SOURCE_COLUMNS) + ", source_file string, row_in_file long")


def test_bronze_numbers_rows_from_zero(spark):
    b = bronze_records(files(spark, {DAY: VALID}), NOW)
    assert sorted(r["source_row_number"] for r in b.collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="UTC"):
        bronze_records(files(spark, {DAY: VALID}), NOW.astimezone(timezone(timedelta(hours=2))))
    with pytest.raises(ValueError, match="unexpected"):
        bronze_records(files(spark, {DAY: VALID}).withColumn("more", F.lit(1)), NOW)


def test_ingestion_is_incremental_and_first_ingested_wins(spark, tmp_path):
    next_day = DAY + timedelta(days=1)
    days = {next_day: [source(1001, "2018-04-02 08:00:00", seconds="115200", days="1"), source(1002, "2018-04-02 09:00:00", seconds="118800", days="1")], DAY: [source(1001)]}
    b, s, q = (str(tmp_path / x) for x in ("bronze", "silver", "quarantine"))
    assert ingest_bronze(files(spark, days), b, NOW) == [DAY, next_day]
    assert ingest_bronze(files(spark, days), b, NOW) == []
    assert ingest_silver(spark.read.schema(BRONZE).parquet(b), s, q) == [DAY, next_day]
    assert ingest_silver(spark.read.schema(BRONZE).parquet(b), s, q) == []
    assert sorted((r["transaction_id"], str(r["source_file_date"])) for r in load_silver(spark, s).collect()) == [(1001, "2018-04-01"), (1002, "2018-04-02")]
    before = DAY - timedelta(days=1)
    ingest_bronze(files(spark, {before: [source(1002, "2018-03-31 08:00:00")]}), b, NOW)
    assert ingest_silver(spark.read.schema(BRONZE).parquet(b), s, q) == [before]
    assert load_silver(spark, s).count() == 2
    with pytest.raises(ValueError, match="different"):
        ingest_silver(spark.read.schema(BRONZE).parquet(b), s, s)


GOLD_ROWS = [(4, "2018-04-02 08:00:00", 1, 11, 50.0, 0), (2, "2018-04-01 09:00:00", 1, 10, 30.0, 1), (1, "2018-04-01 08:00:00", 1, 10, 10.0, 0), (3, "2018-04-01 10:00:00", 2, 11, 20.0, 0)]


def silver_rows(spark, rows=GOLD_ROWS):
    base = spark.createDataFrame(rows, "transaction_id long, t string, customer_id long, terminal_id long, tx_amount double, f int")
    extra = {"tx_time_seconds": F.lit(0), "tx_time_days": F.lit(0), "tx_fraud_scenario": F.lit(0), "source_file": F.lit("x.pkl"), "source_file_date": F.to_date("tx_datetime"), "source_row_number": F.col("transaction_id"), "ingested_at_utc": F.to_timestamp(F.lit("2026-09-03"))}
    df = base.withColumn("tx_datetime", F.to_timestamp("t")).withColumn("tx_fraud", F.col("f")).withColumns(extra)
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in SILVER.fields))


def test_gold_features(spark):
    rows = build_gold(silver_rows(spark)).transaction_features.orderBy("transaction_id").collect()
    assert [r["transaction_hour"] for r in rows] == [8, 9, 10, 8]
    assert [r["day_of_week"] for r in rows] == [6, 6, 6, 0]
    assert [r["is_weekend"] for r in rows] == [1, 1, 1, 0] and [r["is_night"] for r in rows] == [0, 0, 0, 0]
    assert [r["customer_previous_transaction_count"] for r in rows] == [0, 1, 0, 2]
    assert [r["terminal_previous_transaction_count"] for r in rows] == [0, 1, 0, 1]
    assert [r["customer_previous_mean_amount"] for r in rows] == [None, 10.0, None, 20.0]
    assert [r["amount_to_customer_previous_mean"] for r in rows] == [None, 3.0, None, 2.5]


def test_gold_summaries_and_guards(spark):
    gold = build_gold(silver_rows(spark))
    c = {(str(r["transaction_date"]), r["customer_id"]): r for r in gold.customer_daily_summary.collect()}
    first = c["2018-04-01", 1]
    assert (first["transaction_count"], first["total_amount"], first["average_amount"], first["maximum_amount"], first["fraud_count"], first["fraud_rate"]) == (2, 40.0, 20.0, 30.0, 1, 0.5)
    t = {(str(r["transaction_date"]), r["terminal_id"]): r for r in gold.terminal_daily_summary.collect()}
    assert t["2018-04-01", 10]["unique_customers"] == 1 and len(t) == 3
    with pytest.raises(ValueError, match="unique"):
        build_gold(silver_rows(spark, [GOLD_ROWS[0], GOLD_ROWS[0]]))
    with pytest.raises(ValueError, match="finite"):
        build_gold(silver_rows(spark, [(9, "2018-04-01 08:00:00", 1, 1, float("inf"), 0)]))


def test_zero_mean_has_no_ratio(spark):
    rows = [(1, "2018-04-01 08:00:00", 1, 1, 0.0, 0), (2, "2018-04-01 09:00:00", 1, 1, 5.0, 0)]
    r = build_gold(silver_rows(spark, rows)).transaction_features.orderBy("transaction_id").collect()[1]
    assert r["customer_previous_mean_amount"] == 0.0 and r["amount_to_customer_previous_mean"] is None


def test_daily_run_from_pickles(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    frame = pd.DataFrame({"TRANSACTION_ID": [1, 2], "TX_DATETIME": pd.to_datetime(["2018-04-01 08:00", "2018-04-01 09:00"]), "CUSTOMER_ID": [1, 1], "TERMINAL_ID": [5, 5], "TX_AMOUNT": [1.5, -2.0], "TX_TIME_SECONDS": [28800, 32400], "TX_TIME_DAYS": [0, 0], "TX_FRAUD": [0, 0], "TX_FRAUD_SCENARIO": [0, 0]})
    frame.to_pickle(raw / "2018-04-01.pkl")
    result = run_daily(spark, str(raw), str(tmp_path / "lake"), NOW)
    assert result.bronze_days == result.silver_days == [DAY]
    assert spark.read.parquet(table_path(str(tmp_path / "lake/gold"), "transaction_features")).count() == 1
    assert spark.read.parquet(str(tmp_path / "lake/quarantine")).first()["rejection_reasons"] == ["negative_transaction_amount"]
    again = run_daily(spark, str(raw), str(tmp_path / "lake"), NOW)
    assert again.bronze_days == again.silver_days == []


def test_sources(spark, tmp_path):
    for name in ("2018-04-02.pkl", "2018-04-01.pkl", "notes.txt"):
        (tmp_path / name).touch()
    assert discover_daily_files(tmp_path) == ["2018-04-01.pkl", "2018-04-02.pkl"]
    (tmp_path / "2018-02-30.pkl").touch()
    with pytest.raises(ValueError, match="2018-02-30"):
        discover_daily_files(tmp_path)
    csv = tmp_path / "rows.csv"
    csv.write_text(",".join(SOURCE_COLUMNS) + "\n" + ",".join(source(1, amount="")) + "\n")
    assert read_source_csv(spark, str(csv)).first()["TX_AMOUNT"] is None
    assert read_source_csv(spark, str(csv), null_value=None).first()["TX_AMOUNT"] == ""
    with pytest.raises(FileNotFoundError, match="nothing"):
        require_inputs(spark, [str(csv), str(tmp_path / "nothing")])
    with pytest.raises(FileNotFoundError):
        load_json_object(tmp_path / "none.json", "policy")
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(ValueError, match="object"):
        load_json_object(tmp_path / "list.json", "policy")
    spark.range(2).write.parquet(str(tmp_path / "a"))
    spark.range(1).withColumn("more", F.lit("x")).write.parquet(str(tmp_path / "b"))
    assert set(union_view(spark, "both", [str(tmp_path / "a"), str(tmp_path / "b")]).columns) == {"id", "more"} and spark.table("both").count() == 3


def test_guards():
    assert require_row_number(0) == 0 and require_text(" a ", "x") == "a" and require_positive(3, "x") == 3
    for bad in (True, -1, 1.0, "1"):
        with pytest.raises(ValueError):
            require_row_number(bad)
    for bad in ("", "  "):
        with pytest.raises(ValueError):
            require_text(bad, "x")
    with pytest.raises(ValueError):
        require_utc(datetime(2026, 1, 1))


@pytest.mark.parametrize("bad", ["notes.pkl", "2018-02-30.pkl", "2018-4-1.pkl"])
def test_badly_named_files_are_refused_before_anything_is_written(spark, tmp_path, bad):
    raw = tmp_path / "raw"
    raw.mkdir()
    frame = pd.DataFrame([source(1)], columns=list(SOURCE_COLUMNS))
    for name in ("2018-04-01.pkl", bad):
        frame.to_pickle(raw / name)
    for _ in range(2):
        with pytest.raises(ValueError, match=bad):
            run_daily(spark, str(raw), str(tmp_path / "lake"), NOW)
    assert not (tmp_path / "lake").exists()
    rows = files(spark, {DAY: [source(1)]}).withColumn("source_file", F.lit(bad))
    with pytest.raises(ValueError, match=bad):
        run_daily(spark, rows, str(tmp_path / "lake"), NOW)
    with pytest.raises(Exception, match="not a date"):
        bronze_records(rows, NOW).collect()
    (raw / bad).unlink()
    first = run_daily(spark, str(raw), str(tmp_path / "lake"), NOW)
    assert first.bronze_days == first.silver_days == [DAY]
    before = spark.read.parquet(str(tmp_path / "lake/bronze")).collect()
    assert run_daily(spark, str(raw), str(tmp_path / "lake"), NOW).bronze_days == []
    assert spark.read.parquet(str(tmp_path / "lake/bronze")).collect() == before


def test_row_numbers_over_pieces_of_a_file(spark):
    rows = files(spark, {DAY: [source(i) for i in range(6)]}).withColumn("row_in_file", F.col("TRANSACTION_ID").cast("long") * (1 << 19))
    got = {r["TRANSACTION_ID"]: r["source_row_number"] for r in bronze_records(rows.repartition(3), NOW).collect()}
    assert got == {str(i): i for i in range(6)}


def test_an_interrupted_silver_day_is_computed_again(spark, tmp_path):
    b, s, q = (str(tmp_path / x) for x in ("bronze", "silver", "quarantine"))
    ingest_bronze(files(spark, {DAY: [source(1), source(2)]}), b, NOW)
    ingest_silver(spark.read.schema(BRONZE).parquet(b), s, q)
    store.delete(f"{s}-days")  # as if the run had died before its last step
    whole = spark.read.parquet(s)
    half, layout = whole.filter("transaction_id = 1").collect(), whole.schema
    store.delete(s)
    spark.createDataFrame(half, layout).write.partitionBy("source_file_date").parquet(s)
    assert ingest_silver(spark.read.schema(BRONZE).parquet(b), s, q) == [DAY]
    assert sorted(r["transaction_id"] for r in load_silver(spark, s).collect()) == [1, 2]


def test_tables_are_published_without_a_gap(spark, tmp_path):
    root = str(tmp_path / "gold")
    seen = []
    for n in range(1, 5):
        publish_tables({"a": spark.range(n), "b": spark.range(n)}, root)
        seen.append(table_path(root, "a"))
        assert spark.read.parquet(seen[-1]).count() == n
    assert store.exists(seen[2]) and not store.exists(seen[0]) and len(store.children(f"{root}/versions")) == 2
    with pytest.raises(Exception):
        publish_tables({"a": spark.range(1).select(F.raise_error(F.lit("stop")).alias("x"))}, root)
    assert table_path(root, "a") == seen[-1] and spark.read.parquet(seen[-1]).count() == 4


def test_manifests_are_replaced_in_one_step(spark, tmp_path):
    for uri in (str(tmp_path / "m/x.json"), f"file://{tmp_path}/n/x.json"):
        for content in ({"a": 1}, {"a": "é"}):
            assert write_json(uri, content) == uri and load_json_object(uri, "manifest") == content
        assert store.children(uri.rsplit("/", 1)[0]) == ["x.json"]


def day_files(spark, days):
    """Valid rows: ids by day."""
    rows = {}
    for d, ids in days.items():
        seconds = (d - DAY).days * 86400 + 28800
        rows[d] = [source(i, f"{d} 08:00:00", seconds=str(seconds), days=str((d - DAY).days)) for i in ids]
    return files(spark, rows)


def test_filters_of_finished_days_find_known_ids(spark, tmp_path):
    from riskweave.operators import known_ids as module

    b, s, q = (str(tmp_path / x) for x in ("bronze", "silver", "quarantine"))
    days = [DAY + timedelta(days=i) for i in range(5)]
    first = {days[0]: range(0, 300), days[1]: range(300, 600), days[2]: range(10_000, 10_300)}
    ingest_bronze(day_files(spark, first), b, NOW)
    assert ingest_silver(spark.read.schema(BRONZE).parquet(b), s, q) == days[:3]
    filters = spark.read.parquet(module.filters_path(s))
    assert {(str(r[0]), r[1], r[2]) for r in filters.select("source_file_date", "low", "high").distinct().collect()} == {("2018-04-01", 0, 299), ("2018-04-02", 300, 599), ("2018-04-03", 10_000, 10_299)}
    asked = spark.createDataFrame([(i,) for i in (5, 299, 10_299, 700, 9_000, 20_000)] + [(i,) for i in range(1_000, 3_000)], "transaction_id long")
    done = spark.createDataFrame([(d,) for d in days[:3]], "source_file_date date")
    assert sorted(r[0] for r in module.known_ids(spark, asked, s, done).collect()) == [5, 299, 10_299]
    near = module.possible_days(filters, 650, 9_999)
    assert near == [] and module.known_ids(spark, asked.filter("transaction_id between 650 and 9999"), s, done).count() == 0
    wrong = module.hits(spark.range(20_000, 40_000).withColumnRenamed("id", "transaction_id"), filters, module.possible_days(filters, 0, 40_000)).count()
    assert wrong < 0.03 * 3 * 20_000  # a filter may err, seldom
    plan = module.known_ids(spark, asked, s, done)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    ingest_bronze(day_files(spark, {days[3]: [299, 299, 601, 10_000, 50_000]}), b, NOW)
    assert ingest_silver(spark.read.schema(BRONZE).parquet(b), s, q) == [days[3]]
    assert load_silver(spark, s).count() == 902
    rejected = spark.read.parquet(q).filter(F.col("source_file_date") == F.lit(days[3]))
    assert sorted(r["TRANSACTION_ID"] for r in rejected.collect()) == ["10000", "299", "299"]
    store.delete(module.filters_path(s))  # a table of before filters were kept
    ingest_bronze(day_files(spark, {days[4]: [50_000, 50_001]}), b, NOW)
    assert ingest_silver(spark.read.schema(BRONZE).parquet(b), s, q) == [days[4]] and load_silver(spark, s).count() == 903
