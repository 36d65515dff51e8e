"""Gold that is continued day by day equals Gold that is rebuilt."""

import json
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from riskweave.operators import gold_days
from riskweave.operators.gold import build_gold
from riskweave.operators.gold_days import MANIFEST, continue_days, open_gold, read_days
from riskweave.plans.daily import run_daily
from riskweave.plans.marts import build_catalog
from riskweave.schemas import SILVER
from riskweave.sources import store

START = date(2018, 4, 1)


def silver_of(spark, days, rows_a_day=12):
    """Few customers and terminals, one of them in every third row, with ties in time."""
    data = []
    for n in days:
        day = START + timedelta(days=n)
        for i in range(rows_a_day):
            id_ = 1000 * (n + 1) + i
            when = datetime(day.year, day.month, day.day, i // 3, tzinfo=timezone.utc)
            data.append((id_, when, 1 if i % 3 == 0 else 2 + (i * n) % 4, 10 + i % 2, 0.1 * i + n, 0, n, i % 2, i % 2, f"{day}.pkl", day, i, when))
    return spark.createDataFrame(data, SILVER)


def same(a, b):
    key = lambda df: sorted(df.select(*sorted(df.columns)).collect(), key=repr)
    assert sorted(a.columns) == sorted(b.columns) and key(a) == key(b)


def same_gold(a, b):
    for name in ("transaction_features", "customer_daily_summary", "terminal_daily_summary"):
        same(getattr(a, name), getattr(b, name))


@pytest.mark.parametrize("runs", [[[0, 1, 2], [3], [4]], [[0, 2], [4, 5], [1]], [[3], [0]]])
def test_continuing_equals_rebuilding(spark, tmp_path, runs):
    root, seen = str(tmp_path / "gold"), []
    for run in runs:
        seen += run
        silver = silver_of(spark, seen)
        written = continue_days(spark, silver, [START + timedelta(days=n) for n in seen], root)
        assert written == [(START + timedelta(days=n)).isoformat() for n in sorted(seen) if n >= min(run)]
        same_gold(open_gold(spark, root), build_gold(silver))
    assert continue_days(spark, silver, [START], root) == []


def test_a_new_day_reads_neither_history_nor_old_totals(spark, tmp_path):
    root = str(tmp_path / "gold")
    continue_days(spark, silver_of(spark, range(4)), [START + timedelta(days=n) for n in range(4)], root)
    old = json.loads((tmp_path / "gold" / MANIFEST).read_text())
    for version in set(old["tables"]["entity_days"].values()):
        store.delete(f"{root}/entity_days/version={version}")  # only late days need the sums of days
    silver = silver_of(spark, range(5))
    continue_days(spark, silver.filter(F.col("source_file_date") >= START + timedelta(days=4)), [START + timedelta(days=4)], root)
    same_gold(open_gold(spark, root), build_gold(silver))


def test_totals_that_are_no_longer_kept_are_summed_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(gold_days, "SNAPSHOTS", 2)
    root, days = str(tmp_path / "gold"), [0, 2, 3, 4]
    for i in range(len(days)):
        continue_days(spark, silver_of(spark, days[: i + 1], 3), [START + timedelta(days=n) for n in days[: i + 1]], root)
    known = json.loads((tmp_path / "gold" / MANIFEST).read_text())
    assert len(known["totals"]) == 2 and START.isoformat() not in known["totals"]
    silver = silver_of(spark, range(5), 3)
    continue_days(spark, silver, [START + timedelta(days=1)], root)
    same_gold(open_gold(spark, root), build_gold(silver))


def test_a_run_that_fails_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "gold")
    continue_days(spark, silver_of(spark, [0]), [START], root)
    before = (tmp_path / "gold" / MANIFEST).read_text()
    two = silver_of(spark, [0, 1])
    for bad, message in ((F.lit(float("nan")), "finite"), (F.when(F.col("transaction_id") == 2003, F.raise_error(F.lit("stop"))).otherwise(F.col("tx_amount")), "stop")):
        with pytest.raises(Exception, match=message):
            continue_days(spark, two.withColumn("tx_amount", bad.cast("double")), [START + timedelta(days=1)], root)
    moved = two.withColumn("tx_datetime", F.col("tx_datetime") + F.expr("interval 1 day"))
    with pytest.raises(ValueError, match="file's date"):
        continue_days(spark, moved, [START + timedelta(days=1)], root)
    assert (tmp_path / "gold" / MANIFEST).read_text() == before
    continue_days(spark, two, [START + timedelta(days=1)], root)
    same_gold(open_gold(spark, root), build_gold(two))


def test_days_without_rows_and_empty_stores(spark, tmp_path):
    root = str(tmp_path / "gold")
    with pytest.raises(FileNotFoundError):
        read_days(spark, root, "transaction_features")
    silver = silver_of(spark, [0, 2])
    continue_days(spark, silver, [START, START + timedelta(days=1)], root)
    assert continue_days(spark, silver, [START + timedelta(days=n) for n in range(3)], root) == ["2018-04-03"]
    same_gold(open_gold(spark, root), build_gold(silver))


def test_daily_run_continues_gold(spark, tmp_path):
    import pandas as pd

    raw, lake = tmp_path / "raw", str(tmp_path / "lake")
    raw.mkdir()
    for n in (0, 2, 1):
        day = START + timedelta(days=n)
        frame = pd.DataFrame({"TRANSACTION_ID": [10 * n + 1, 10 * n + 2], "TX_DATETIME": pd.to_datetime([f"{day} 08:00", f"{day} 09:00"]), "CUSTOMER_ID": [1, 1], "TERMINAL_ID": [5, 6], "TX_AMOUNT": [1.5, 2.0], "TX_TIME_SECONDS": [86400 * n + 28800, 86400 * n + 32400], "TX_TIME_DAYS": [n, n], "TX_FRAUD": [0, 0], "TX_FRAUD_SCENARIO": [0, 0]})
        frame.to_pickle(raw / f"{day}.pkl")
        run_daily(spark, str(raw), lake, datetime(2026, 9, 3, tzinfo=timezone.utc), incremental=True)
    gold = build_catalog(spark, f"{lake}/silver", f"{lake}/gold")
    rows = gold.transaction_features.orderBy("transaction_id").collect()
    assert [r["customer_previous_transaction_count"] for r in rows] == [0, 1, 2, 3, 4, 5]
