"""Event rules on batches; de-duplication, restarts and windows on file-backed streams."""

import json
from datetime import date, datetime, timezone

import duckdb
import pytest
from pyspark.sql import functions as F

from riskweave.functions import scalars
from riskweave.plans import queries
from riskweave.schemas import KAFKA, SOURCE_COLUMNS, STREAM_BRONZE, STREAM_SILVER
from riskweave.streaming.events import bronze_events, build_messages, deduplicate, judged_messages, parse_messages, quarantine_events, silver_events
from riskweave.streaming.ingest import StreamPaths, drain, file_messages, kafka_messages, silver_stream, start_ingestion, start_queries
from riskweave.streaming.jobs import ingestion_parser, risk_parser
from riskweave.streaming.replay import ReplayReader, file_writer, numbered_messages, open_log, replay, replayed_messages, write_log
from riskweave.streaming.risk import risk_windows, start_risk

T0 = datetime(2026, 9, 3, 12, tzinfo=timezone.utc)


def event(id_=1001, when="2018-04-01 08:00:00", key=None, drop=(), **changes):
    tx = {"TRANSACTION_ID": str(id_), "TX_DATETIME": when, "CUSTOMER_ID": "101", "TERMINAL_ID": "201", "TX_AMOUNT": "25.5", "TX_TIME_SECONDS": "28800", "TX_TIME_DAYS": "0", "TX_FRAUD": "0", "TX_FRAUD_SCENARIO": "0"}
    tx |= {k: v for k, v in changes.items() if k in tx}
    doc = {"schema_version": "1.0", "event_id": "123e4567-e89b-52d3-a456-426614174000", "produced_at_utc": "2026-09-03T12:00:00Z", "source_file": "2018-04-01.pkl", "source_file_date": when[:10], "source_row_number": 0, "transaction": {k: v for k, v in tx.items() if k not in drop}}
    doc |= {k: v for k, v in changes.items() if k in doc}
    return (key or str(tx["TRANSACTION_ID"])).encode(), json.dumps(doc, sort_keys=True).encode()


def messages(spark, pairs):
    return spark.createDataFrame([(k, v, "transactions", 0, i, T0) for i, (k, v) in enumerate(pairs)], KAFKA)


CASES = [
    (event(), []),
    (event(TX_AMOUNT="-1", TX_TIME_DAYS="2"), ["negative_transaction_amount", "inconsistent_time_fields"]),
    (event("1001.5"), ["invalid_data_type"]),
    (event(drop=["TX_AMOUNT"]), ["missing_required_value"]),
    (event(TX_FRAUD="2"), ["invalid_fraud_label"]),
    (event(TX_FRAUD_SCENARIO="2"), ["invalid_fraud_scenario"]),
    (event(source_file_date="2018-04-02"), ["source_date_mismatch"]),
    ((b"1001", b"{not-valid-json"), ["invalid_event_json"]),
    (event(schema_version="2.0"), ["unsupported_schema_version"]),
    (event(key="9999"), ["kafka_key_mismatch"]),
    (event(event_id="not-a-uuid"), ["invalid_event_metadata"]),
    (event(source_file=None), ["missing_event_metadata"]),
    (event(TX_FRAUD="300"), ["invalid_data_type"]),
    (event(TX_AMOUNT="NaN"), ["invalid_data_type"]),
]


def test_reasons_of_every_message(spark):
    rows = judged_messages(messages(spark, [c for c, _ in CASES])).orderBy("kafka_offset").collect()
    assert [r["rejection_reasons"] for r in rows] == [reasons for _, reasons in CASES]
    assert [r["is_valid"] for r in rows] == [not reasons for _, reasons in CASES]


def test_projections(spark):
    m = messages(spark, [c for c, _ in CASES[:2]])
    judged = judged_messages(m)
    assert bronze_events(parse_messages(m)).schema.simpleString() == STREAM_BRONZE.simpleString()
    silver = silver_events(judged.filter("is_valid"))
    assert silver.schema.simpleString() == STREAM_SILVER.simpleString() and len(silver.columns) == 21
    q = quarantine_events(judged.filter("not is_valid"))
    assert len(q.columns) == 23 and q.first()["TX_AMOUNT"] == "-1"


def source_rows(spark):
    rows = [(1, 7.0, None, "b.pkl", date(2018, 4, 2), 0), (2, float("nan"), "x", "a.pkl", date(2018, 4, 1), 1), (3, 1.5, "y", "a.pkl", date(2018, 4, 1), 0)]
    df = spark.createDataFrame(rows, "TRANSACTION_ID long, TX_AMOUNT double, CUSTOMER_ID string, source_file string, source_file_date date, source_row_number long")
    missing = [c for c in SOURCE_COLUMNS if c not in df.columns]
    return df.withColumns({c: F.lit("1") for c in missing if c != "TX_DATETIME"} | {"TX_DATETIME": F.to_timestamp(F.lit("2018-04-01 08:00:00"))})


def test_envelopes(spark):
    docs = [json.loads(r["value"]) for r in build_messages(source_rows(spark), T0, "t").collect()]
    first = docs[0]
    assert list(first) == sorted(first) and first["schema_version"] == "1.0" and first["produced_at_utc"] == "2026-09-03T12:00:00Z"
    assert first["transaction"]["TX_DATETIME"] == "2018-04-01T08:00:00Z" and first["transaction"]["CUSTOMER_ID"] is None
    assert docs[1]["transaction"]["TX_AMOUNT"] is None
    import uuid

    assert first["event_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "riskweave://transactions/b.pkl#0"))
    keys = spark.createDataFrame([(7.0,), (7.5,), (None,)], "x double").select(scalars.message_key(F.col("x"), "double").alias("k")).collect()
    assert [r["k"] for r in keys] == ["7", "7.5", None]
    with pytest.raises(TypeError):
        scalars.source_text(F.col("x"), "array<int>")
    with pytest.raises(ValueError):
        build_messages(source_rows(spark), T0, " ")


def test_replay_order_rate_and_limit(spark, tmp_path):
    waits, clock = [], iter(range(100))
    result = replay(source_rows(spark), file_writer(str(tmp_path / "m")), produced_at=T0, topic="t", events_per_second=2, max_events=2, batch_events=1, clock=lambda: 0, sleep=waits.append)
    assert (result.messages, result.batches) == (2, 2) and waits == [0.5]
    sent = [json.loads(r["value"])["transaction"]["TRANSACTION_ID"] for r in spark.read.parquet(str(tmp_path / "m")).collect()]
    assert sorted(sent) == ["2", "3"] and clock
    all_rows = numbered_messages(source_rows(spark), T0, "t", partitions=1).orderBy("offset").collect()
    assert [json.loads(r["value"])["transaction"]["TRANSACTION_ID"] for r in all_rows] == ["3", "2", "1"]
    assert [r["offset"] for r in all_rows] == [0, 1, 2]
    for bad in ({"events_per_second": -1}, {"max_events": 0}):
        with pytest.raises(ValueError):
            replay(source_rows(spark), print, produced_at=T0, topic="t", **bad)


def many_rows(spark, n=60):
    days = F.date_add(F.lit(date(2018, 4, 1)), (F.col("id") % 3).cast("int"))
    df = spark.range(n).select(F.col("id").alias("TRANSACTION_ID"), F.lit("f.pkl").alias("source_file"), days.alias("source_file_date"), F.floor(F.col("id") / 3).alias("source_row_number"))
    return df.withColumns({c: F.lit("1") for c in SOURCE_COLUMNS if c not in df.columns and c != "TX_DATETIME"} | {"TX_DATETIME": F.to_timestamp(F.lit("2018-04-01 08:00:00"))}).repartition(5)


def in_order(messages, n):
    """Every place once: offsets of a partition count up in (date, row), and each key has one partition."""
    rows = [(r["partition"], r["offset"], json.loads(r["value"])) for r in messages.collect()]
    assert len({r[:2] for r in rows}) == len(rows) == n and len({p for p, _, _ in rows}) == 3
    for part in {p for p, _, _ in rows}:
        own = sorted(r for r in rows if r[0] == part)
        assert [r[1] for r in own] == list(range(len(own)))
        places = [(r[2]["source_file_date"], r[2]["source_row_number"]) for r in own]
        assert places == sorted(places)


@pytest.mark.parametrize("batch_events", [7, 1000])
def test_offsets_are_unique_over_batches(spark, tmp_path, batch_events):
    waits = []
    result = replay(many_rows(spark), file_writer(str(tmp_path / "m")), produced_at=T0, topic="t", events_per_second=1000, batch_events=batch_events, clock=lambda: 0, sleep=waits.append)
    assert (result.messages, result.batches) == (60, -(-60 // batch_events)) and len(waits) == result.batches - 1
    in_order(spark.read.parquet(str(tmp_path / "m")), 60)


def test_first_events_are_those_of_the_first_day(spark, tmp_path):
    replay(many_rows(spark), file_writer(str(tmp_path / "m")), produced_at=T0, topic="t", events_per_second=0, max_events=20, batch_events=8)
    sent = [json.loads(r["value"]) for r in spark.read.parquet(str(tmp_path / "m")).collect()]
    assert sorted(x["source_row_number"] for x in sent) == list(range(20)) and {x["source_file_date"] for x in sent} == {"2018-04-01"}


def test_replayed_stream_keeps_limits_and_resumes(spark, tmp_path):
    log = write_log(many_rows(spark), str(tmp_path / "log"), produced_at=T0, topic="t", segment_events=11)
    assert open_log(str(tmp_path / "log")) == log and log.events == 60
    with pytest.raises(FileExistsError):
        write_log(many_rows(spark), str(tmp_path / "log"), produced_at=T0, topic="t")
    with pytest.raises(FileNotFoundError):
        open_log(str(tmp_path / "none"))
    sizes = []
    for limit in (25, None):  # the second run resumes where the first was stopped
        stream = replayed_messages(log, spark, progress=str(tmp_path / "cp/progress.json"), events_per_second=0, max_events=limit, batch_events=10)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp/q")).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        sizes += [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert sizes == [10, 10, 5, 10, 10, 10, 5]
    in_order(spark.read.parquet(str(tmp_path / "out")), 60)
    assert log.between(spark, 9, 24).count() == 15


def test_schedule_of_the_replayed_stream(tmp_path, monkeypatch):
    from riskweave.streaming import replay as module

    now = [1000.0]
    monkeypatch.setattr(module.time, "time", lambda: now[0])
    options = {"folder": "x", "events": "100", "segmentEvents": "30", "eventsPerSecond": "2", "startedAt": "1000", "progress": str(tmp_path / "p/progress.json")}
    reader = ReplayReader(options)
    assert reader.initialOffset() == {"sent": 0} and reader.latestOffset() == {"sent": 1}
    now[0] = 1020.0
    assert reader.latestOffset() == {"sent": 41}
    assert [(p.segment, p.first, p.end) for p in reader.partitions({"sent": 1}, {"sent": 41})] == [(0, 1, 30), (1, 30, 41)]
    again = ReplayReader(options | {"batchEvents": "5"})
    assert again.latestOffset() == {"sent": 41}  # nothing more is due
    now[0] = 2000.0
    assert again.latestOffset() == {"sent": 46} and ReplayReader(options | {"maxEvents": "50"}).latestOffset() == {"sent": 50}
    assert again.partitions({"sent": 46}, {"sent": 46}) == []


def test_late_and_repeated_rows_are_dropped(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "transaction_id long, tx_datetime timestamp, description string"
    stream = spark.readStream.schema(schema).json(str(folder))
    batches = [
        [(1001, "2018-04-01T08:00:00Z"), (1002, "2018-04-01T09:00:00Z")],
        [(1001, "2018-04-01T08:05:00Z"), (1003, "2018-04-01T10:00:00Z")],
        [(2000, "2018-04-04T10:00:00Z")],
        [(9999, "2018-04-01T12:00:00Z")],
    ]
    for n, rows in enumerate(batches):
        (folder / f"{n}.json").write_text("\n".join(json.dumps({"transaction_id": i, "tx_datetime": t, "description": "x"}) for i, t in rows))
        start_one(deduplicate(stream), tmp_path)
    assert sorted(r["transaction_id"] for r in spark.read.parquet(str(tmp_path / "out/dedup")).collect()) == [1001, 1002, 1003, 2000]
    with pytest.raises(ValueError):
        deduplicate(stream, " ")


def test_state_is_kept_by_rocksdb_with_changelogs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("transaction_id long, tx_datetime timestamp").json(str(tmp_path / "in"))
    (tmp_path / "in/0.json").write_text("\n".join(json.dumps({"transaction_id": i % 5, "tx_datetime": "2018-04-01T08:00:00Z"}) for i in range(20)))
    query = start_queries({"dedup": deduplicate(stream)}, StreamPaths(str(tmp_path / "out"), str(tmp_path / "cp")), prefix="state", trigger=None)["dedup"]
    drain([query])
    state = query.recentProgress[0]["stateOperators"][0]
    assert any(k.startswith("rocksdb") for k in state["customMetrics"]) and state["numRowsTotal"] == 5
    assert spark.read.parquet(str(tmp_path / "out/dedup")).count() == 5
    assert list((tmp_path / "cp").rglob("*.changelog"))


def start_one(frame, tmp_path):
    drain(start_queries({"dedup": frame}, StreamPaths(str(tmp_path / "out"), str(tmp_path / "cp")), prefix="test", trigger=None).values())


def test_ingestion_survives_a_restart(spark, tmp_path):
    source, paths = str(tmp_path / "messages"), StreamPaths(str(tmp_path / "out"), str(tmp_path / "cp"))

    def run(pairs):
        messages(spark, pairs).coalesce(1).write.mode("append").parquet(source)
        drain(start_ingestion(file_messages(spark, source), paths, trigger=None).values())
        return {n: spark.read.parquet(paths.table(n)).count() for n in ("bronze", "silver", "quarantine")}

    assert run([event(1001), event(1001), event(1002, TX_AMOUNT="-1")]) == {"bronze": 3, "silver": 1, "quarantine": 1}
    assert run([event(1001), event(1003)]) == {"bronze": 5, "silver": 2, "quarantine": 1}
    drain(start_risk(silver_stream(spark, paths.table("silver"), max_files=1), StreamPaths(str(tmp_path / "gold"), str(tmp_path / "gcp")), trigger=None).values())
    assert spark.read.parquet(str(tmp_path / "gold/customer_risk_windows")).schema["window_start"] is not None


RISK = [(1001, "08:05", 101, 201, 25.0), (1002, "08:20", 101, 202, 75.0), (1003, "08:45", 102, 201, 100.0), (1004, "09:05", 101, 201, 50.0), (1005, "02:15", 101, 203, 10.0)]


def test_risk_windows(spark):
    df = spark.createDataFrame([(i, datetime.fromisoformat(f"2018-04-01T{t}:00+00:00"), c, e, a) for i, t, c, e, a in RISK], "transaction_id long, tx_datetime timestamp, customer_id long, terminal_id long, tx_amount double")
    customers = {(r["window_start"].hour, r["customer_id"]): r for r in risk_windows(df, "customer").collect()}
    assert len(customers) == 4 and risk_windows(df, "terminal").count() == 4
    r = customers[8, 101]
    assert (r["transaction_count"], r["total_amount"], r["average_amount"], r["maximum_amount"], r["approx_unique_terminals"]) == (2, 100.0, 50.0, 75.0, 2)
    assert customers[2, 101]["night_transaction_count"] == 1
    assert not {"tx_fraud", "tx_fraud_scenario"} & set(risk_windows(df, "customer").columns)
    with pytest.raises(ValueError):
        risk_windows(df, "customer", window="")


def test_small_windows_are_counted_closely(spark, tmp_path):
    n = 40_000
    df = spark.range(9 * n).select("id", F.col("id").alias("transaction_id"), F.lit(datetime(2018, 4, 1, 8, 5)).cast("timestamp").alias("tx_datetime"), F.col("id").alias("customer_id"), (F.col("id") % n).alias("terminal_id"), F.lit(1.0).alias("tx_amount"))
    near = risk_windows(df, "terminal").groupBy("approx_unique_customers").count().collect()
    assert [(r[0], r[1]) for r in near] == [(9, n)]
    late = df.limit(1).withColumn("tx_datetime", F.lit(datetime(2018, 4, 3)).cast("timestamp"))
    for part in (df.filter("terminal_id < 50 and id % 2 = 0"), df.filter("terminal_id < 50 and id % 3 = 0"), df.filter("terminal_id < 50"), late):  # a batch each, with common values
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(start_queries({"w": risk_windows(stream, "terminal")}, StreamPaths(str(tmp_path / "out"), str(tmp_path / "cp")), prefix="small", trigger=None).values())
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out/w")).groupBy("approx_unique_customers").count().collect()] == [(9, 50)]


def test_approximate_windows_keep_rows_without_an_entity(spark, tmp_path):
    events = spark.range(6).select(F.col("id").alias("event_id"), F.lit(datetime(2024, 1, 1, 8)).cast("timestamp_ntz").alias("ts"), F.when(F.col("id") > 1, F.col("id") % 2).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 3}').alias("props"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    rows = queries.approximate_risk_windows(spark, str(tmp_path)).collect()
    assert {(r["customer_id"], r["transaction_count"], r["exact_terminals"], r["within_bound"]) for r in rows} == {(None, 2, 1, True), (0, 2, 1, True), (1, 2, 1, True)}


def test_files_of_a_batch_grow_with_the_messages(spark, tmp_path, monkeypatch):
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 2592).cast("timestamp_ntz")
    events = spark.range(1000).select(F.col("id").alias("event_id"), ts.alias("ts"), (F.col("id") % 7 + 1).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 3}').alias("props"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    asked = []
    monkeypatch.setattr(queries, "MESSAGES_A_FILE", 25)
    monkeypatch.setattr(queries.ingest, "file_messages", lambda *a, f=file_messages, **k: asked.append(k["max_files"]) or f(*a, **k))
    got = {r[0] for r in queries.stream_late_rows_and_restarts(spark, str(tmp_path)).collect()}
    assert asked == [40, 40, 40]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == {r[0] for r in con.execute(queries.ORACLE_SQL["stream_late_rows_and_restarts"]).fetchall()} and len(got) > 800


def test_stream_options(spark, tmp_path):
    with pytest.raises(ValueError, match="differ"):
        StreamPaths("/a", "/a/")
    with pytest.raises(ValueError):
        file_messages(spark, str(tmp_path / "x"), max_files=0)
    with pytest.raises(ValueError):
        kafka_messages(spark, servers=" ", topic="t")
    with pytest.raises(Exception, match="kafka"):
        kafka_messages(spark, servers="localhost:1", topic="t")
    assert ingestion_parser().parse_args(["--output-root", "a", "--checkpoint-root", "b"]).watermark == "1 day"
    assert risk_parser().parse_args(["--silver", "s", "--output-root", "a", "--checkpoint-root", "b"]).window == "1 hour"


def test_a_failed_start_stops_the_others(spark, tmp_path):
    stream = spark.readStream.schema("id long").parquet(str(tmp_path))
    paths = StreamPaths(str(tmp_path / "o"), str(tmp_path / "c"))
    with pytest.raises(Exception):
        start_queries({"a": stream, "b": spark.range(1)}, paths, prefix="t")
    assert not [q for q in spark.streams.active if q.name == "t-a"]
