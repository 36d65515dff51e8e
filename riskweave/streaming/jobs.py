"""Command-line entry points of the two streaming jobs."""

from __future__ import annotations

import argparse

from ..session import create_session
from .events import DEFAULT_WATERMARK as DEDUP_WATERMARK
from .ingest import DEFAULT_TRIGGER, StreamPaths, file_messages, kafka_messages, run_until_done, silver_stream, start_ingestion
from .risk import DEFAULT_WATERMARK, DEFAULT_WINDOW, start_risk


def ingestion_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Messages to Bronze, Silver and quarantine")
    p.add_argument("--servers")
    p.add_argument("--topic", default="transactions")
    p.add_argument("--message-folder", help="read Kafka-shaped files instead of a topic")
    p.add_argument("--output-root", required=True)
    p.add_argument("--checkpoint-root", required=True)
    p.add_argument("--starting-offsets", default="earliest")
    p.add_argument("--watermark", default=DEDUP_WATERMARK)
    p.add_argument("--trigger", default=DEFAULT_TRIGGER)
    return p


def ingestion_job(argv: list[str] | None = None) -> None:
    args = ingestion_parser().parse_args(argv)
    paths = StreamPaths(args.output_root, args.checkpoint_root)
    spark = create_session("riskweave-ingestion")
    messages = file_messages(spark, args.message_folder) if args.message_folder else kafka_messages(spark, servers=args.servers or "", topic=args.topic, starting_offsets=args.starting_offsets)
    run_until_done(spark, start_ingestion(messages, paths, watermark=args.watermark, trigger=args.trigger).values())


def risk_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Silver events to hourly risk windows")
    p.add_argument("--silver", required=True)
    p.add_argument("--output-root", required=True)
    p.add_argument("--checkpoint-root", required=True)
    p.add_argument("--window", default=DEFAULT_WINDOW)
    p.add_argument("--watermark", default=DEFAULT_WATERMARK)
    p.add_argument("--trigger", default=DEFAULT_TRIGGER)
    p.add_argument("--max-files", type=int)
    return p


def risk_job(argv: list[str] | None = None) -> None:
    args = risk_parser().parse_args(argv)
    paths = StreamPaths(args.output_root, args.checkpoint_root)
    spark = create_session("riskweave-risk")
    silver = silver_stream(spark, args.silver, max_files=args.max_files)
    run_until_done(spark, start_risk(silver, paths, window=args.window, watermark=args.watermark, trigger=args.trigger).values())
