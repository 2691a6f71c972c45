"""Command line: one subcommand per job."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.operators.cdc import cdc_messages
from tidemark.operators.scd2 import MESSAGE_TIES, Scd2Spec
from tidemark.plans.layers import ChainConfig, build_gold, create_layers, export_gold, refresh_layers, run_silver
from tidemark.plans.mart import maintain_gold
from tidemark.plans.quarantine import replay_rejects
from tidemark.plans.rowlevel import RowLevelLayers
from tidemark.schemas import SEQUENCED_FIELDS, message_schema
from tidemark.session import build_session, catalog_conf
from tidemark.settings import Settings
from tidemark.sinks.messages import to_kafka, to_text
from tidemark.sinks.serving import JdbcTarget, PathTarget, export, replace_from_lines
from tidemark.sinks.tables import FILES_PER_DAY
from tidemark.sources.generator import generate_events, rate_rows, sequence_rows
from tidemark.sources.lines import lines_from_files, lines_from_text
from tidemark.sources.messages import kafka_messages, text_messages
from tidemark.streaming.ingest import ingest


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidemark")
    commands = parser.add_subparsers(dest="command", required=True)
    generate = commands.add_parser("generate", help="write synthetic change messages")
    generate.add_argument("--files", help="folder for message files; default is the topic")
    generate.add_argument("--count", type=int, help="write this many and stop; default is an endless stream")
    generate.add_argument("--seed", type=int, default=0)
    bronze = commands.add_parser("bronze", help="stream messages into the bronze table")
    bronze.add_argument("--files", help="folder of message files; default is the topic")
    bronze.add_argument("--available-now", action="store_true")
    bronze.add_argument("--every", help="pause between micro-batches, such as '1 minute'")
    bronze.add_argument("--max-per-trigger", type=int, help="bound on offsets or files of a micro-batch")
    bronze.add_argument("--files-per-day", type=int, default=FILES_PER_DAY, help="bound for one micro-batch")
    bronze.add_argument("--keep-malformed", action="store_true", help="store rejects as NULL events")
    bronze.add_argument("--once", help="store a message once within that time, such as '7 days'")
    silver = commands.add_parser("silver", help="merge new changes into the dimension")
    silver.add_argument("--buckets", type=int, help="bucket count of the open rows")
    silver.add_argument("--hash-mode", choices=("framed", "compat"), default="framed", help="form of the fingerprint")
    silver.add_argument("--lookback", help="also read changes this far below the mark, such as '2 days'")
    silver.add_argument("--late", choices=("ignore", "splice"), default="ignore", help="what late changes do; folders only")
    silver.add_argument("--by-position", action="store_true", help="read behind the last source positions; folders only")
    gold = commands.add_parser("gold", help="build the daily mart")
    gold.add_argument("--mode", choices=("full", "partitions", "deltas"), default="full", help="deltas: folders only")
    commands.add_parser("replay", help="judge quarantined messages again; folders only")
    export = commands.add_parser("export", help="replace the serving table")
    load = commands.add_parser("load", help="replace it from text lines")
    load.add_argument("--lines", help="text files; default is CUSTOMER_DAILY_ROWS")
    for command in (export, load):
        command.add_argument("--path", help="sorted Parquet folder; default is JDBC")
    tables = commands.add_parser("tables", help="create or refresh the catalog entries")
    for command in (bronze, silver, gold, export, tables):
        command.add_argument("--catalog", help="catalog of row-level tables; default is Parquet folders")
    return parser


def generate(spark: SparkSession, settings: Settings, args: argparse.Namespace) -> None:
    endless = args.count is None and settings.events_per_sec > 0
    if args.count is None and (args.files or not endless):
        raise SystemExit("message files, and a rate of zero or less, need --count")
    rows = rate_rows(spark, settings.events_per_sec) if endless else sequence_rows(spark, args.count)
    clock = F.col("at") if endless else None
    events = generate_events(rows, settings.max_customer_id, args.seed, clock=clock)
    messages = cdc_messages(events, SEQUENCED_FIELDS, key="customer_id")
    if args.files:
        to_text(messages, args.files)
    else:
        checkpoint = settings.path("checkpoints", "producer")
        query = to_kafka(messages, settings.brokers, settings.topic, checkpoint)
        if query:
            query.awaitTermination()


def bronze(spark: SparkSession, settings: Settings, args: argparse.Namespace) -> None:
    if args.files:
        source = text_messages(spark, args.files, max_files_per_trigger=args.max_per_trigger)
    else:
        options = {"maxOffsetsPerTrigger": str(args.max_per_trigger)} if args.max_per_trigger else {}
        source = kafka_messages(spark, settings.brokers, settings.topic, options=options)
    trigger = {
        "available_now": args.available_now,
        "every": args.every,
        "files_per_day": args.files_per_day,
        "keep_malformed": args.keep_malformed,
        "once": args.once,
    }
    checkpoint = settings.bronze_checkpoint
    if args.catalog:
        query = RowLevelLayers(args.catalog).ingest(source, checkpoint, **trigger)
    else:
        query = ingest(source, settings.bronze_path, checkpoint, **trigger)
    query.awaitTermination()


def load(spark: SparkSession, settings: Settings, args: argparse.Namespace) -> None:
    lines = lines_from_files(spark, args.lines) if args.lines else lines_from_text(spark, settings.daily_rows)
    print(f"loaded {replace_from_lines(lines, _target(settings, args))} rows")


def _target(settings: Settings, args: argparse.Namespace) -> JdbcTarget | PathTarget:
    return PathTarget(args.path) if args.path else JdbcTarget.from_settings(settings)


def main(argv: Sequence[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    settings = Settings.from_env()
    catalog = getattr(args, "catalog", None)
    extra = {}
    if catalog and settings.catalog_kind:
        extra = catalog_conf(catalog, settings.catalog_kind, settings.warehouse, settings.catalog_uri)
    spark = build_session(f"tidemark-{args.command}", settings, None, extra)
    spec = Scd2Spec(tie_break=MESSAGE_TIES, hash_mode=getattr(args, "hash_mode", "framed"))
    layers = RowLevelLayers(catalog, spec=spec, pipeline=settings.pipeline) if catalog else None

    if args.command == "generate":
        generate(spark, settings, args)
    elif args.command == "bronze":
        bronze(spark, settings, args)
    elif args.command == "load":
        load(spark, settings, args)
    elif layers:
        run_on_tables(spark, settings, args, layers)
    else:
        run_on_folders(spark, settings, args, spec)


def run_on_folders(spark: SparkSession, settings: Settings, args: argparse.Namespace, spec: Scd2Spec) -> None:
    config = ChainConfig(
        settings, spec, buckets=getattr(args, "buckets", None), late=getattr(args, "late", "ignore"),
        by_position=getattr(args, "by_position", False))
    if args.command == "silver":
        run_silver(spark, config, args.lookback)
    elif args.command == "replay":
        print(f"moved {replay_rejects(spark, settings.bronze_path, message_schema())} messages")
    elif args.command == "gold" and args.mode == "deltas":
        maintain_gold(config.store(spark), settings.gold_path)
    elif args.command == "gold":
        build_gold(config.store(spark).current(), settings.gold_path, config.spec, mode=args.mode)
    elif args.command == "export":
        export_gold(spark, settings.gold_path, _target(settings, args))
    else:
        create_layers(spark, config)
        refresh_layers(spark, config)


def run_on_tables(
    spark: SparkSession, settings: Settings, args: argparse.Namespace, layers: RowLevelLayers
) -> None:
    if args.command == "silver":
        layers.run_silver(spark, args.lookback)
    elif args.command == "gold":
        layers.run_gold(spark, mode=args.mode)
    elif args.command == "export":
        export(spark.table(layers.gold), _target(settings, args))
    else:
        layers.create(spark)


if __name__ == "__main__":
    main()
