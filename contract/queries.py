"""One Spark query per operator, over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import hashdiff, parse_timestamp
from tidemark.operators import (
    Scd2Spec,
    accepted,
    build_daily,
    cdc_messages,
    changed_keys,
    current_mark,
    fetch_mark,
    join_as_of,
    latest_per_key,
    new_keys,
    next_mark,
    open_versions,
    parse_cdc,
    read_increment,
    scd2_apply,
    scd2_history,
    stage_changes,
)
from tidemark.operators.positions import PART, POSITION
from tidemark.plans import DimensionStore, build_gold, maintain_gold, replay_rejects, run_chain
from tidemark.plans.layers import ChainConfig, create_layers, ingest_files, read_gold, refresh_layers, run_silver
from tidemark.schemas import message_schema
from tidemark.session import scratch_dir, use_utc
from tidemark.settings import Settings
from tidemark.sinks import PathTarget, append, export, replace_from_lines, to_text, write_bronze
from tidemark.plans.rowlevel import merge_source
from tidemark.sources import generate_events, lines_from_files, read_bronze, text_messages
from tidemark.streaming import ingest, upsert_stream

NTZ = "timestamp_ntz"
KEY_TYPE = "bigint"
SOURCE = "events"
PIPELINE = "dim_customer_scd2"
CUT = "2024-01-16 00:00:00"
YEAR = "1996-01-01 00:00:00"
CUTS = ("2024-01-11 00:00:00", "2024-01-21 00:00:00")

EVENT_SPEC = Scd2Spec(tie_break=("seq",))
ORDER_SPEC = Scd2Spec("o_custkey", ("o_orderstatus", "o_orderpriority"), "o_orderdate", ("o_orderkey",))
LINE_SPEC = Scd2Spec("l_partkey", ("l_returnflag", "l_linestatus"), "l_shipdate", ("l_orderkey", "l_linenumber"))
DELETE_SPEC = Scd2Spec(tie_break=("seq",), deletes="op")
#: Orders come in batches of some years, the batches in another order and one of them twice.
ORDER_CUTS = ("1994-01-01 00:00:00", "1996-01-01 00:00:00", "1997-01-01 00:00:00")
ARRIVALS = (2, 0, 3, 2, 1)
DELIVERIES = 3
MESSAGE = ["op", "event_ts", "customer_id", "name", "status", "updated_at", "source", "seq"]

# Near the usual count per customer, so that about half of them take the plan for hot keys.
FEW_ROWS = 66
# The same for line items per part.
FEW_LINES = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def customer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as customer changes: the user is the customer, the event type its status."""
    return table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "signup", "I").otherwise("U").alias("op"),
        F.col("ts").alias("event_ts"),
        F.col("user_id").alias("customer_id"),
        F.concat(F.lit("customer_"), F.col("user_id").cast("string")).alias("name"),
        F.col("event_type").alias("status"),
        F.col("ts").alias("updated_at"),
        F.lit(SOURCE).alias("source"),
        F.col("event_id").alias("seq"),
    )


def at(text: str) -> Column:
    return F.lit(text).cast(NTZ)


def before(events: DataFrame, cut: str = CUT) -> DataFrame:
    return events.where(F.col("updated_at") < at(cut))


def from_cut(events: DataFrame, cut: str = CUT) -> DataFrame:
    return events.where(F.col("updated_at") >= at(cut))


def parse(messages: DataFrame) -> DataFrame:
    return parse_cdc(messages, message_schema(key_type=KEY_TYPE), ts_type=NTZ)


def with_source_seq(messages: DataFrame) -> DataFrame:
    return messages.select(F.col("value").cast("binary").alias("value"), F.lit(None).cast("bigint").alias("source_seq"))


# Messages


def cdc_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return generate_events(
        orders, max_id=200, seed=7, seq="o_orderkey", clock=F.col("o_orderdate"), key_type=KEY_TYPE
    )


def cdc_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc_messages(customer_events(spark, sf_dir), MESSAGE)


def cdc_parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = with_source_seq(cdc_to_json(spark, sf_dir))
    return accepted(parse(messages)).select(*MESSAGE)


def cdc_parse_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.from_json("props", "k int").alias("r")).select("event_id", "r.*")


def cdc_parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("not a time "), F.col("props"))).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    )
    return table(spark, sf_dir, "events").select("event_id", parse_timestamp(text, NTZ).alias("parsed"))


def order_messages(spark: SparkSession, sf_dir: str, unit: str = "second") -> DataFrame:
    """`orders` as messages; open orders are sound, the others are damaged by priority. Times are cut to `unit`."""
    priority = F.col("o_orderpriority")
    when = F.date_format(F.date_trunc(unit, "o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss")

    def text(key: Column, updated_at: Column) -> Column:
        return F.to_json(
            F.struct(
                F.lit("U").alias("op"),
                when.alias("event_ts"),
                key.alias("customer_id"),
                F.col("o_orderstatus").alias("status"),
                updated_at.alias("updated_at"),
                F.col("o_orderkey").alias("seq"),
            )
        )

    key = F.col("o_custkey")
    value = (
        F.when(F.col("o_orderstatus") == "O", text(key, when))
        .when(priority == "1-URGENT", F.concat(F.lit("not json "), key.cast("string")))
        .when(priority == "2-HIGH", F.lit(None).cast("string"))
        .when(priority == "3-MEDIUM", text(F.concat(F.lit("x"), key.cast("string")), when))
        .when(priority == "4-NOT SPECIFIED", text(F.lit(None).cast("bigint"), when))
        .otherwise(text(key, F.lit("someday")))
    )
    return table(spark, sf_dir, "orders").select(value.alias("value"))


def cdc_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse(with_source_seq(order_messages(spark, sf_dir)))
    return parsed.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(
        F.count("*").alias("cnt"),
        F.count("raw").alias("raw_texts"),
        F.sum(F.when(~F.col("rejected"), F.col("customer_id"))).alias("accepted_ids"),
    )


# Bronze


def bronze_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "bronze")
    to_text(cdc_to_json(spark, sf_dir), f"{root}/messages")
    ingest(
        text_messages(spark, f"{root}/messages"),
        f"{root}/bronze",
        f"{root}/checkpoint",
        schema=message_schema(key_type=KEY_TYPE),
        ts_type=NTZ,
        available_now=True,
    ).awaitTermination()
    bronze = read_bronze(spark, f"{root}/bronze", key_type=KEY_TYPE, ts_type=NTZ)
    return bronze.groupBy("updated_day").agg(F.count("*").alias("cnt"))


def bronze_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "ingest")
    to_text(cdc_to_json(spark, sf_dir), f"{root}/messages")
    for _ in range(2):
        ingest(
            text_messages(spark, f"{root}/messages"),
            f"{root}/bronze",
            f"{root}/checkpoint",
            schema=message_schema(key_type=KEY_TYPE),
            ts_type=NTZ,
            available_now=True,
        ).awaitTermination()
    return read_bronze(spark, f"{root}/bronze", key_type=KEY_TYPE, ts_type=NTZ).select(*MESSAGE, "updated_day")


def bronze_replay_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that are delivered three times, under other file names, and stored once."""
    root = scratch_dir(spark, "replayed")
    for _ in range(3):
        to_text(cdc_to_json(spark, sf_dir), f"{root}/messages")
        ingest(
            text_messages(spark, f"{root}/messages"),
            f"{root}/bronze",
            f"{root}/checkpoint",
            schema=message_schema(key_type=KEY_TYPE),
            ts_type=NTZ,
            available_now=True,
            once="7 days",
        ).awaitTermination()
    return read_bronze(spark, f"{root}/bronze", key_type=KEY_TYPE, ts_type=NTZ).select(*MESSAGE)


def quarantine_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages judged under a schema that asks for a name, then twice under one that doesn't."""
    path = f"{scratch_dir(spark, 'quarantine')}/bronze"
    schema = message_schema(key_type=KEY_TYPE)
    strict = T.StructType([T.StructField(f.name, f.dataType, f.nullable and f.name != "name") for f in schema.fields])
    messages = order_messages(spark, sf_dir, "month")
    write_bronze(parse_cdc(with_source_seq(messages), strict, ts_type=NTZ), path)
    for _ in range(2):
        replay_rejects(spark, path, schema, key_type=KEY_TYPE, ts_type=NTZ)
    events = read_bronze(spark, path, key_type=KEY_TYPE, ts_type=NTZ)
    left = read_bronze(spark, path, rejected=True, key_type=KEY_TYPE, ts_type=NTZ)
    ids = F.sum("customer_id").alias("ids")
    moved = events.groupBy(F.lit("accepted").alias("reason")).agg(F.count("*").alias("cnt"), ids)
    return moved.unionByName(
        left.groupBy(F.col("reject_reason").alias("reason")).agg(
            F.count("*").alias("cnt"), F.lit(None).cast("bigint").alias("ids")))


# Increments


def mark_log(events: DataFrame) -> DataFrame:
    return events.select(F.lit(PIPELINE).alias("pipeline"), F.col("updated_at").alias("updated_at_gte"))


def watermark_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = customer_events(spark, sf_dir)
    log = events.select(F.col("status").alias("pipeline"), F.col("updated_at").alias("updated_at_gte"))
    return current_mark(log, by_pipeline=True)


def watermark_of_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is new for one pipeline of a log that several write to."""
    events = customer_events(spark, sf_dir)
    log = before(events).select(F.col("status").alias("pipeline"), F.col("updated_at").alias("updated_at_gte"))
    mark = fetch_mark(log, "click")
    return read_increment(events, mark).select("seq", "customer_id", "status", "updated_at")


def scd2_history_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches by sequence, several of which share a day's time; half of the keys take the plan for hot ones."""
    events = customer_events(spark, sf_dir).withColumn("updated_at", F.date_trunc("day", "updated_at").cast(NTZ))
    batch = F.floor(F.col("seq") / 150)
    few = scd2_history(events.where("customer_id % 2 = 0"), EVENT_SPEC, batch)
    return few.unionByName(scd2_history(events.where("customer_id % 2 = 1"), EVENT_SPEC, batch, hot_rows=3))


def watermark_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "watermarks")
    events = customer_events(spark, sf_dir)
    for batch in (before(events), from_cut(events)):
        append(next_mark(batch, PIPELINE), path)
    return spark.read.parquet(path).select("pipeline", "updated_at_gte")


def incremental_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = customer_events(spark, sf_dir)
    mark = fetch_mark(mark_log(before(events)), PIPELINE)
    return read_increment(events, mark).select("seq", "customer_id", "status", "updated_at")


def dedupe_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per_key(customer_events(spark, sf_dir), ["customer_id"], "updated_at", ["seq"])


def dedupe_latest_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"])


# Type-2 dimension


def scd2_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = stage_changes(customer_events(spark, sf_dir), EVENT_SPEC)
    return staged.withColumn("hashdiff_compat", hashdiff(EVENT_SPEC.tracked, "compat"))


def _around_cut(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = customer_events(spark, sf_dir)
    dimension = open_versions(stage_changes(before(events), EVENT_SPEC), EVENT_SPEC)
    return dimension, stage_changes(from_cut(events), EVENT_SPEC)


def scd2_changed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_keys(*_around_cut(spark, sf_dir), EVENT_SPEC)


def scd2_new_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose first order falls in the orders' last years."""
    orders = table(spark, sf_dir, "orders")
    cut = at("1996-01-01 00:00:00")
    current = open_versions(stage_changes(orders.where(F.col("o_orderdate") < cut), ORDER_SPEC), ORDER_SPEC)
    staged = stage_changes(orders.where(F.col("o_orderdate") >= cut), ORDER_SPEC)
    return new_keys(current, staged, ORDER_SPEC)


def scd2_merge_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scd2_apply(*_around_cut(spark, sf_dir), EVENT_SPEC)


def scd2_merge_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    dimension, staged = _around_cut(spark, sf_dir)
    return merge_source(staged, dimension, EVENT_SPEC)


def _store(spark: SparkSession, label: str) -> DimensionStore:
    return DimensionStore(
        spark, scratch_dir(spark, label), EVENT_SPEC, PIPELINE, key_type=KEY_TYPE, ts_type=NTZ
    )


def scd2_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over a growing table, each run twice."""
    events = customer_events(spark, sf_dir)
    store = _store(spark, "dimension")
    for arrived in (*[before(events, cut) for cut in CUTS], events):
        store.run(arrived)
        store.run(arrived)
    return store.dimension()


def scd2_late_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of orders that come out of order, put between the versions that are there."""
    orders = table(spark, sf_dir, "orders")
    store = DimensionStore(
        spark, scratch_dir(spark, "late"), ORDER_SPEC, PIPELINE, KEY_TYPE, NTZ, late="splice",
        tie_types={"o_orderkey": "bigint"})
    bounds = [None, *ORDER_CUTS, None]
    for number in ARRIVALS:
        part = orders if bounds[number] is None else orders.where(F.col("o_orderdate") >= at(bounds[number]))
        store.apply(part if bounds[number + 1] is None else part.where(F.col("o_orderdate") < at(bounds[number + 1])))
    return store.dimension()


def scd2_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four producers' events in three deliveries, each with all days: read by position, each delivery twice."""
    events = customer_events(spark, sf_dir).withColumn("source", F.concat(F.lit("p"), F.col("customer_id") % 4))
    last = events.agg(F.max("seq")).first()[0] or 0
    root = scratch_dir(spark, "positions")
    config = ChainConfig(Settings(warehouse=f"{root}/warehouse"), EVENT_SPEC, KEY_TYPE, NTZ)
    store = DimensionStore(
        spark, f"{root}/silver", EVENT_SPEC, PIPELINE, KEY_TYPE, NTZ, late="splice", positions=(PART, POSITION))
    for number in range(DELIVERIES):
        part = events.where(F.floor(F.col("seq") * DELIVERIES / (last + 1)) == number)
        to_text(cdc_messages(part, MESSAGE), f"{root}/messages")
        ingest_files(spark, config, f"{root}/messages")
        for _ in range(2):
            store.run(config.bronze(spark), day_column="updated_day")
    return store.dimension()


def customer_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as customer changes, errors being deletes."""
    deleted = F.when(F.col("status") == "error", "D").otherwise(F.col("op"))
    return customer_events(spark, sf_dir).withColumn("op", deleted)


def scd2_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions with gaps: from all changes at once, by runs over a growing table, and from a stream."""
    events = customer_deletes(spark, sf_dir)
    time = F.col("updated_at")
    batch = F.when(time < at(CUTS[0]), 0).when(time < at(CUTS[1]), 1).otherwise(2)
    results = {"history": scd2_history(events, DELETE_SPEC, batch, hot_rows=FEW_ROWS)}
    root = scratch_dir(spark, "deletes")
    stores = {
        mode: DimensionStore(spark, f"{root}/{mode}", DELETE_SPEC, PIPELINE, KEY_TYPE, NTZ) for mode in ("merge", "stream")}
    bounds = [None, *CUTS, None]
    for low, high in zip(bounds, bounds[1:]):
        arrived = before(events, high) if high else events
        for _ in range(2):
            stores["merge"].run(arrived)
        part = from_cut(arrived, low) if low else arrived
        to_text(cdc_messages(part, MESSAGE), f"{root}/messages")
        typed = accepted(parse(text_messages(spark, f"{root}/messages")))
        upsert_stream(typed, stores["stream"], f"{root}/checkpoint", available_now=True).awaitTermination()
    results |= {mode: store.dimension() for mode, store in stores.items()}
    named = [rows.withColumn("mode", F.lit(mode)) for mode, rows in results.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


def lines_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the version of their part that was valid when they were shipped; busy parts in slices."""
    lines = table(spark, sf_dir, "lineitem")
    versions = scd2_history(lines, LINE_SPEC, F.year("l_shipdate"))
    facts = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity")
    return join_as_of(
        facts, versions, "l_partkey", "l_shipdate", "l_partkey", ["hashdiff", "effective_from", "effective_to"],
        hot_rows=FEW_LINES)


def scd2_stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same three batches as a stream of message files into bronze and on into the dimension."""
    events = customer_events(spark, sf_dir)
    bounds = [None, *CUTS, None]
    root = scratch_dir(spark, "stream")
    store = _store(spark, "stream-dimension")
    for low, high in zip(bounds, bounds[1:]):
        part = before(events, high) if high else events
        part = from_cut(part, low) if low else part
        to_text(cdc_messages(part, MESSAGE), f"{root}/messages")
        typed = accepted(parse(text_messages(spark, f"{root}/messages")))
        upsert_stream(typed, store, f"{root}/checkpoint", available_now=True).awaitTermination()
    return store.dimension()


def daily_history(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return scd2_history(customer_events(spark, sf_dir), EVENT_SPEC, F.to_date("updated_at"), **options)


def scd2_history_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_history(spark, sf_dir)


def scd2_history_prereduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_history(spark, sf_dir, prereduce=True)


def scd2_history_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scd2_history(table(spark, sf_dir, "orders"), ORDER_SPEC)


def scd2_history_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scd2_history(table(spark, sf_dir, "lineitem"), LINE_SPEC)


def scd2_history_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event, with busy customers on the plan for hot keys."""
    return scd2_history(customer_events(spark, sf_dir), EVENT_SPEC, hot_rows=FEW_ROWS)


def scd2_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_history(spark, sf_dir).where("is_current")


# Mart and serving


def gold_customer_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_daily(daily_history(spark, sf_dir))


def gold_partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mart built before and after the cut, in both modes."""
    events = customer_events(spark, sf_dir)
    root = scratch_dir(spark, "gold")
    results = []
    for mode in ("full", "partitions"):
        for arrived in (before(events), events):
            dimension = open_versions(stage_changes(arrived, EVENT_SPEC), EVENT_SPEC)
            build_gold(dimension, f"{root}/{mode}", EVENT_SPEC, mode=mode)
        results.append(read_gold(spark, f"{root}/{mode}").withColumn("mode", F.lit(mode)))
    return results[0].unionByName(results[1])


def mart_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mart after three increments, of which it rewrote the touched days."""
    events = customer_events(spark, sf_dir)
    path = f"{scratch_dir(spark, 'maintained')}/gold"
    store = _store(spark, "maintained-dimension")
    for arrived in (*[before(events, cut) for cut in CUTS], events):
        store.run(arrived)
        maintain_gold(store, path)
    return read_gold(spark, path)


def gold_sorted_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = PathTarget(scratch_dir(spark, "serving"))
    export(gold_customer_daily(spark, sf_dir), target)
    return spark.read.parquet(target.path)


def csv_lines_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "lines-load")
    mart = gold_customer_daily(spark, sf_dir)
    mart.select(F.format_string("%s, %s ,%s", F.col("day").cast("string"), "customer_status", "cnt")).write.text(
        f"{root}/lines"
    )
    target = PathTarget(f"{root}/serving")
    for _ in range(2):
        replace_from_lines(lines_from_files(spark, f"{root}/lines"), target)
    return spark.read.parquet(target.path)


def medallion_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages to serving rows in two increments around the cut."""
    events = customer_events(spark, sf_dir)
    root = scratch_dir(spark, "medallion")
    config = ChainConfig(
        Settings(warehouse=f"{root}/warehouse"), Scd2Spec(tie_break=("seq",)), key_type=KEY_TYPE, ts_type=NTZ
    )
    target = PathTarget(f"{root}/serving")
    for part in (before(events), from_cut(events)):
        to_text(cdc_messages(part, MESSAGE), f"{root}/messages")
        run_chain(spark, config, f"{root}/messages", target)
    return spark.read.parquet(target.path)


def order_ties_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages, through ingest and two silver runs; orders of one customer and year tie by number."""
    root = scratch_dir(spark, "ties")
    config = ChainConfig(Settings(warehouse=f"{root}/warehouse"), key_type=KEY_TYPE, ts_type=NTZ)
    orders = table(spark, sf_dir, "orders").select(
        F.lit("U").alias("op"),
        F.col("o_orderdate").cast(NTZ).alias("event_ts"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_orderstatus").alias("status"),
        F.date_trunc("year", "o_orderdate").cast(NTZ).alias("updated_at"),
        F.lit("orders").alias("source"),
        F.col("o_orderkey").alias("seq"),
    )
    for part in (before(orders, YEAR), from_cut(orders, YEAR)):
        to_text(cdc_messages(part, MESSAGE), f"{root}/messages")
        ingest_files(spark, config, f"{root}/messages")
        run_silver(spark, config)
    return config.store(spark).dimension()


def layers_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts from silver, gold and the staged batch, read by name after two increments and an empty one."""
    events = customer_events(spark, sf_dir)
    root = scratch_dir(spark, "layers")
    prefix = f"t{uuid.uuid4().hex}_"
    config = ChainConfig(
        Settings(warehouse=f"{root}/warehouse"), EVENT_SPEC, KEY_TYPE, NTZ, prefix=prefix, published=True
    )
    create_layers(spark, config)
    for part in (before(events), from_cut(events)):
        config.store(spark).apply(part.limit(0))
        to_text(cdc_messages(part, MESSAGE), f"{root}/messages")
        run_chain(spark, config, f"{root}/messages", PathTarget(f"{root}/serving"))
    refresh_layers(spark, config)
    config.store(spark).expose_staged(f"{prefix}staged")
    return spark.sql(f"""
        SELECT 'silver' AS layer, to_date(effective_from) AS day, status, count(*) AS cnt
        FROM {prefix}silver.dim_customer GROUP BY 2, 3
        UNION ALL SELECT 'gold', day, customer_status, cnt FROM {prefix}gold.customer_daily
        UNION ALL SELECT 'staged', to_date(updated_at), status, count(*) FROM {prefix}staged GROUP BY 2, 3""")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        cdc_generate,
        cdc_to_json,
        cdc_parse_json,
        cdc_parse_props,
        cdc_parse_timestamps,
        cdc_rejects,
        bronze_by_day,
        bronze_stream_ingest,
        bronze_replay_proof,
        quarantine_replay,
        watermark_current,
        watermark_advance,
        incremental_read,
        dedupe_latest,
        dedupe_latest_ties,
        watermark_of_pipeline,
        scd2_history_batches,
        scd2_stage,
        scd2_changed_keys,
        scd2_new_keys,
        scd2_merge_step,
        scd2_merge_source,
        scd2_incremental,
        scd2_stream_upsert,
        scd2_late_changes,
        scd2_by_position,
        scd2_deletes,
        lines_as_of,
        scd2_history_events,
        scd2_history_prereduced,
        scd2_history_orders,
        scd2_history_lineitem,
        scd2_history_hot_keys,
        scd2_current,
        gold_customer_daily,
        gold_partition_overwrite,
        mart_maintained,
        gold_sorted_export,
        csv_lines_load,
        medallion_end_to_end,
        order_ties_end_to_end,
        layers_by_name,
    )
}
