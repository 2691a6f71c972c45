"""Messages, ingest and the generator."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import iso_seconds, parse_timestamp
from tidemark.operators import accepted, cdc_messages, parse_cdc, rejected
from tidemark.schemas import MESSAGE_FIELDS, message_schema
from tidemark.sinks import to_text, write_bronze
from tidemark.sources.messages import kafka_positions
from tidemark.operators.scd2 import MESSAGE_TIES, Scd2Spec, stage_changes
from tidemark.sources import (
    event_clock,
    generate_events,
    rate_rows,
    read_bronze,
    sequence_rows,
    text_messages,
)
from tidemark.streaming import ingest

GOOD = (
    '{"op":"I","event_ts":"2026-03-13T10:00:00+00:00","customer_id":1,"name":"customer_1","status":"vip",'
    '"updated_at":"2026-03-13T10:00:00+00:00","source":"s"}'
)
BAD = {
    "not json": "malformed",
    "": "malformed",
    "[1, 2": "malformed",
    None: "null_message",
    GOOD.replace('"customer_id":1', '"customer_id":"x"'): "malformed",
    GOOD.replace('"customer_id":1,', ""): "missing_customer_id",
    GOOD.replace('"op":"I",', ""): "missing_op",
    "{}": "missing_op",
    GOOD.replace('"updated_at":"2026-03-13T10:00:00+00:00"', '"updated_at":"someday"'): "bad_updated_at",
    GOOD.replace('"event_ts":"2026-03-13T10:00:00+00:00"', '"event_ts":"2026-13-13"'): "bad_event_ts",
    GOOD.replace('"event_ts":"2026-03-13T10:00:00+00:00"', '"event_ts":null'): "missing_event_ts",
}


def messages(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string").select(
        F.col("value").cast("binary").alias("value"), F.lit(None).cast("bigint").alias("source_seq")
    )


def test_rejects_carry_reason_and_text(spark):
    parsed = parse_cdc(messages(spark, GOOD, *BAD), message_schema())
    assert accepted(parsed).count() == 1
    assert {r.raw: r.reject_reason for r in rejected(parsed).collect()} == BAD


def test_good_event_is_typed(spark):
    row = accepted(parse_cdc(messages(spark, GOOD), message_schema(), ts_type="timestamp_ntz")).first()
    at = dt.datetime(2026, 3, 13, 10)
    assert (row.op, row.customer_id, row.status, row.event_ts, row.updated_at) == ("I", 1, "vip", at, at)
    assert row.updated_day == at.date()


def test_unknown_field_is_dropped(spark):
    parsed = parse_cdc(messages(spark, GOOD.replace('"source":"s"', '"source":"s","more":[1]')), message_schema())
    assert accepted(parsed).count() == 1
    assert "more" not in parsed.columns


def test_message_sequence_wins_over_source_position(spark):
    two = messages(spark, GOOD, GOOD.replace('"source":"s"', '"source":"s","seq":7')).withColumn(
        "source_seq", F.lit(3).cast("bigint")
    )
    assert sorted(r.seq for r in parse_cdc(two, message_schema()).collect()) == [3, 7]


def test_keep_malformed_gives_all_null_events(spark):
    events = accepted(parse_cdc(messages(spark, GOOD, *BAD), message_schema()), keep_malformed=True)
    assert events.count() == 1 + len(BAD)
    assert events.where("op IS NULL AND customer_id IS NULL AND updated_at IS NULL").count() == len(BAD)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2026-03-13T10:00:00+00:00", "2026-03-13 10:00:00"),
        ("2026-03-13T10:00:00+03:00", "2026-03-13 07:00:00"),
        ("2026-03-13T10:00:00.123456Z", "2026-03-13 10:00:00.123456"),
        ("2026-03-13 10:00:00", "2026-03-13 10:00:00"),
        ("tomorrow", None),
        (None, None),
    ],
)
def test_parse_timestamp(spark, text, expected):
    for ts_type in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame([(text,)], "t string").select(parse_timestamp(F.col("t"), ts_type).cast("string"))
        assert df.first()[0] == expected


def run_ingest(spark, root):
    ingest(text_messages(spark, f"{root}/in"), f"{root}/bronze", f"{root}/ck", available_now=True).awaitTermination()


def test_stream_restart_adds_only_new_files(spark, root):
    first = spark.createDataFrame([(GOOD,), ("broken",)], "value string")
    to_text(first, f"{root}/in")
    for _ in range(2):
        run_ingest(spark, root)
        assert read_bronze(spark, f"{root}/bronze").count() == 1
        assert read_bronze(spark, f"{root}/bronze", rejected=True).select("reject_reason", "raw").collect() == [
            ("malformed", "broken")
        ]
    second = GOOD.replace('"customer_id":1', '"customer_id":2')
    to_text(spark.createDataFrame([(second,)], "value string"), f"{root}/in")
    run_ingest(spark, root)
    assert sorted(r.customer_id for r in read_bronze(spark, f"{root}/bronze").collect()) == [1, 2]


@pytest.mark.parametrize("files_per_day", [1, 3])
def test_a_micro_batch_writes_few_files_a_day(spark, root, files_per_day):
    texts = [(GOOD.replace("03-13", f"03-{10 + i % 4}"),) for i in range(400)] + [("broken",)]
    spark.createDataFrame(texts, "value string").repartition(20).write.text(f"{root}/in")
    source = text_messages(spark, f"{root}/in")
    ingest(source, f"{root}/b", f"{root}/ck", available_now=True, files_per_day=files_per_day).awaitTermination()
    assert read_bronze(spark, f"{root}/b").count() == 400
    files = spark.read.parquet(f"{root}/b").select("updated_day", F.input_file_name().alias("f")).distinct()
    assert max(r["count"] for r in files.groupBy("updated_day").count().collect()) <= files_per_day


def test_ingest_may_keep_malformed_messages_as_null_events(spark, root):
    to_text(spark.createDataFrame([(GOOD,), ("broken",)], "value string"), f"{root}/in")
    source = text_messages(spark, f"{root}/in")
    ingest(source, f"{root}/b", f"{root}/ck", available_now=True, keep_malformed=True).awaitTermination()
    rows = read_bronze(spark, f"{root}/b").select("customer_id", "status").collect()
    assert sorted(map(tuple, rows), key=str) == [(1, "vip"), (None, None)]


def test_offsets_of_two_partitions_do_not_decide(spark):
    """The busier partition has the higher offset, the other one the later record."""
    early, late = dt.datetime(2026, 3, 13, 10), dt.datetime(2026, 3, 13, 11)
    records = spark.createDataFrame(
        [(GOOD, early, 900), (GOOD.replace("vip", "active"), late, 5)], "value string, timestamp timestamp, offset long"
    )
    parsed = parse_cdc(kafka_positions(records), message_schema())
    assert stage_changes(accepted(parsed), Scd2Spec(tie_break=MESSAGE_TIES)).first().status == "active"
    own = records.withColumn("value", F.replace("value", F.lit('"s"}'), F.concat(F.lit('"s","seq":'), "offset", F.lit("}"))))
    parsed = parse_cdc(kafka_positions(own), message_schema())
    assert stage_changes(accepted(parsed), Scd2Spec(tie_break=MESSAGE_TIES)).first().status == "vip"


def test_messages_may_carry_their_key(spark):
    events = generate_events(sequence_rows(spark, 3), max_id=5)
    assert cdc_messages(events, MESSAGE_FIELDS, key="customer_id").columns == ["key", "value"]


def test_bronze_is_partitioned_by_day(spark, root):
    later = GOOD.replace("03-13", "03-14")
    write_bronze(parse_cdc(messages(spark, GOOD, later, "broken"), message_schema()), f"{root}/bronze")
    day = read_bronze(spark, f"{root}/bronze").where("updated_day = date'2026-03-14'")
    assert day.count() == 1
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "updated_day" in plan.split("PartitionFilters")[1].split("]")[0]


def test_generated_events_are_valid_messages(spark, root):
    events = generate_events(sequence_rows(spark, 500), max_id=20, seed=3)
    to_text(cdc_messages(events, MESSAGE_FIELDS), f"{root}/in")
    parsed = parse_cdc(text_messages(spark, f"{root}/in", streaming=False), message_schema())
    rows = accepted(parsed).collect()
    assert len(rows) == 500
    assert {r.customer_id for r in rows} == set(range(1, 21))
    assert {r.status for r in rows} == {"active", "inactive", "vip"}
    assert {r.op for r in rows} == {"I", "U"}
    assert all(r.name == f"customer_{r.customer_id}" and r.source == "demo-generator" for r in rows)
    assert all(r.updated_at.microsecond == 0 for r in rows)


def test_generator_repeats_itself_for_any_partitioning(spark):
    clock = F.lit("2026-01-01 00:00:00").cast("timestamp")
    rows = sequence_rows(spark, 100)
    one = generate_events(rows.coalesce(1), seed=5, clock=clock)
    many = generate_events(rows.repartition(7), seed=5, clock=clock)
    assert sorted(one.collect()) == sorted(many.collect())
    assert sorted(generate_events(rows, seed=6, clock=clock).collect()) != sorted(one.collect())


def test_generator_streams(spark):
    events = generate_events(rate_rows(spark, 10), clock=F.col("at"))
    assert events.isStreaming
    assert events.columns == [*MESSAGE_FIELDS, "seq"]


def test_iso_seconds(spark):
    fixed = F.lit("2026-03-13 10:00:00.9").cast("timestamp")
    row = spark.range(1).select(iso_seconds(fixed), iso_seconds(event_clock())).first()
    assert row[0] == "2026-03-13T10:00:00+00:00"
    assert row[1].endswith("+00:00") and len(row[1]) == 25
