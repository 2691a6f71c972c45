"""Every registered query against its SQL, and the plans that matter at scale."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from contract.oracle import ORACLE_SQL
from contract.queries import (
    EVENT_SPEC,
    NTZ,
    QUERIES,
    before,
    customer_events,
    dedupe_latest,
    from_cut,
    gold_customer_daily,
    incremental_read,
    scd2_history_events,
    scd2_merge_step,
)
from tests.oracle_check import differences, oracle_connection
from tidemark.operators import read_increment
from tidemark.plans import DimensionStore
from tidemark.sources import read_bronze

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


def test_every_query_has_its_sql():
    """The training-data queries, most of which are beyond SQL, have tests of their own."""
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    """Also that the library's own queries have no Python in their plans."""
    result = contract.queries()[name](spark, SF)
    assert differences(result, con, contract.oracle_sql()[name]) == []
    if name in QUERIES:
        text = plan(result)
        assert "Python" not in text and "Arrow" not in text


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["day", "customer_status", "cnt"]
    assert result.count() > 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_per_key_reduces_before_the_shuffle(spark):
    text = plan(dedupe_latest(spark, SF))
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")


def test_increment_bound_reaches_the_scan(spark):
    assert "GreaterThanOrEqual(ts," in plan(incremental_read(spark, SF))


def test_increment_bound_prunes_days(spark, root):
    days = customer_events(spark, SF).withColumn("updated_day", F.to_date("updated_at"))
    days.write.partitionBy("updated_day").parquet(f"{root}/days")
    mark = F.lit("2024-01-20 12:00:00").cast(NTZ)
    text = plan(read_increment(spark.read.parquet(f"{root}/days"), mark, day_column="updated_day"))
    filters = text.split("PartitionFilters: [")[1].split("]")[0]
    assert "updated_day" in filters and ">= 2024-01-20" in filters


def test_history_shuffles_once(spark):
    assert plan(scd2_history_events(spark, SF)).count("Exchange") == 1


def test_merge_of_staged_rows_shuffles_each_side_once(spark):
    assert plan(scd2_merge_step(spark, SF)).split("SortMergeJoin")[1].count("Exchange") == 2


@pytest.mark.parametrize("late", ["ignore", "splice"])
def test_store_merge_shuffles_the_batch_only(spark, root, monkeypatch, late):
    """What is kept goes from the bucketed scan to the write without an exchange, and unsorted for a small batch."""
    events = customer_events(spark, SF)
    store = DimensionStore(spark, root, EVENT_SPEC, key_type="bigint", ts_type=NTZ, buckets=4, late=late)
    store.run(before(events))
    staged = store._pin(from_cut(events), 2)
    rows = staged.count()
    hashed = plan(store._next_rows(store.last_commit(), staged, rows, 4))
    monkeypatch.setattr("tidemark.plans.dimension.HASHED_KEYS", 0)
    sorted_ = plan(store._next_rows(store.last_commit(), staged, rows, 4))
    for text, join in ((hashed, "ShuffledHashJoin"), (sorted_, "SortMergeJoin")):
        kept = text[text.index("Union"):].split("Bucketed: true")[0]
        assert join in kept and "Exchange" not in kept
        assert ("Sort [" in kept) == (join == "SortMergeJoin")


def test_splicing_changes_no_result_of_batches_in_order(spark, con, monkeypatch):
    real = DimensionStore.__init__
    monkeypatch.setattr(DimensionStore, "__init__", lambda self, *args, **given: real(self, *args, **given, late="splice"))
    name = "scd2_incremental"
    assert differences(contract.queries()[name](spark, SF), con, contract.oracle_sql()[name]) == []


def test_mart_spreads_the_distinct_count(spark):
    text = plan(gold_customer_daily(spark, SF))
    assert text.count("HashAggregate") == 4


def test_rejected_partition_is_pruned(spark, root):
    from contract.queries import cdc_to_json, parse, with_source_seq
    from tidemark.sinks import write_bronze

    write_bronze(parse(with_source_seq(cdc_to_json(spark, SF))), root)
    text = plan(read_bronze(spark, root, key_type="bigint", ts_type=NTZ))
    assert "rejected" in text.split("PartitionFilters: [")[1].split("]")[0]
