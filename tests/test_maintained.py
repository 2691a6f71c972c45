"""The mart kept up by deltas, replay-proof ingest, and the replay of rejects."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.test_scd2 import SPEC, T1, T2, T3, changes, new_store
from tidemark.operators import build_daily
from tidemark.operators.mart import apply_deltas, daily_deltas
from tidemark.plans import maintain_gold, mart, replay_rejects
from tidemark.plans.layers import read_gold
from tidemark.schemas import message_schema
from tidemark.sinks import write_bronze
from tidemark.sources import read_bronze, text_messages
from tidemark.operators.cdc import parse_cdc
from tidemark.streaming import ingest

DAY1, DAY2, DAY3 = T1.date(), T2.date(), T3.date()


def gold(spark, path):
    return sorted(map(tuple, read_gold(spark, path).collect()))


def rebuilt(store):
    return sorted(map(tuple, build_daily(store.current()).collect()))


def days_of(path):
    from pathlib import Path

    return sorted(p.name[4:] for p in Path(path).glob("day=*"))


def test_mart_by_deltas_equals_a_rebuild_and_empty_days_go(spark, root):
    store, path = new_store(spark, root), f"{root}/gold"
    assert maintain_gold(store, path) == []
    store.apply(changes(spark, (1, "active", T1), (2, "vip", T1), (3, "vip", T2)))
    maintain_gold(store, path)
    assert gold(spark, path) == rebuilt(store) == [(DAY1, "active", 1), (DAY1, "vip", 1), (DAY2, "vip", 1)]
    untouched = sorted(spark.read.parquet(f"{path}/day={DAY2}").inputFiles())
    store.apply(changes(spark, (1, "vip", T3), (4, "active", T3)))
    store.apply(changes(spark, (2, "active", T3)))
    assert maintain_gold(store, path) == [DAY1, DAY3]  # two runs in one call
    assert gold(spark, path) == rebuilt(store)
    assert days_of(path) == [str(DAY2), str(DAY3)]
    assert sorted(spark.read.parquet(f"{path}/day={DAY2}").inputFiles()) == untouched
    assert maintain_gold(store, path) == []
    store.apply(changes(spark, (1, "vip", T3)))  # alters nothing
    assert maintain_gold(store, path) == [] and gold(spark, path) == rebuilt(store)


def test_mart_follows_spliced_and_deleted_versions(spark, root):
    from tests.test_scd2 import WITH_OP, ops

    store, path = new_store(spark, root, WITH_OP, late="splice"), f"{root}/gold"
    for rows in ([(1, "I", "vip", T3), (2, "I", "vip", T1)], [(1, "U", "vip", T2)], [(2, "D", None, T2)], [(1, "U", "a", T1), (3, "I", "b", T1)]):
        store.apply(ops(spark, *rows))
        maintain_gold(store, path)
        assert gold(spark, path) == rebuilt(store)
    assert gold(spark, path) == [(DAY1, "b", 1), (DAY2, "vip", 1)]


@pytest.mark.parametrize("step", ["overwrite_partitions", "drop_partitions", "_note"])
def test_a_mart_call_that_stops_is_ended_by_the_next(spark, root, monkeypatch, step):
    """Also where the dimension has moved on in between."""
    store, path = new_store(spark, root), f"{root}/gold"
    store.apply(changes(spark, (1, "active", T1), (2, "vip", T1)))
    maintain_gold(store, path)
    store.apply(changes(spark, (1, "vip", T2)))
    real, calls = getattr(mart, step), []

    def stop(*args):
        calls.append(args)
        if step == "_note" and len(calls) == 1:
            return real(*args)  # the note of the beginning
        if step != "_note":
            real(*args)
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(mart, step, stop)
        with pytest.raises(RuntimeError):
            maintain_gold(store, path)
    store.apply(changes(spark, (2, "active", T3), (3, "vip", T1)))
    maintain_gold(store, path)
    assert gold(spark, path) == rebuilt(store) == [(DAY1, "vip", 1), (DAY2, "vip", 1), (DAY3, "active", 1)]


def test_only_touched_days_are_read(spark, root):
    store, path = new_store(spark, root), f"{root}/gold"
    store.apply(changes(spark, (1, "active", T1), (2, "vip", T2)))
    maintain_gold(store, path)
    text = mart.touched_days(spark, path, [DAY2])._jdf.queryExecution().executedPlan().toString()
    filters = text.split("PartitionFilters: [")[1].split("]")[0]
    assert str(DAY2) in filters and str(DAY1) not in filters


def test_deltas_are_applied_once(spark):
    schema = "day date, customer_status string, cnt long, applied long"
    days = spark.createDataFrame([(DAY1, "a", 2, 3), (DAY2, None, 1, 5)], schema)
    deltas = spark.createDataFrame([(DAY1, "a", -2), (DAY1, "b", 1), (DAY2, None, 4), (DAY3, "c", 1)], "day date, customer_status string, delta long")
    found = sorted(map(tuple, apply_deltas(days, deltas, 5).collect()), key=str)
    assert found == sorted([(DAY1, "a", 0, 5), (DAY1, "b", 1, 5), (DAY2, None, 1, 5), (DAY3, "c", 1, 5)], key=str)
    empty = spark.createDataFrame([], "effective_from timestamp, status string")
    assert daily_deltas(empty, empty).count() == 0


# Ingest


def lines(spark, root, name, texts):
    spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.mode("append").text(f"{root}/in")


def message(key, seq, status="vip"):
    tail = "" if seq is None else f', "seq": {seq}'
    return f'{{"op": "U", "event_ts": "{T1.isoformat()}Z", "customer_id": {key}, "status": "{status}", "updated_at": "{T1.isoformat()}Z"{tail}}}'


@pytest.mark.parametrize("once", ["7 days", None])
def test_a_file_delivered_under_two_names_adds_nothing(spark, root, once):
    texts = [message(1, 1), message(1, 2), message(2, 1), message(3, None), message(3, None, "active"), "broken", "broken too"]
    for more in ([], [message(4, 1)], ["broken", message(1, 3)]):
        lines(spark, root, "in", texts + more)
        ingest(text_messages(spark, f"{root}/in"), f"{root}/bronze", f"{root}/ck", available_now=True, once=once).awaitTermination()
    events = read_bronze(spark, f"{root}/bronze").count()
    rejects = read_bronze(spark, f"{root}/bronze", rejected=True).count()
    assert (events, rejects) == ((7, 2) if once else (17, 7))


# Quarantine


def strict(name):
    schema = message_schema()
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable and f.name != name) for f in schema.fields])


def test_rejects_are_moved_once(spark, root):
    path = f"{root}/bronze"
    texts = [message(1, 1), message(2, 2), message(2, 2), "broken", None, message('"x"', 3)]
    raw = spark.createDataFrame([(t,) for t in texts], "value string").withColumn("source_seq", F.lit(None).cast("long"))
    write_bronze(parse_cdc(raw, strict("name")), path)
    write_bronze(parse_cdc(raw.where("value LIKE '%: 1,%'"), message_schema()), path)

    def counts():
        events = read_bronze(spark, path)
        return events.count(), read_bronze(spark, path, rejected=True).count()

    assert counts() == (1, 6)
    assert replay_rejects(spark, path, strict("name")) == 0
    assert replay_rejects(spark, path, message_schema()) == 3
    assert counts() == (4, 3)
    assert replay_rejects(spark, path, message_schema()) == 0
    assert counts() == (4, 3)
    moved = read_bronze(spark, path).where("source_part = 'replay'")
    assert sorted((r.customer_id, r.seq) for r in moved.collect()) == [(1, 1), (2, 2), (2, 2)]
    reasons = [r.reject_reason for r in read_bronze(spark, path, rejected=True).collect()]
    assert sorted(reasons) == ["malformed", "malformed", "null_message"]


def test_a_replay_that_stops_before_its_append_may_be_repeated(spark, root, monkeypatch):
    path = f"{root}/bronze"
    raw = spark.createDataFrame([(message(1, 1),)], "value string").withColumn("source_seq", F.lit(None).cast("long"))
    write_bronze(parse_cdc(raw, strict("name")), path)
    from tidemark.plans import quarantine

    with monkeypatch.context() as patch:
        patch.setattr(quarantine, "append", lambda *args: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            replay_rejects(spark, path, message_schema())
    assert replay_rejects(spark, path, message_schema()) == 1
    assert read_bronze(spark, path).count() == 1 and read_bronze(spark, path, rejected=True).count() == 0


def test_jobs_for_late_messages(spark, root, monkeypatch):
    """The command line: the same files twice, late changes by position, a replay, and the mart by deltas."""
    from tidemark.plans import jobs
    from tidemark.plans.layers import ChainConfig
    from tidemark.settings import Settings

    monkeypatch.setattr(jobs, "build_session", lambda *args: spark)
    monkeypatch.setenv("WAREHOUSE_DIR", f"{root}/warehouse")
    settings = Settings(warehouse=f"{root}/warehouse")
    late = message(1, 4, "active").replace(T1.isoformat(), (T1 - dt.timedelta(days=3)).isoformat())
    for texts in ([message(1, 1), message(2, 3), "broken"], [message(1, 1), late]):
        sourced = [t.replace('"op"', '"source": "a", "op"') for t in texts]
        lines(spark, root, "in", sourced)
        jobs.main(["bronze", "--files", f"{root}/in", "--available-now", "--once", "7 days"])
        jobs.main(["silver", "--late", "splice"])
        jobs.main(["silver", "--late", "splice", "--by-position"])
        jobs.main(["gold", "--mode", "deltas"])
    jobs.main(["replay"])
    silver = ChainConfig(settings, late="splice").store(spark).dimension()
    found = sorted((r.customer_id, r.status, r.is_current) for r in silver.collect())
    assert found == [(1, "active", False), (1, "vip", True), (2, "vip", True)]
    assert read_bronze(spark, settings.bronze_path).count() == 3
    assert gold(spark, settings.gold_path) == [(DAY1, "vip", 2)]
    jobs.main(["gold"])
    jobs.main(["gold", "--mode", "deltas"])
    assert gold(spark, settings.gold_path) == [(DAY1, "vip", 2)]
