"""Micro fixtures of the dimension: every case states its whole expected table."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import (
    OPEN_END,
    Scd2Spec,
    join_as_of,
    last_positions,
    live,
    merged_positions,
    read_unseen,
    scd2_apply,
    scd2_history,
    stage_changes,
)
from tidemark.operators.as_of import _sliced
from tidemark.operators.scd2 import open_versions
from tidemark.operators.slices import with_slices
from tidemark.plans import DimensionStore

T1, T2, T3 = (dt.datetime(2026, 3, day, 10) for day in (13, 14, 15))
END = dt.datetime.fromisoformat(OPEN_END)
SPEC = Scd2Spec(tie_break=("seq",))
SCHEMA = "customer_id int, name string, status string, updated_at timestamp_ntz, seq bigint"


def changes(spark, *rows):
    """Rows of (id, status, time) or (id, name, status, time) with an optional trailing seq."""
    full = []
    for row in rows:
        row = list(row)
        seq = row.pop() if isinstance(row[-1], int) else 0
        if len(row) == 3:
            row.insert(1, f"customer_{row[0]}")
        full.append((*row, seq))
    return spark.createDataFrame(full, SCHEMA)


def new_store(spark, root, spec=SPEC, **options):
    return DimensionStore(spark, f"{root}/dim", spec, ts_type="timestamp_ntz", **{"buckets": 4, **options})


def versions(store):
    rows = store.dimension().select("customer_id", "status", "effective_from", "effective_to", "is_current").collect()
    return sorted(tuple(r) for r in rows)


CHANGED = [(1, "active", T1, T2, False), (1, "vip", T2, END, True)]


def after_change(spark, root):
    store = new_store(spark, root)
    store.apply(changes(spark, (1, "active", T1)))
    store.apply(changes(spark, (1, "vip", T2)))
    return store


def test_first_load(spark, root):
    store = new_store(spark, root)
    store.apply(changes(spark, (1, "active", T1)))
    row = store.dimension().collect()[0].asDict()
    assert row.pop("hashdiff")
    assert row == {
        "customer_id": 1,
        "name": "customer_1",
        "status": "active",
        "business_key": "1",
        "effective_from": T1,
        "effective_to": END,
        "is_current": True,
        "updated_at": T1,
    }


def test_change_closes_and_opens(spark, root):
    assert versions(after_change(spark, root)) == CHANGED


def test_unchanged_row_is_left_alone(spark, root):
    store = new_store(spark, root)
    store.apply(changes(spark, (1, "active", T1)))
    store.apply(changes(spark, (1, "active", T2)))
    assert versions(store) == [(1, "active", T1, END, True)]
    assert store.dimension().first().updated_at == T1


def test_replay_changes_nothing(spark, root):
    store = after_change(spark, root)
    for _ in range(2):
        store.apply(changes(spark, (1, "vip", T2)))
    assert versions(store) == CHANGED


def test_replayed_run_rereads_the_last_change_only_once(spark, root):
    store = new_store(spark, root)
    bronze = changes(spark, (1, "active", T1))
    store.run(bronze)
    bronze = bronze.unionByName(changes(spark, (1, "vip", T2)))
    for _ in range(3):
        store.run(bronze)
    assert versions(store) == CHANGED


def test_change_after_replay_keeps_one_current_version(spark, root):
    store = after_change(spark, root)
    store.apply(changes(spark, (1, "vip", T2)))
    store.apply(changes(spark, (1, "active", T3)))
    assert versions(store) == [(1, "active", T1, T2, False), (1, "active", T3, END, True), (1, "vip", T2, T3, False)]


def test_changes_within_a_batch_collapse(spark, root):
    store = new_store(spark, root)
    store.apply(changes(spark, (1, "active", T1), (1, "vip", T2)))
    assert versions(store) == [(1, "vip", T2, END, True)]


@pytest.mark.parametrize("parts", [1, 3])
def test_tie_goes_to_the_later_sequence(spark, parts):
    rows = [(1, "active", T1, 1), (1, "vip", T1, 2), (1, "inactive", T1, 0)]
    random.Random(parts).shuffle(rows)
    staged = stage_changes(changes(spark, *rows).repartition(parts, "seq"), SPEC)
    assert [r.status for r in staged.collect()] == ["vip"]


def test_change_at_the_same_time_gives_an_empty_version(spark, root):
    store = new_store(spark, root)
    store.apply(changes(spark, (1, "active", T1)))
    store.apply(changes(spark, (1, "vip", T1)))
    assert versions(store) == [(1, "active", T1, T1, False), (1, "vip", T1, END, True)]


@pytest.mark.parametrize(
    ("first", "second"), [(("x", None), (None, "x")), (("a||b", "c"), ("a", "b||c")), (("~", "y"), (None, "y"))]
)
def test_fingerprint_tells_nulls_and_delimiters_apart(spark, root, first, second):
    store = new_store(spark, root)
    store.apply(changes(spark, (1, *first, T1)))
    store.apply(changes(spark, (1, *second, T2)))
    assert store.dimension().count() == 2


@pytest.mark.parametrize(("first", "second"), [(("x", None), (None, "x")), (("a||b", "c"), ("a", "b||c"))])
def test_compat_fingerprint_does_not(spark, root, first, second):
    store = new_store(spark, root, Scd2Spec(tie_break=("seq",), hash_mode="compat"))
    store.apply(changes(spark, (1, *first, T1)))
    store.apply(changes(spark, (1, *second, T2)))
    assert store.dimension().count() == 1


def test_rows_without_key_or_time_are_not_staged(spark):
    rows = changes(spark, (None, "active", T1), (1, "active", None), (2, "vip", T1))
    assert [r.customer_id for r in stage_changes(rows, SPEC).collect()] == [2]


def test_late_row_is_not_read(spark, root):
    store = new_store(spark, root)
    bronze = changes(spark, (1, "active", T1), (2, "active", T3))
    store.run(bronze)
    store.run(bronze.unionByName(changes(spark, (1, "vip", T2))))
    assert versions(store) == [(1, "active", T1, END, True), (2, "active", T3, END, True)]


def test_lookback_reads_late_rows_and_ignores_stale_ones(spark, root):
    store = new_store(spark, root)
    bronze = changes(spark, (1, "active", T1), (2, "active", T3))
    store.run(bronze)
    late = bronze.unionByName(changes(spark, (1, "vip", T2), (2, "vip", T2)))
    for _ in range(2):
        store.run(late, lookback="2 days")
    assert versions(store) == [*CHANGED, (2, "active", T3, END, True)]


def test_bound_is_inclusive(spark, root):
    store = after_change(spark, root)
    store.run(changes(spark, (1, "vip", T2), (2, "active", T2)))
    assert versions(store) == [*CHANGED, (2, "active", T2, END, True)]


def test_empty_batch_writes_nothing(spark, root):
    store = after_change(spark, root)
    commits = store.commits().count()
    assert store.apply(changes(spark, (1, "vip", T3)).where("false")) is None
    assert store.commits().count() == commits
    assert versions(store) == CHANGED


def test_batch_without_changes_keeps_the_version_and_advances_the_mark(spark, root):
    store = after_change(spark, root)
    before = store.last_commit()
    store.apply(changes(spark, (1, "vip", T3)))
    after = store.last_commit()
    assert after.version == before.version == 2 and after.run == before.run + 1
    assert store.commits().agg(F.max("updated_at_gte")).first()[0] == T3
    assert versions(store) == CHANGED


@pytest.mark.parametrize("step", ["_pin", "_write_version", "_commit"])
@pytest.mark.parametrize("stop", ["before", "after"])
def test_crash_and_repeat(spark, root, monkeypatch, step, stop):
    """A run that stops around any of its writes is invisible, and repeating it gives the whole result."""
    store = new_store(spark, root)
    store.apply(changes(spark, (1, "active", T1)))
    real = getattr(DimensionStore, step)

    def crash(self, *args):
        if stop == "after":
            real(self, *args)
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(DimensionStore, step, crash)
        with pytest.raises(RuntimeError):
            store.apply(changes(spark, (1, "vip", T2)))
    committed = (step, stop) == ("_commit", "after")
    assert versions(store) == (CHANGED if committed else [(1, "active", T1, END, True)])
    store.apply(changes(spark, (1, "vip", T2)))
    assert versions(store) == CHANGED


def test_versions_that_expire_are_deleted(spark, root):
    store = new_store(spark, root)
    for time, status in ((T1, "active"), (T2, "vip"), (T3, "active")):
        store.apply(changes(spark, (1, status, time)))
    store.apply(changes(spark, (1, "active", T3)))
    expected = versions(store)
    store.expire(keep=2)
    assert sorted(p.name for p in Path(f"{root}/dim/versions").iterdir()) == ["2", "3"]
    assert sorted(p.name for p in Path(f"{root}/dim/staged").iterdir()) == ["2", "3", "4"]
    assert versions(store) == expected and len(expected) == 3


def test_crashed_attempt_leaves_no_trace_when_repeated_without_changes(spark, root, monkeypatch):
    store = after_change(spark, root)
    with monkeypatch.context() as patch:
        patch.setattr(DimensionStore, "_commit", lambda *args: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.apply(changes(spark, (1, "inactive", T3)))
    store.apply(changes(spark, (1, "vip", T2)))
    assert versions(store) == CHANGED
    store.apply(changes(spark, (1, "active", T3)))
    assert len(versions(store)) == 3


def test_crashed_closed_rows_do_not_surface_after_a_run_without_changes(spark, root, monkeypatch):
    """The id of the crashed run is taken by a run that writes no closed rows of its own."""
    store = after_change(spark, root)
    with monkeypatch.context() as patch:
        patch.setattr(DimensionStore, "_commit", lambda *args: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.apply(changes(spark, (1, "inactive", T3)))
    store.apply(changes(spark, (1, "vip", T3)))
    assert versions(store) == CHANGED


def test_stream_batch_is_merged_once(spark, root):
    store = new_store(spark, root)
    assert store.apply(changes(spark, (1, "active", T1)), batch_id=0) == 1
    assert store.apply(changes(spark, (1, "vip", T2)), batch_id=0) is None
    assert store.apply(changes(spark, (1, "vip", T2)), batch_id=1) == 2
    assert versions(store) == CHANGED


def test_store_keeps_its_bucket_count_until_another_is_given(spark, root):
    after_change(spark, root)
    again = new_store(spark, root, buckets=None)
    again.apply(changes(spark, (2, "vip", T3)))
    assert again.last_commit().buckets == 4
    wider = new_store(spark, root, buckets=6)
    wider.apply(changes(spark, (2, "vip", T3)))
    assert wider.last_commit().buckets == 4
    for _ in range(2):
        wider.apply(changes(spark, (3, "vip", T3)))
        assert wider.last_commit().buckets == 6
        assert versions(wider) == [*CHANGED, (2, "vip", T3, END, True), (3, "vip", T3, END, True)]


def test_staged_batch_can_be_queried(spark, root):
    store = after_change(spark, root)
    store.expose_staged("stg_customer")
    rows = spark.sql("SELECT customer_id, status, business_key FROM stg_customer").collect()
    assert [tuple(r) for r in rows] == [(1, "vip", "1")]


def test_publish_shows_committed_versions(spark, root):
    store = after_change(spark, root)
    spark.sql("CREATE NAMESPACE IF NOT EXISTS silver_test")
    store.publish("silver_test.dim_customer")
    assert spark.table("silver_test.dim_customer").count() == 2
    store.apply(changes(spark, (2, "vip", T3)))
    store.publish("silver_test.dim_customer")
    assert sorted(r.customer_id for r in spark.table("silver_test.dim_customer").collect()) == [1, 1, 2]


def test_zoned_timestamps(spark, root):
    store = DimensionStore(spark, f"{root}/zoned", SPEC, buckets=2)
    naive = changes(spark, (1, "active", T1), (2, "vip", T2))
    zoned = naive.withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    store.run(zoned)
    store.run(zoned)
    assert store.dimension().count() == 2
    ends = store.dimension().select(F.col("effective_to").cast("string")).distinct().collect()
    assert [r[0] for r in ends] == [OPEN_END]


def random_changes(spark, seed, rows=400, keys=7):
    pick = random.Random(seed)
    start = dt.datetime(2026, 1, 1)
    times = sorted(start + dt.timedelta(hours=pick.randrange(24 * 20)) for _ in range(rows))
    data = [
        (pick.choice([0, 0, 0, *range(keys)]), "n", pick.choice(["a", "b", None]), time, seq)
        for seq, time in enumerate(times)
    ]
    return spark.createDataFrame(data, SCHEMA).cache()


def expected_versions(rows, batch):
    """Brute force: walk each key's batches in time order."""
    by_key = {}
    for row in sorted(rows, key=lambda r: (r.updated_at, r.seq)):
        by_key.setdefault(row.customer_id, {})[batch(row.updated_at)] = row
    out = []
    for key, batches in by_key.items():
        kept = []
        for row in batches.values():
            if not kept or kept[-1].status != row.status:
                kept.append(row)
        for row, following in zip(kept, [*kept[1:], None]):
            end = following.updated_at if following else END
            out.append((key, row.status, row.updated_at, end, following is None))
    return sorted(out, key=str)


def as_versions(df):
    rows = df.select("customer_id", "status", "effective_from", "effective_to", "is_current").collect()
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("hot_rows", [None, 3, 25])
@pytest.mark.parametrize("daily", [True, False])
@pytest.mark.parametrize("prereduce", [True, False])
def test_history_equals_brute_force(spark, hot_rows, daily, prereduce):
    df = random_changes(spark, seed=11)
    bucket = F.to_date("updated_at") if daily else None
    expected = expected_versions(df.collect(), (lambda t: t.date()) if daily else (lambda t: t))
    assert as_versions(scd2_history(df, SPEC, bucket, hot_rows, prereduce)) == expected


def test_incremental_runs_equal_history(spark, root):
    df = random_changes(spark, seed=5, rows=150)
    store = new_store(spark, root)
    for day in (5, 12, 31):
        arrived = df.where(F.col("updated_at") < F.lit(f"2026-01-{day}").cast("timestamp_ntz"))
        store.run(arrived)
        store.run(arrived)
    day = F.to_date("updated_at")
    bucket = F.when(day < "2026-01-05", 0).when(day < "2026-01-12", 1).otherwise(2)
    assert as_versions(store.dimension()) == as_versions(scd2_history(df, SPEC, bucket))
    check_invariants(store.dimension())


def check_invariants(dimension):
    rows = sorted(dimension.collect(), key=lambda r: (r.customer_id, r.effective_from, r.effective_to))
    for key in {r.customer_id for r in rows}:
        mine = [r for r in rows if r.customer_id == key]
        assert [r.is_current for r in mine] == [False] * (len(mine) - 1) + [True]
        for left, right in zip(mine, mine[1:]):
            assert left.effective_to == right.effective_from
            assert left.hashdiff != right.hashdiff


def test_pure_apply_keeps_closed_versions(spark):
    dimension = open_versions(stage_changes(changes(spark, (1, "active", T1)), SPEC), SPEC)
    for status, time in (("vip", T2), ("active", T3)):
        dimension = scd2_apply(dimension, stage_changes(changes(spark, (1, status, time)), SPEC), SPEC)
    assert as_versions(dimension) == sorted(
        [(1, "active", T1, T2, False), (1, "vip", T2, T3, False), (1, "active", T3, END, True)], key=str
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_both_history_plans_agree_when_batches_share_a_time(spark, seed):
    rng = random.Random(seed)
    rows = [(i % 2, rng.choice("abc"), T1 + dt.timedelta(days=i // 40), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "customer_id int, status string, updated_at timestamp, seq long").withColumn(
        "name", F.lit("n")).repartition(8)
    bucket, found = F.floor(F.col("seq") / 4), []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for hot_rows in (None, 3):
            history = scd2_history(df, Scd2Spec(tie_break=("seq",)), bucket, hot_rows=hot_rows, slices=20)
            found.append(sorted(tuple(r) for r in history.collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[0] == found[1]
    winners, versions = {}, 0
    for key, status, _, seq in rows:
        winners.setdefault(key, {})[seq // 4] = status
    for own in winners.values():
        statuses = [own[b] for b in sorted(own)]
        versions += 1 + sum(a != b for a, b in zip(statuses, statuses[1:], strict=False))
    assert len(found[0]) == versions


def test_hot_keys_are_dealt_by_slice_behind_a_join_by_shuffle(spark):
    rows = [(0, i) for i in range(4_000)] + [(1 + i % 100, i * 40) for i in range(1_200)]
    df = spark.createDataFrame(rows, "key int, at int")
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        sliced = with_slices(df, "key", "at", hot_rows=10, slices=50)
        placed_ = sliced.select("*", F.spark_partition_id().alias("task")).groupBy("key").agg(
            F.countDistinct("task").alias("tasks"), F.countDistinct("_slice").alias("slices"), F.count("*").alias("n"))
        found = {r.key: r for r in placed_.collect()}
        largest = sliced.where("key = 0").groupBy("_slice").count().agg(F.max("count")).first()[0]
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert {k: r.n for k, r in found.items()} == {0: 4_000, **dict.fromkeys(range(1, 101), 12)}
    assert found[0].tasks > 1 and largest <= 1.1 * len(rows) / 50
    # A key little above the limit is cut a few times, not once for each of the table's slices.
    assert max(r.slices for k, r in found.items() if k) <= 3


def test_streams_count_their_own_batches(spark, root):
    store = new_store(spark, root)
    assert store.apply(changes(spark, (1, "active", T1)), batch_id=5, stream="a") == 1
    assert store.apply(changes(spark, (1, "vip", T2)), batch_id=0, stream="b") == 2
    assert store.apply(changes(spark, (1, "active", T3)), batch_id=5, stream="a") is None
    assert store.apply(changes(spark, (1, "active", T3)), batch_id=0, stream="b") is None


def test_a_published_name_stays_right(spark, root):
    store = new_store(spark, root, view="published_dimension")
    for time, status in ((T1, "active"), (T2, "vip"), (T3, "active")):
        held = store.dimension() if store.last_commit() else None
        count = held.count() if held else 0
        store.apply(changes(spark, (1, status, time), (2, status, time)))
        assert held is None or held.count() == count  # what a reader holds isn't written again
        rows = sorted(map(tuple, store.dimension().collect()), key=str)
        assert sorted(map(tuple, spark.table("published_dimension").collect()), key=str) == rows
    store.expire(keep=1)
    assert sorted(map(tuple, spark.table("published_dimension").collect()), key=str) == rows and len(rows) == 6


# Late changes


@pytest.mark.parametrize("seed", range(3))
def test_order_of_batches_does_not_matter_when_late_changes_are_spliced(spark, root, seed):
    rng = random.Random(seed)
    df = random_changes(spark, seed=seed, rows=120, keys=5)
    batch = F.floor(F.dayofmonth("updated_at") / 5)
    order = [0, 1, 2, 3, 4, rng.randrange(5)]
    rng.shuffle(order)
    store = new_store(spark, root, late="splice")
    for number in order:
        store.apply(df.where(batch == number))
    assert as_versions(store.dimension()) == as_versions(scd2_history(df, SPEC, batch))
    check_invariants(store.dimension())


def test_a_late_change_splits_a_version_and_equal_neighbours_become_one(spark, root):
    store = new_store(spark, root, late="splice", view="spliced_dimension")
    store.apply(changes(spark, (1, "active", T1)))
    store.apply(changes(spark, (1, "active", T3)))
    assert versions(store) == [(1, "active", T1, END, True)]
    assert store.apply(changes(spark, (1, "vip", T2))) == 3
    split = [(1, "active", T1, T2, False), (1, "active", T3, END, True), (1, "vip", T2, T3, False)]
    assert versions(store) == split
    assert store.apply(changes(spark, (1, "vip", T2))) == 3  # nothing new
    store.apply(changes(spark, (1, "vip", T1 - dt.timedelta(days=1))))
    store.apply(changes(spark, (1, "vip", T1, 9)))  # after the change of that time
    day = T1 - dt.timedelta(days=1)
    expected = [(1, "active", T1, T1, False), (1, "active", T3, END, True), (1, "vip", T1, T3, False), (1, "vip", day, T1, False)]
    assert versions(store) == sorted(expected)
    assert spark.table("spliced_dimension").count() == 4


def test_unknown_way_to_treat_late_changes_is_refused(spark, root):
    with pytest.raises(ValueError, match="late"):
        new_store(spark, root, late="drop")


# Deletes

WITH_OP = Scd2Spec(tie_break=("seq",), deletes="op")


def ops(spark, *rows):
    """Rows of (id, op, status, time)."""
    data = [(key, "n", status, time, 0, op) for key, op, status, time in rows]
    return spark.createDataFrame(data, f"{SCHEMA}, op string")


DELETED = [(1, "active", T1, T2, False), (1, "active", T3, END, True)]


@pytest.mark.parametrize("late", ["ignore", "splice"])
def test_a_delete_closes_and_a_later_change_opens_again(spark, root, late):
    store = new_store(spark, root, WITH_OP, late=late, view=f"deleted_{late}")
    store.apply(ops(spark, (1, "I", "active", T1), (2, "D", None, T1), (3, "U", "vip", T1)))
    assert versions(store) == [(1, "active", T1, END, True), (3, "vip", T1, END, True)]
    for _ in range(2):
        store.apply(ops(spark, (1, "D", None, T2), (3, None, "vip", T2)))
    assert versions(store) == [(1, "active", T1, T2, False), (3, "vip", T1, END, True)]
    store.apply(ops(spark, (1, "D", "active", T2)))
    store.apply(ops(spark, (1, "U", "active", T3)))
    assert versions(store) == [*DELETED, (3, "vip", T1, END, True)]
    assert spark.table(f"deleted_{late}").count() == 3


def test_an_older_change_does_not_open_a_deleted_key(spark, root):
    store = new_store(spark, root, WITH_OP)
    for row in ((1, "I", "active", T1), (1, "D", None, T3), (1, "U", "vip", T2)):
        store.apply(ops(spark, row))
    assert versions(store) == [(1, "active", T1, T3, False)]
    assert store.current().count() == 0


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_history_with_deletes_equals_merging(spark, hot_rows):
    df = random_changes(spark, seed=8, rows=300).withColumn("op", F.when(F.col("status") == "b", "D"))
    found = as_versions(scd2_history(df, WITH_OP, F.to_date("updated_at"), hot_rows=hot_rows, slices=5))
    dimension = None
    for (day,) in df.select(F.to_date("updated_at")).distinct().orderBy(F.to_date("updated_at")).limit(6).collect():
        staged = stage_changes(df.where(F.to_date("updated_at") == day), WITH_OP)
        dimension = open_versions(staged, WITH_OP) if dimension is None else scd2_apply(dimension, staged, WITH_OP)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/deletes-{hot_rows}-{day}"
        dimension.write.parquet(path)
        dimension = spark.read.parquet(path)
    first = df.where(F.to_date("updated_at") <= day)
    assert as_versions(live(dimension, WITH_OP)) == as_versions(scd2_history(first, WITH_OP, F.to_date("updated_at")))
    expected = []
    rows = {}
    for row in sorted(df.collect(), key=lambda r: (r.updated_at, r.seq)):
        rows.setdefault(row.customer_id, {})[row.updated_at.date()] = row
    for key, days in rows.items():
        kept = []
        for row in days.values():
            if not kept or kept[-1].status != row.status:
                kept.append(row)
        for row, following in zip(kept, [*kept[1:], None]):
            if row.status != "b":
                expected.append((key, row.status, row.updated_at, following.updated_at if following else END, following is None))
    assert found == sorted(expected, key=str)


# Progress by position


def placed(spark, root, rows):
    """Appends (customer_id, status, updated_at, part, position) to a bronze-like folder by day."""
    schema = "customer_id int, status string, updated_at timestamp_ntz, source_part string, source_pos long"
    df = spark.createDataFrame(rows, schema).withColumns(
        {"name": F.lit("n"), "seq": F.col("source_pos"), "updated_day": F.to_date("updated_at")})
    df.write.mode("append").partitionBy("updated_day").parquet(f"{root}/bronze")
    return spark.read.parquet(f"{root}/bronze")


def test_late_rows_are_read_once_by_position(spark, root):
    store = new_store(spark, root, late="splice", positions=("source_part", "source_pos"))
    assert store.run(placed(spark, root, [(1, "active", T2, "a", 7), (2, "vip", T3, "b", 1)]), "updated_day") == 1
    late = placed(spark, root, [(1, "vip", T1, "a", 8), (3, "vip", T1, "c", 0), (2, "active", T2, None, 5)])
    assert store.run(late, "updated_day") == 2
    assert store.run(spark.read.parquet(f"{root}/bronze"), "updated_day") is None
    assert versions(store) == [
        (1, "active", T2, END, True), (1, "vip", T1, T2, False), (2, "active", T2, T3, False), (2, "vip", T3, END, True),
        (3, "vip", T1, END, True)]
    assert store.last_commit().positions == {"a": 8, "b": 1, "c": 0, "": 5}


def test_reading_by_position_opens_only_days_with_unseen_rows(spark, root):
    placed(spark, root, [(1, "active", T1, "a", 1), (1, "active", T2, "a", 2), (1, "active", T3, "a", 3)])
    bronze = placed(spark, root, [(2, "vip", T2, "a", 4)])
    found = read_unseen(bronze, {"a": 3}, day_column="updated_day")
    assert [r.customer_id for r in found.collect()] == [2]
    text = found._jdf.queryExecution().executedPlan().toString()
    filters = text.split("PartitionFilters: [")[1].split("]")[0]
    assert str(T2.date()) in filters and str(T1.date()) not in filters and str(T3.date()) not in filters
    assert len({f.split("updated_day=")[1][:10] for f in read_unseen(bronze, {"a": 3}, day_column="updated_day").inputFiles()}) >= 1
    future = dt.datetime.now() + dt.timedelta(days=1)
    assert read_unseen(bronze, {"a": 3}, day_column="updated_day", written_since=future).count() == 0


def test_positions(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 9), (None, 4), ("b", None)], "source_part string, source_pos long")
    found = last_positions(rows).first()
    assert found.positions == {"a": 9, "": 4} and found.unplaced == 1
    assert merged_positions({"a": 12, "z": 1}, found.positions) == {"a": 12, "z": 1, "": 4}
    assert merged_positions(None, None) == {}


def test_rows_without_a_position_are_refused(spark, root):
    store = new_store(spark, root, positions=("source_part", "source_pos"))
    with pytest.raises(ValueError, match="no position"):
        store.run(placed(spark, root, [(1, "active", T1, "a", None)]))


# Versions as of a time


@pytest.mark.parametrize(("hot_rows", "slices"), [(None, None), (5, 4), (5, 150), (40, 1)])
def test_join_as_of_equals_brute_force(spark, hot_rows, slices):
    rng = random.Random(7)
    hours = lambda n: T1 + dt.timedelta(hours=n)
    version_rows = [(0, "v", T1, T1, "empty"), (None, "x", T1, T2, "keyless"), (1, "w", T2, T2, "empty")]
    for key in range(6):
        at = rng.randrange(5)
        for i in range(rng.randrange(30)):
            length = rng.choice([0, 1, 5])
            version_rows.append((key, f"{key}-{i}", hours(at), hours(at + length), "n"))
            at += length + rng.choice([0, 0, 7])  # a gap
    fact_rows = [(rng.choice([0, 0, 0, 0, *range(8), None]), hours(rng.randrange(-3, 160)) if i % 9 else None, i) for i in range(400)]
    fact_rows += fact_rows[:20]
    versions_ = spark.createDataFrame(version_rows, "id int, value string, effective_from timestamp, effective_to timestamp, note string")
    facts = spark.createDataFrame(fact_rows, "key int, at timestamp, n int")
    found = join_as_of(facts, versions_, "key", "at", "id", ["value", "note"], hot_rows=hot_rows, slices=slices)
    expected = []
    for key, at, n in fact_rows:
        held = [v for v in version_rows if at and v[0] is not None and v[0] == key and v[2] <= at < v[3]]
        assert len(held) <= 1
        expected.append((key, at, n, *((held[0][1], held[0][4]) if held else (None, None))))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_join_as_of_needs_little_beside_each_hot_key(spark):
    keys, slices = 3_000, 400
    facts = spark.range(keys * 12).selectExpr("id % 3000 AS _key", "id AS _at", "struct(id) AS _fact")
    held = spark.range(keys * 2).selectExpr("id % 3000 AS _key", "id AS _at", "struct(id AS _end) AS _version")
    folder = Path(spark.conf.get("spark.checkpoint.dir"), "tidemark")
    old = set(folder.glob("hot-facts-*"))
    fact_rows, version_rows = _sliced(facts, held, 10, slices)
    [written] = set(folder.glob("hot-facts-*")) - old
    # Spark broadcasts them by their files' size, in which a column of equal arrays would not show.
    hot = spark.read.parquet(str(written))
    assert hot.count() == keys and all(kind in ("bigint", "int") for _, kind in hot.dtypes)
    assert fact_rows.count() == keys * 12
    assert keys * 2 < version_rows.count() <= keys * 2 + keys * 3
