"""Mart modes, serving targets, text lines, chain and settings."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import Scd2Spec, build_daily
from tidemark.operators.scd2 import open_versions, stage_changes
from tidemark.plans import build_gold, export_gold, run_chain
from tidemark.plans import jobs
from tidemark.plans.layers import ChainConfig, create_layers, read_gold, refresh_layers
from tidemark.plans.rowlevel import (
    RowLevelLayers,
    append_to,
    merge_into,
    merge_source,
    overwrite_partitions_of,
)
from tidemark.schemas import gold_schema
from tidemark.session import catalog_conf, object_store_conf, scratch_dir
from tidemark.settings import Settings
from tidemark.sinks import JdbcTarget, PathTarget, export, overwrite_partitions, replace, replace_from_lines, to_text
from tidemark.sources import (
    generate_events,
    lines_from_files,
    lines_from_text,
    parse_lines,
    sequence_rows,
    text_messages,
)
from tidemark.streaming import ingest
from tests.test_messages import GOOD
from tests.test_scd2 import SPEC, T1, T2, changes

DAY1, DAY2 = T1.date(), T2.date()


def dimension(spark, *rows):
    return open_versions(stage_changes(changes(spark, *rows), SPEC), SPEC)


def gold(spark, path):
    return sorted(tuple(r) for r in read_gold(spark, path).collect())


def test_counts_distinct_current_keys(spark):
    mart = build_daily(dimension(spark, (1, "vip", T1), (2, "vip", T1), (3, "active", T1)))
    assert sorted(tuple(r) for r in mart.collect()) == [(DAY1, "active", 1), (DAY1, "vip", 2)]


def test_full_mode_drops_days_without_current_keys(spark, root):
    build_gold(dimension(spark, (1, "active", T1)), root, SPEC)
    build_gold(dimension(spark, (1, "vip", T2)), root, SPEC)
    assert gold(spark, root) == [(DAY2, "vip", 1)]


def test_partition_mode_keeps_days_that_are_not_in_the_result(spark, root):
    build_gold(dimension(spark, (1, "active", T1)), root, SPEC, mode="partitions")
    build_gold(dimension(spark, (1, "vip", T2)), root, SPEC, mode="partitions")
    assert gold(spark, root) == [(DAY1, "active", 1), (DAY2, "vip", 1)]


def test_partition_overwrite_replaces_only_its_days(spark, root):
    two = spark.createDataFrame([(DAY1, "a", 1), (DAY2, "a", 2)], gold_schema())
    overwrite_partitions(two, root, ["day"])
    overwrite_partitions(spark.createDataFrame([(DAY2, "b", 5)], gold_schema()), root, ["day"])
    assert gold(spark, root) == [(DAY1, "a", 1), (DAY2, "b", 5)]


def test_unknown_mode_is_refused(spark, root):
    with pytest.raises(ValueError):
        build_gold(dimension(spark, (1, "vip", T1)), root, SPEC, mode="some")


def test_export_twice_replaces_and_keeps_types(spark, root):
    build_gold(dimension(spark, (1, "active", T1), (2, "vip", T2)), f"{root}/gold", SPEC)
    target = PathTarget(f"{root}/serving")
    for _ in range(2):
        export_gold(spark, f"{root}/gold", target)
    served = spark.read.parquet(target.path)
    assert served.schema.simpleString() == "struct<day:date,customer_status:string,cnt:bigint>"
    assert [tuple(r) for r in served.collect()] == [(DAY1, "active", 1), (DAY2, "vip", 1)]


def test_jdbc_target_truncates_instead_of_dropping():
    target = JdbcTarget.from_settings(Settings.from_env({"CLICKHOUSE_HOST": "h", "CLICKHOUSE_PASSWORD": "p"}))
    assert target.options() == {
        "url": "jdbc:clickhouse://h:8123/analytics",
        "dbtable": "customer_daily",
        "driver": "com.clickhouse.jdbc.ClickHouseDriver",
        "user": "default",
        "password": "p",
        "truncate": "true",
        "numPartitions": "16",
        "batchsize": "50000",
    }
    assert "p'" not in repr(target)


def test_a_build_that_stops_leaves_the_old_rows(spark, root):
    target = PathTarget(f"{root}/serving")
    whole = spark.createDataFrame([(DAY1, "a", 1)], gold_schema())
    stops = whole.withColumn("cnt", F.raise_error(F.lit("stopped")).cast("bigint"))
    replace(whole, f"{root}/gold", ["day"])
    export(whole, target)
    with pytest.raises(Exception, match="stopped"):
        replace(stops, f"{root}/gold", ["day"])
    with pytest.raises(Exception, match="stopped"):
        export(stops, target)
    assert gold(spark, f"{root}/gold") == [(DAY1, "a", 1)]
    assert [tuple(r) for r in spark.read.parquet(target.path).collect()] == [(DAY1, "a", 1)]
    replace(whole.withColumn("cnt", F.lit(2).cast("bigint")), f"{root}/gold", ["day"])
    assert gold(spark, f"{root}/gold") == [(DAY1, "a", 2)]


def test_a_stop_between_the_renames_is_mended(spark, root):
    whole = spark.createDataFrame([(DAY1, "a", 1)], gold_schema())
    replace(whole, f"{root}/gold.old", ["day"])
    replace(whole, f"{root}/gold", ["day"])
    assert gold(spark, f"{root}/gold") == [(DAY1, "a", 1)]


def test_lines_are_trimmed_and_typed(spark, root):
    to_text(spark.createDataFrame([("2026-03-13, active ,10",)], "value string"), f"{root}/lines")
    rows = parse_lines(lines_from_files(spark, f"{root}/lines")).collect()
    assert [tuple(r) for r in rows] == [(dt.date(2026, 3, 13), "active", 10)]


def test_lines_from_text(spark, root):
    target = PathTarget(f"{root}/serving")
    assert replace_from_lines(lines_from_text(spark, "2026-03-14,vip,2\n2026-03-13,active,10\n"), target) == 2
    assert [r.cnt for r in spark.read.parquet(target.path).collect()] == [10, 2]


@pytest.mark.parametrize("text", ["", "2026-03-13,active", "2026-03-13,a,b,1", "2026-03-13,active,many", "soon,a,1"])
def test_bad_lines_leave_the_target_unchanged(spark, root, text):
    target = PathTarget(f"{root}/serving")
    replace_from_lines(lines_from_text(spark, "2026-03-13,active,10"), target)
    with pytest.raises(Exception):
        replace_from_lines(lines_from_text(spark, f"2026-03-13,vip,1\n{text}" if text else ""), target)
    assert [r.cnt for r in spark.read.parquet(target.path).collect()] == [10]


def chain(root):
    return ChainConfig(Settings(warehouse=f"{root}/warehouse"), Scd2Spec(), buckets=2)


def test_chain_may_be_run_again_and_tables_can_be_queried(spark, root):
    config, target = chain(root), PathTarget(f"{root}/serving")
    to_text(spark.createDataFrame([(GOOD,), ("broken",)], "value string"), f"{root}/in")
    for _ in range(2):
        run_chain(spark, config, f"{root}/in", target)
    assert [tuple(r) for r in spark.read.parquet(target.path).collect()] == [(DAY1, "vip", 1)]
    changed = GOOD.replace('"vip"', '"active"').replace("2026-03-13", "2026-03-14")
    to_text(spark.createDataFrame([(changed,)], "value string"), f"{root}/in")
    run_chain(spark, config, f"{root}/in", target)
    assert [tuple(r) for r in spark.read.parquet(target.path).collect()] == [(DAY2, "active", 1)]

    create_layers(spark, config)
    refresh_layers(spark, config)
    assert spark.table("bronze.customer_cdc").where("NOT rejected").count() == 2
    assert spark.table("silver.dim_customer").count() == 2
    assert spark.table("gold.customer_daily").count() == 1
    assert spark.table("meta.watermarks").count() == 3


def test_jobs_run_the_chain(spark, root, monkeypatch):
    monkeypatch.setattr(jobs, "build_session", lambda *args: spark)
    for name, value in {"WAREHOUSE_DIR": f"{root}/warehouse", "MAX_CUSTOMER_ID": "5", "EVENTS_PER_SEC": "0"}.items():
        monkeypatch.setenv(name, value)
    jobs.main(["generate", "--files", f"{root}/in", "--count", "100"])
    jobs.main(["bronze", "--files", f"{root}/in", "--available-now"])
    jobs.main(["silver", "--hash-mode", "compat", "--lookback", "1 day"])
    newest = generate_events(sequence_rows(spark, 100), max_id=5).groupBy("customer_id")
    expected = newest.agg(F.max_by("status", "seq").alias("status")).orderBy("customer_id").collect()
    silver = ChainConfig(Settings(warehouse=f"{root}/warehouse")).store(spark).current()
    assert silver.select("customer_id", "status").orderBy("customer_id").collect() == expected
    assert silver.where(F.col("hashdiff") == F.sha2(F.concat_ws("||", "name", "status"), 256)).count() == 5
    jobs.main(["gold"])
    jobs.main(["export", "--path", f"{root}/serving"])
    served = spark.read.parquet(f"{root}/serving").collect()
    assert sum(r.cnt for r in served) == 5
    monkeypatch.setenv("CUSTOMER_DAILY_ROWS", "2026-03-13,vip,2")
    jobs.main(["load", "--path", f"{root}/serving"])
    assert [r.cnt for r in spark.read.parquet(f"{root}/serving").collect()] == [2]
    with pytest.raises(SystemExit):
        jobs.main(["generate"])


def test_merge_source_opens_successors_under_a_null_key(spark):
    current = dimension(spark, (1, "active", T1), (2, "vip", T1))
    staged = stage_changes(changes(spark, (1, "vip", T2), (2, "vip", T2), (3, "vip", T2)), SPEC)
    rows = merge_source(staged, current, SPEC).select("customer_id", "merge_key").collect()
    assert sorted(tuple(r) for r in rows if r.merge_key) == [(1, "1"), (2, "2"), (3, "3")]
    assert [r.customer_id for r in rows if r.merge_key is None] == [1]


def test_merge_source_holds_deletes_as_gaps(spark):
    spec = Scd2Spec(tie_break=("seq",), deletes="op")
    rows = changes(spark, (1, "active", T1), (2, "vip", T1)).withColumn("op", F.lit("I"))
    current = open_versions(stage_changes(rows, spec), spec)
    deleted = changes(spark, (1, "active", T2), (4, "vip", T2)).withColumn("op", F.lit("D"))
    found = merge_source(stage_changes(deleted, spec), current, spec).collect()
    assert sorted((r.customer_id, r.merge_key or "", r.hashdiff, r.is_current) for r in found) == [
        (1, "", None, False), (1, "1", None, False), (4, "4", None, False)]


def test_row_level_commands_are_refused_by_plain_parquet(spark, root):
    """They resolve against the table and fail only because its format cannot do them."""
    dimension(spark, (1, "active", T1)).write.option("path", f"{root}/t").saveAsTable("row_level_test")
    try:
        staged = stage_changes(changes(spark, (1, "vip", T2)), SPEC)
        with pytest.raises(Exception, match="UNSUPPORTED_FEATURE.TABLE_OPERATION"):
            merge_into(staged, "row_level_test", SPEC)
        for command in (append_to, overwrite_partitions_of):
            with pytest.raises(Exception, match="v1 table"):
                command(dimension(spark, (2, "vip", T1)), "row_level_test")
    finally:
        spark.sql("DROP TABLE row_level_test")


def test_row_level_tables(spark):
    statements = RowLevelLayers("lake").ddl()
    assert statements[:4] == [f"CREATE NAMESPACE IF NOT EXISTS lake.{n}" for n in ("bronze", "meta", "silver", "gold")]
    assert statements[6] == (
        "CREATE TABLE IF NOT EXISTS lake.silver.dim_customer (customer_id int, name string, status string, "
        "business_key string, hashdiff string, effective_from timestamp, effective_to timestamp, is_current boolean, "
        "updated_at timestamp) USING iceberg PARTITIONED BY (days(effective_from))"
    )
    assert "updated_day" not in statements[4] and "days(updated_at)" in statements[4]


def test_row_level_silver_run_pins_the_batch_before_it_merges(spark, root, monkeypatch):
    """The run on Parquet tables, up to the MERGE that they lack."""
    layers = RowLevelLayers("spark_catalog", using="parquet", spec=SPEC, ts_type="timestamp_ntz")
    spark.sql("CREATE NAMESPACE IF NOT EXISTS bronze")
    spark.sql("CREATE NAMESPACE IF NOT EXISTS meta")
    for name in (layers.bronze, layers.watermarks):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    bronze = changes(spark, (1, "active", T1), (2, "vip", T2)).selectExpr("*", "false AS rejected")
    bronze.write.option("path", f"{root}/bronze").saveAsTable(layers.bronze)
    spark.sql(f"{layers.ddl()[5]} LOCATION '{root}/marks'")
    merged = []
    monkeypatch.setattr(
        "tidemark.plans.rowlevel.merge_into", lambda staged, table, spec: merged.append((staged, table))
    )
    monkeypatch.setattr("tidemark.plans.rowlevel.append_to", lambda df, table: df.write.insertInto(table))
    try:
        assert layers.run_silver(spark)
        assert layers.run_silver(spark)
        assert [table for _, table in merged] == [layers.silver] * 2
        assert [sorted(r.customer_id for r in staged.collect()) for staged, _ in merged] == [[1, 2], [2]]
    finally:
        for name in (layers.bronze, layers.watermarks):
            spark.sql(f"DROP TABLE {name}")


def test_ingest_into_a_catalog_table(spark, root):
    spark.sql("CREATE NAMESPACE IF NOT EXISTS bronze")
    spark.sql(
        "CREATE TABLE bronze.by_name (customer_id int, status string, updated_at timestamp, updated_day date) "
        f"USING parquet PARTITIONED BY (updated_day) LOCATION '{root}/by_name'"
    )
    to_text(spark.createDataFrame([(GOOD,)], "value string"), f"{root}/in")
    try:
        for _ in range(2):
            source = text_messages(spark, f"{root}/in")
            ingest(source, "bronze.by_name", f"{root}/ck", available_now=True, as_table=True).awaitTermination()
        rows = spark.read.parquet(f"{root}/by_name").select("customer_id", "status", "updated_day").collect()
        assert [tuple(r) for r in rows] == [(1, "vip", DAY1)]
    finally:
        spark.sql("DROP TABLE bronze.by_name")


def test_settings_come_from_the_environment():
    settings = Settings.from_env(
        {
            "S3_BUCKET": "b",
            "S3_ENDPOINT": "http://store:9000",
            "S3_ACCESS_KEY": "k",
            "S3_SECRET_KEY": "s",
            "PIPELINE_NAME": "p",
            "CATALOG_TYPE": "hive",
            "CATALOG_URI": "thrift://metastore:9083",
        }
    )
    assert settings.bronze_path == "s3a://b/warehouse/bronze/customer_cdc"
    assert settings.pipeline == "p"
    conf = object_store_conf(settings)
    assert conf["spark.hadoop.fs.s3a.endpoint"] == "http://store:9000"
    assert conf["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "false"
    assert "secret_key" not in repr(settings)
    assert object_store_conf(Settings.from_env({})) == {}


def test_catalog_conf():
    conf = catalog_conf("lake", "hive", "s3a://b/warehouse", "thrift://metastore:9083")
    assert conf["spark.sql.catalog.lake.type"] == "hive"
    assert conf["spark.sql.catalog.lake.uri"] == "thrift://metastore:9083"
    with pytest.raises(ValueError):
        catalog_conf("lake", "other", "w")


def test_catalog_settings_reach_the_session(spark, monkeypatch):
    given = []
    monkeypatch.setattr(jobs, "build_session", lambda *args: given.append(args[3]) or spark)
    monkeypatch.setattr(jobs, "run_on_tables", lambda *args: given.append(args[3].catalog))
    monkeypatch.setenv("CATALOG_TYPE", "hive")
    monkeypatch.setenv("CATALOG_URI", "thrift://metastore:9083")
    jobs.main(["silver", "--catalog", "lake"])
    assert given[0]["spark.sql.catalog.lake.uri"] == "thrift://metastore:9083" and given[1] == "lake"
    jobs.main(["tables", "--catalog", "lake"])
    monkeypatch.delenv("CATALOG_TYPE")
    jobs.main(["tables", "--catalog", "lake"])
    assert given[4] == {}


def test_scratch_folders_are_new_and_shared(spark):
    first, second = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert first != second
    assert first.startswith(spark.conf.get("spark.checkpoint.dir"))
