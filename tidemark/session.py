"""Session factory and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from tidemark.settings import Settings


def object_store_conf(settings: Settings) -> dict[str, str]:
    """S3A settings; keys are set only when given, so instance credentials keep working."""
    conf: dict[str, str] = {}
    if settings.s3_endpoint:
        conf["spark.hadoop.fs.s3a.endpoint"] = settings.s3_endpoint
        conf["spark.hadoop.fs.s3a.path.style.access"] = "true"
        conf["spark.hadoop.fs.s3a.connection.ssl.enabled"] = str(settings.s3_endpoint.startswith("https")).lower()
    if settings.s3_access_key:
        conf["spark.hadoop.fs.s3a.aws.credentials.provider"] = (
            "org.apache.hadoop.fs.s3a.SimpleAWSCredentialsProvider"
        )
        conf["spark.hadoop.fs.s3a.access.key"] = settings.s3_access_key
        conf["spark.hadoop.fs.s3a.secret.key"] = settings.s3_secret_key
    return conf


def catalog_conf(name: str, kind: str, warehouse: str, uri: str | None = None) -> dict[str, str]:
    """Settings of a table-format catalog; `kind` is "hadoop" or "hive". Needs the format's jar."""
    if kind not in ("hadoop", "hive"):
        raise ValueError(f"unknown catalog kind {kind!r}")
    prefix = f"spark.sql.catalog.{name}"
    conf = {
        "spark.sql.extensions": "org.apache.iceberg.spark.extensions.IcebergSparkSessionExtensions",
        prefix: "org.apache.iceberg.spark.SparkCatalog",
        f"{prefix}.type": kind,
        f"{prefix}.warehouse": warehouse,
    }
    if uri:
        conf[f"{prefix}.uri"] = uri
    return conf


def build_session(
    app_name: str,
    settings: Settings | None = None,
    master: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """UTC session with adaptive execution. Shuffle width is left to the cluster and AQE."""
    settings = settings or Settings.from_env()
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.warehouse.dir": settings.warehouse,
        **object_store_conf(settings),
        **(extra or {}),
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        if value:
            builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Dates and zoneless texts are read as UTC, whatever zone the session started in."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder under `spark.checkpoint.dir`, which every executor can reach.

    Only a local session may go without that setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/tidemark/{label}-{uuid.uuid4().hex}"
