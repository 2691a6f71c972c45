"""Settings read from the environment. Secrets have no defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

# Environment names and defaults that existing deployments already use.
DEFAULT_TOPIC = "customer_cdc"
DEFAULT_PIPELINE = "dim_customer_scd2"
DEFAULT_BUCKET = "lakehouse"
DEFAULT_SERVING_DATABASE = "analytics"
DEFAULT_SERVING_TABLE = "customer_daily"


@dataclass(frozen=True)
class Settings:
    warehouse: str = ""
    brokers: str = "localhost:29092"
    topic: str = DEFAULT_TOPIC
    pipeline: str = DEFAULT_PIPELINE
    events_per_sec: float = 5.0
    max_customer_id: int = 1000
    s3_endpoint: str = ""
    s3_access_key: str = field(default="", repr=False)
    s3_secret_key: str = field(default="", repr=False)
    serving_host: str = "localhost"
    serving_port: str = "8123"
    serving_user: str = "default"
    serving_password: str = field(default="", repr=False)
    serving_database: str = DEFAULT_SERVING_DATABASE
    serving_table: str = DEFAULT_SERVING_TABLE
    daily_rows: str = ""
    catalog_kind: str = ""
    catalog_uri: str = ""

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        bucket = env.get("S3_BUCKET", DEFAULT_BUCKET)
        return cls(
            warehouse=env.get("WAREHOUSE_DIR", f"s3a://{bucket}/warehouse"),
            brokers=env.get("KAFKA_BROKERS", cls.brokers),
            topic=env.get("KAFKA_TOPIC_CUSTOMER_CDC", cls.topic),
            pipeline=env.get("PIPELINE_NAME", cls.pipeline),
            events_per_sec=float(env.get("EVENTS_PER_SEC", cls.events_per_sec)),
            max_customer_id=int(env.get("MAX_CUSTOMER_ID", cls.max_customer_id)),
            s3_endpoint=env.get("S3_ENDPOINT", ""),
            s3_access_key=env.get("S3_ACCESS_KEY", ""),
            s3_secret_key=env.get("S3_SECRET_KEY", ""),
            serving_host=env.get("CLICKHOUSE_HOST", cls.serving_host),
            serving_port=env.get("CLICKHOUSE_HTTP_PORT", cls.serving_port),
            serving_user=env.get("CLICKHOUSE_USER", cls.serving_user),
            serving_password=env.get("CLICKHOUSE_PASSWORD", ""),
            serving_database=env.get("CLICKHOUSE_DATABASE", cls.serving_database),
            daily_rows=env.get("CUSTOMER_DAILY_ROWS", "").strip(),
            catalog_kind=env.get("CATALOG_TYPE", ""),
            catalog_uri=env.get("CATALOG_URI", ""),
        )

    def path(self, *parts: str) -> str:
        return "/".join([self.warehouse.rstrip("/"), *parts])

    @property
    def bronze_path(self) -> str:
        return self.path("bronze", "customer_cdc")

    @property
    def bronze_checkpoint(self) -> str:
        return self.path("checkpoints", "bronze", "customer_cdc")

    @property
    def silver_path(self) -> str:
        return self.path("silver", "dim_customer")

    @property
    def gold_path(self) -> str:
        return self.path("gold", "customer_daily")

    @property
    def serving_url(self) -> str:
        return f"jdbc:clickhouse://{self.serving_host}:{self.serving_port}/{self.serving_database}"
