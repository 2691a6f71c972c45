"""Serving targets: full replacement over JDBC or of a sorted Parquet folder."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import SERVING_ORDER
from tidemark.session import scratch_dir
from tidemark.settings import Settings
from tidemark.sinks.tables import replace
from tidemark.sources.lines import parse_lines

# Fixed value: driver class of the column store that serves the mart.
SERVING_DRIVER = "com.clickhouse.jdbc.ClickHouseDriver"


@dataclass(frozen=True)
class JdbcTarget:
    """A table behind JDBC. `connections` bounds how many tasks insert at the same time.

    Its rows are emptied before they are inserted, and on a store without transactions a task that
    runs again inserts its rows again: repeat an export that failed.
    """

    url: str
    table: str
    driver: str = SERVING_DRIVER
    user: str = ""
    password: str = field(default="", repr=False)
    connections: int = 16
    batch_size: int = 50_000

    @classmethod
    def from_settings(cls, settings: Settings) -> JdbcTarget:
        return cls(
            url=settings.serving_url,
            table=settings.serving_table,
            user=settings.serving_user,
            password=settings.serving_password,
        )

    def options(self) -> dict[str, str]:
        """`truncate` keeps the table's own engine and column types when its rows are replaced."""
        return {
            "url": self.url,
            "dbtable": self.table,
            "driver": self.driver,
            "user": self.user,
            "password": self.password,
            "truncate": "true",
            "numPartitions": str(self.connections),
            "batchsize": str(self.batch_size),
        }


@dataclass(frozen=True)
class PathTarget:
    """A Parquet folder sorted like the serving table."""

    path: str
    order: tuple[str, ...] = SERVING_ORDER


def write_sorted(df: DataFrame, path: str, order: Sequence[str] = SERVING_ORDER) -> None:
    """Globally sorted files: ranges of the sort key between files, sorted rows within."""
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    replace(ranged, path)


def export(mart: DataFrame, target: JdbcTarget | PathTarget) -> None:
    rows = mart.withColumn("day", F.col("day").cast("date")).select("day", "customer_status", "cnt")
    if isinstance(target, PathTarget):
        write_sorted(rows, target.path, target.order)
    else:
        rows.write.format("jdbc").options(**target.options()).mode("overwrite").save()


def replace_from_lines(lines: DataFrame, target: JdbcTarget | PathTarget) -> int:
    """Parses text lines and replaces the target's rows; returns how many.

    All lines are parsed and written aside first. A bad line or an empty input fails there and the
    target keeps its rows.
    """
    spark = lines.sparkSession
    aside = scratch_dir(spark, "lines")
    parse_lines(lines).write.parquet(aside)
    rows = spark.read.parquet(aside)
    count = rows.count()
    if count == 0:
        raise ValueError("no lines to load; expected day,status,cnt")
    export(rows, target)
    return count
