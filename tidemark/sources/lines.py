"""`day,status,cnt` text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines_from_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def lines_from_text(spark: SparkSession, text: str) -> DataFrame:
    """Lines of one text that the caller already holds, such as an environment variable."""
    return spark.createDataFrame([(text.strip(),)], "text string").select(
        F.explode(F.split("text", r"\r?\n")).alias("line")
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Typed mart rows. A line without exactly three fields, or with a bad day or count, fails the job."""
    fields = F.split("line", ",")
    checked = F.when(F.size(fields) == 3, fields).otherwise(
        F.raise_error(F.concat(F.lit("expected day,status,cnt but got: "), F.col("line")))
    )
    return lines.select(checked.alias("f")).select(
        F.trim(F.col("f")[0]).cast("date").alias("day"),
        F.trim(F.col("f")[1]).alias("customer_status"),
        F.trim(F.col("f")[2]).cast("bigint").alias("cnt"),
    )
