"""Message stream to the bronze table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.cdc import accepted, once_within, parse_cdc
from tidemark.schemas import BRONZE_PARTITIONS, message_schema
from tidemark.sinks.tables import FILES_PER_DAY, by_day


def ingest(
    messages: DataFrame,
    target: str,
    checkpoint: str,
    schema: T.StructType | None = None,
    ts_type: str = "timestamp",
    available_now: bool = False,
    every: str | None = None,
    as_table: bool = False,
    files_per_day: int = FILES_PER_DAY,
    keep_malformed: bool = False,
    once: str | None = None,
    key: str = "customer_id",
) -> StreamingQuery:
    """Starts the append of parsed messages to the bronze folder, or to a catalog table.

    Rejects land in their own partition of the same folder, so the source is read once and every
    message is stored exactly once. By default micro-batches follow each other without pause;
    `every` spaces them, `available_now` stops after what is there. A micro-batch writes at most
    `files_per_day` files a day. `keep_malformed` stores rejects as NULL events instead.

    With `once`, such as "7 days", a message that was delivered before within that time, under
    whatever name, adds nothing (`once_within`). Its state grows with that time's messages: on a
    cluster use a state store that keeps it on disk.
    """
    parsed = parse_cdc(messages, schema or message_schema(), ts_type=ts_type)
    if once:
        parsed = once_within(parsed, key, once)
    if keep_malformed:
        none = F.lit(None).cast("string")
        kept = {"reject_id": none, "reject_reason": none, "raw": none, "rejected": F.lit(False)}
        parsed = accepted(parsed, keep_malformed=True).withColumns(kept).select(*parsed.columns)
    parsed = by_day(parsed, files_per_day)
    if as_table:
        parsed = parsed.select(*messages.sparkSession.table(target).columns)
    writer = parsed.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    if as_table:
        return writer.toTable(target)
    return writer.format("parquet").partitionBy(*BRONZE_PARTITIONS).option("path", target).start()
