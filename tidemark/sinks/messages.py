"""Message producers: one UTF-8 JSON text per event; a `key` keeps its messages in one partition of a topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def to_text(messages: DataFrame, path: str, mode: str = "append") -> None:
    messages.select("value").write.mode(mode).text(path)


def to_kafka(
    messages: DataFrame, brokers: str, topic: str, checkpoint: str | None = None
) -> StreamingQuery | None:
    """Sends a batch, or starts a stream when `messages` is one. Needs the Kafka connector."""
    options = {"kafka.bootstrap.servers": brokers, "topic": topic}
    messages = messages.select(*[c for c in ("key", "value") if c in messages.columns])
    if not messages.isStreaming:
        messages.write.format("kafka").options(**options).save()
        return None
    if not checkpoint:
        raise ValueError("a streaming producer needs a checkpoint folder")
    writer = messages.writeStream.format("kafka").options(**options)
    return writer.option("checkpointLocation", checkpoint).start()
