"""Writers: layer tables, serving targets, messages."""

from tidemark.sinks.messages import to_kafka, to_text
from tidemark.sinks.serving import JdbcTarget, PathTarget, export, replace_from_lines, write_sorted
from tidemark.sinks.tables import append, by_day, overwrite_partitions, replace, write_bronze

__all__ = [
    "JdbcTarget",
    "PathTarget",
    "append",
    "by_day",
    "export",
    "overwrite_partitions",
    "replace",
    "replace_from_lines",
    "to_kafka",
    "to_text",
    "write_bronze",
    "write_sorted",
]
