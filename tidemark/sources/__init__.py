"""Readers: message streams and files, layer tables, text lines, synthetic events."""

from tidemark.sources.generator import event_clock, generate_events, rate_rows, sequence_rows
from tidemark.sources.lines import lines_from_files, lines_from_text, parse_lines
from tidemark.sources.messages import kafka_messages, text_messages
from tidemark.sources.tables import read_bronze, read_layer

__all__ = [
    "event_clock",
    "generate_events",
    "kafka_messages",
    "lines_from_files",
    "lines_from_text",
    "parse_lines",
    "rate_rows",
    "read_bronze",
    "read_layer",
    "sequence_rows",
    "text_messages",
]
