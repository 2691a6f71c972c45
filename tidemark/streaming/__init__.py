"""Structured Streaming jobs."""

from tidemark.streaming.dimension import upsert_stream
from tidemark.streaming.ingest import ingest

__all__ = ["ingest", "upsert_stream"]
