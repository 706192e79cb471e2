"""Incremental ingestion with Structured Streaming."""

from tablesmith.streaming.activity import stream_activity_log

__all__ = ["stream_activity_log"]
