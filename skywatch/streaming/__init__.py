"""Structured Streaming form of the file load (exactly-once, incremental)."""

from skywatch.streaming.ingest import ingest_checkpoint, ingest_new_files, start_ingest

__all__ = ["ingest_checkpoint", "ingest_new_files", "start_ingest"]
