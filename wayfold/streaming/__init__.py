"""Structured Streaming: ingest, orphan buffering, session windows."""
