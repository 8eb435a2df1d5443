"""Readers, ingest and derived views."""
