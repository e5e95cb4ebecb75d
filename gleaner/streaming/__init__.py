"""Structured Streaming extensions: incremental ingest, request windows, sessions."""
