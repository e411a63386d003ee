"""Structured Streaming extension: keep-last upserts of append-only score files."""
