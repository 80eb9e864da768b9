"""Streaming ingest of landed files."""
