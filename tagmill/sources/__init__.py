"""Readers: Parquet tables, JSON lines with quarantine, weighted CSV lists."""

from tagmill.sources.tables import table

__all__ = ["table"]
