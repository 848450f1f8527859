"""Incremental recognition: a stream of documents into a table of mentions, resumable."""

from tagmill.streaming.mentions import mention_stream

__all__ = ["mention_stream"]
