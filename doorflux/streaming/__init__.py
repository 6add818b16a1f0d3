"""Incremental loading with Structured Streaming."""

from doorflux.streaming.incremental import stream_load

__all__ = ["stream_load"]
