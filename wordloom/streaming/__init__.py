"""Streams of texts, messages and uses."""

from .builders import bigram_stream, history_state, learn_batch, learn_stream, track_stream

__all__ = ["bigram_stream", "history_state", "learn_batch", "learn_stream", "track_stream"]
