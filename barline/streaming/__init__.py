"""Structured Streaming forms of the bars, the signals, the upserts and the position state."""

from barline.streaming.ordered import closed_trades, position_stream, signal_stream
from barline.streaming.replay import replay
from barline.streaming.streams import as_ticks, dedup_stream, event_stream, hour_bar_stream, run_available, session_stream, sliding_stream, upsert_batch

__all__ = ["as_ticks", "closed_trades", "dedup_stream", "event_stream", "hour_bar_stream", "position_stream", "replay", "run_available", "session_stream", "signal_stream", "sliding_stream", "upsert_batch"]
