"""Structured Streaming in three forms: one chained append-mode plan (``chained``), shares in per-tag state
(``tag_state``), and a pane aggregate with a ``foreachBatch`` sink that runs the batch operators on bounded history
(``indicator_stream``)."""

from hashtrend.streaming.chained import feature_stream, indicator_stream, recurrent_stream, start_chained_stream
from hashtrend.streaming.indicator_stream import (
    IndicatorSink,
    flush_stream,
    pane_stream,
    posts_stream_from_json_lines,
    start_bad_record_sink,
    start_indicator_stream,
)
from hashtrend.streaming.posts import timed_posts
from hashtrend.streaming.tag_state import share_stream, start_share_stream

__all__ = [
    "IndicatorSink",
    "feature_stream",
    "flush_stream",
    "indicator_stream",
    "pane_stream",
    "posts_stream_from_json_lines",
    "recurrent_stream",
    "share_stream",
    "start_bad_record_sink",
    "start_chained_stream",
    "start_indicator_stream",
    "start_share_stream",
    "timed_posts",
]
