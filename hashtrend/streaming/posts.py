"""Post streams as the stateful plans take them: event time with its watermark, each post once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def timed_posts(posts: DataFrame, watermark: str = "0 seconds", distinct: bool = False) -> DataFrame:
    """``posts`` with the watermark on ``ts``; with ``distinct``, replayed messages are dropped.

    A Kafka producer or a re-landed file may deliver a post again.  Its ``post_id`` stays in state for the watermark's
    delay after the post's time, so a copy that arrives within that delay of the first is dropped, whatever its own
    payload; posts without an id count as one and the same, so ``decode`` keeps them apart as bad records first.
    """
    timed = posts.withWatermark("ts", watermark)
    return timed.dropDuplicatesWithinWatermark(["post_id"]) if distinct else timed
