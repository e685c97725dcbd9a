"""The trend engine as one chained append-mode plan.

Where :class:`~hashtrend.streaming.indicator_stream.IndicatorSink` recomputes windows from tables it wrote, this form
keeps everything in Spark's state: each windowed aggregate feeds the next one, and a window leaves the plan once the
watermark has passed its end.

``posts -> (window, tag) -> (window, tag) by neighbour -> smoothing window -> recurrent window``

1. ``window_metrics``: A1, A2, A4-A7 and the distinct co-tags of every tag in every analytic window (T2, T3).
2. ``indicator_stream``: A8 and A9.  Co-occurrence is symmetric, so a tag's volume is *sent* to each of its neighbours
   and summed there: one more aggregate on the same window, no stream-stream join.  (A join of two aggregates would
   lose rows: an aggregate emits a window after the watermark has passed it, and Spark's symmetric join does not keep
   rows that are behind the watermark already.)  The self pair brings the tag's own metrics along.
3. ``feature_stream``: the window over window results (T4), A10 and V1 in one aggregate.
4. ``recurrent_stream``: the recurrent window over those (T6), V2.

No step reads history back, and none needs ``foreachBatch``; only V2's liveness rule, which looks at all tags of a
window, is applied where a micro-batch is written (T7): all rows of one window leave the plan in one micro-batch.

A tag's state in an open window holds its distinct authors and co-tags.  The foreachBatch form spreads these by item
and is the one for tags whose authors within one window exceed an executor's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hashtrend.config import Windows
from hashtrend.functions.tags import hashtags
from hashtrend.functions.time import slot_index
from hashtrend.functions.vectors import slot_vector, zero_filled
from hashtrend.operators import with_velocity
from hashtrend.operators.indicators import BASE_COLUMNS
from hashtrend.operators.vectors import FEATURES
from hashtrend.session import use_rocksdb
from hashtrend.streaming.posts import timed_posts


def interval(us: int) -> str:
    return f"{us // 1_000_000} seconds" if us % 1_000_000 == 0 else f"{us} microseconds"


def _sliding(time: str | F.Column, win: Windows, length: int, slide: int = 1) -> F.Column:
    return F.window(time, interval(length * win.batch_us), interval(slide * win.batch_us))


def window_metrics(posts: DataFrame, win: Windows) -> DataFrame:
    """``(w, tag)`` with ``BASE_COLUMNS`` and ``neighbours``, one row per analytic window and tag; ``posts`` carry their
    watermark (:func:`~hashtrend.streaming.posts.timed_posts`)."""
    tagged = posts.select(
        "ts", "screen_name", "followers_count", "friends_count", "retweet_count", hashtags("text").alias("tags")
    )
    occurrences = tagged.select("*", F.explode("tags").alias("tag")).withColumn("w", _sliding("ts", win, win.analytic))
    recent = F.unix_micros("ts") >= F.unix_micros("w.end") - F.lit(win.half * win.batch_us)
    return occurrences.groupBy("w", "tag").agg(
        F.count(F.lit(1)).alias("volume"),
        F.count_if(recent).alias("half_volume"),
        F.size(F.collect_set("screen_name")).cast("long").alias("unique_users"),
        F.sum(F.col("followers_count").cast("long")).alias("follower_reach"),
        F.sum(F.col("friends_count").cast("long")).alias("friend_reach"),
        F.sum(F.col("retweet_count").cast("long")).alias("retweeted_volume"),
        F.array_distinct(F.flatten(F.collect_set(F.array_distinct("tags")))).alias("neighbours"),
    )


def indicator_stream(posts: DataFrame, win: Windows) -> DataFrame:
    """``(w, tag)`` with A1-A9: every tag's volume summed at its neighbours."""
    sent = window_metrics(posts, win).select("*", F.explode("neighbours").alias("to"))
    own = F.col("to") == F.col("tag")
    received = sent.groupBy("w", F.col("to").alias("tag")).agg(
        *[F.max(F.when(own, F.col(c))).alias(c) for c in BASE_COLUMNS],
        F.count(F.lit(1)).alias("activeness"),
        F.sum("volume").alias("first_degree"),
    )
    return with_velocity(received)


def feature_stream(indicators: DataFrame, win: Windows) -> DataFrame:
    """``(r, tag)`` with A10 and V1 (T4): indicator windows re-windowed by their own time."""
    again = indicators.withColumn("r", _sliding(F.window_time("w"), win, win.analytic))
    now = F.col("r.end") == F.col("w.end")
    smoothed = again.groupBy("r", "tag").agg(
        *[F.max(F.when(now, F.col(c))).alias(c) for c in FEATURES[:3]],
        F.sum("first_degree").alias("first_degree_smoothed"),
    )
    return smoothed.withColumn("features", zero_filled([F.col(c) for c in FEATURES]))


def recurrent_stream(features: DataFrame, win: Windows) -> DataFrame:
    """``(v, tag)`` with V2's ``features`` and ``newest``, whether the tag is in the newest slot (T6)."""
    again = features.withColumn("v", _sliding(F.window_time("r"), win, win.rec_window, win.rec_slide))
    behind = F.call_function("div", F.unix_micros("v.end") - F.unix_micros("r.end"), F.lit(win.batch_us).cast("long"))
    pos = (F.lit(win.rec_window - 1) - behind).cast("int")
    grouped = again.groupBy("v", "tag").agg(
        F.collect_list(F.struct(pos.alias("pos"), F.col("features"))).alias("slots"), F.max(pos).alias("last")
    )
    vector = slot_vector(F.col("slots"), win.rec_window, win.n_features)
    return grouped.select("v", "tag", vector.alias("features"), (F.col("last") == win.rec_window - 1).alias("newest"))


def _with_index(frame: DataFrame, window: str, win: Windows) -> DataFrame:
    rest = [c for c in frame.columns if c != window]
    return frame.select(slot_index(F.col(f"{window}.end"), win.batch_us).alias("w_idx"), *rest)


class LiveVectorSink:
    """Writes each micro-batch's recurrent vectors of the windows whose newest slot holds any tag.

    A replayed micro-batch overwrites its own folder."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            live = batch.where("newest").select("w_idx").distinct()
            kept = batch.join(live, "w_idx", "left_semi").select("w_idx", "tag", "features")
            kept.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")
        finally:
            batch.unpersist()


STAGES = ("indicators", "feature_vectors", "recurrent_vectors")


def start_chained_stream(
    posts: DataFrame,
    out_dir: str,
    win: Windows,
    stage: str = "recurrent_vectors",
    *,
    watermark: str = "0 seconds",
    distinct: bool = False,
    checkpoint: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """One query that ends at ``stage`` and writes ``<out_dir>/<stage>``; the checkpoint defaults to a folder beside it.

    ``distinct`` drops posts delivered twice within the watermark's delay.  Indicators and feature vectors go to Spark's own Parquet sink (exactly once); recurrent vectors pass the liveness
    rule on their way."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}; one of {STAGES}")
    use_rocksdb(posts.sparkSession)
    out = f"{out_dir.rstrip('/')}/{stage}"
    checkpoint = checkpoint or f"{out_dir.rstrip('/')}/_checkpoint_{stage}"
    frame = indicator_stream(timed_posts(posts, watermark, distinct), win)
    if stage == "indicators":
        rows = _with_index(frame, "w", win)
    else:
        frame = feature_stream(frame, win)
        rows = _with_index(frame, "r", win)
        if stage == "recurrent_vectors":
            rows = _with_index(recurrent_stream(frame, win), "v", win)
    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).queryName(f"{stage}-{abs(hash(out)) % 10**6}")
    writer = writer.foreachBatch(LiveVectorSink(out)) if stage == "recurrent_vectors" else writer.format("parquet").option("path", out)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
