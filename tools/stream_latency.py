"""Micro-batch times of the streaming forms at the reference's cadence.

    python tools/stream_latency.py [sf_dir] [posts a second] [slides] [form ...]

The ``events``-derived messages are squeezed in time to the given rate, so that a 2 s slide holds ``2 * rate`` posts, and
landed as one file a slide in a fresh scratch folder.  Each form (``chained`` up to recurrent vectors, ``features``,
``indicators``, ``shares``, ``sink`` for the foreachBatch form) then reads one file a trigger.  Prints the median and
95th percentile of the whole micro-batch over those after the first ``WARM``, in seconds.
"""

from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

WARM = 20
FORMS = ("chained", "features", "indicators", "shares", "sink")


def land(spark, sf_dir: str, folder: str, rate: float, slides: int) -> None:
    """One JSON-lines file a 2 s slide, in time order, ``rate`` posts a second."""
    from pyspark.sql import functions as F

    from hashtrend.sources import raw_messages_from_events

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last, n = events.agg(F.min(us), F.max(us), F.count(F.lit(1))).first()
    span = n / rate * 1e6
    squeezed = ((us - first) * F.lit(span / (last - first))).cast("long") + F.lit(1_700_000_000_000_000)
    events = events.withColumn("ts", F.timestamp_micros(squeezed))
    times = events.select(F.col("event_id").cast("string").alias("key"), "ts")
    slide = F.call_function("div", F.unix_micros("ts") - F.lit(1_700_000_000_000_000), F.lit(2_000_000).cast("long"))
    staged = raw_messages_from_events(events).join(times, "key").select(slide.alias("slide"), "value").where(F.col("slide") < slides)
    staged.repartition(8, "slide").write.partitionBy("slide").text(f"{folder}-staged")
    os.makedirs(folder)
    for path in Path(f"{folder}-staged").glob("slide=*/part-*"):
        at = int(path.parent.name.split("=")[1])
        os.utime(path, (1_000_000 + at, 1_000_000 + at))
        os.link(path, f"{folder}/slide-{at:05d}.json")


def batch_seconds(spark, inbox: str, out: str, form: str) -> list[float]:
    """Seconds of every micro-batch (planning, state commit and sink included)."""
    from hashtrend.config import REFERENCE
    from hashtrend.streaming import posts_stream_from_json_lines, start_chained_stream, start_indicator_stream, start_share_stream

    posts, _ = posts_stream_from_json_lines(spark, inbox, max_files_per_trigger=1)
    options = {"trigger": {"availableNow": True}}
    if form == "sink":
        q = start_indicator_stream(posts, out, REFERENCE, **options)
    elif form == "shares":
        q = start_share_stream(posts, out, REFERENCE, buckets=8, **options)
    else:
        q = start_chained_stream(posts, out, REFERENCE, {"chained": "recurrent_vectors", "features": "feature_vectors"}.get(form, form), **options)
    q.awaitTermination(3600)
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return [p["durationMs"]["triggerExecution"] / 1000 for p in q.recentProgress if p["numInputRows"]]


def quantile(values: list[float], share: float) -> float:
    ordered = sorted(values)
    return ordered[min(len(ordered) - 1, int(share * len(ordered)))]


def main() -> None:
    from hashtrend.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    rate = float(sys.argv[2]) if len(sys.argv) > 2 else 500.0
    slides = int(sys.argv[3]) if len(sys.argv) > 3 else 90
    work = tempfile.mkdtemp(prefix="run-latency-")
    spark = build_session(**{"spark.checkpoint.dir": f"{work}/ckpt", "spark.sql.streaming.numRecentProgressUpdates": "1000"})
    land(spark, sf_dir, f"{work}/inbox", rate, slides)
    for form in sys.argv[4:] or FORMS:
        took = batch_seconds(spark, f"{work}/inbox", f"{work}/{form}", form)[WARM:]
        print(f"{form:12s} {rate:g} posts/s, {len(took)} micro-batches of one 2 s slide: p50 {quantile(took, 0.5):.2f} s, p95 {quantile(took, 0.95):.2f} s")
    spark.stop()


if __name__ == "__main__":
    main()
