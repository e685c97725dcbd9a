"""The chained plan and the per-tag state equal the batch engine on every closed window, without reading history."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from hashtrend.config import HOURLY, Windows
from hashtrend.plans.tables import IndicatorTables
from hashtrend.sources import decode, drop_delete_notices, raw_messages_from_events
from hashtrend.streaming import posts_stream_from_json_lines, start_chained_stream, start_share_stream

SF = "/root/testdata/sf0.001"
SMALL = Windows(batch="1 hour", analytic=4, half=2, reference=8, rec_window=6, rec_slide=2)
SHARES = {"percent_share", "reference_share_mean", "reference_share_halving", "delta_share", "delta_share_halving"}


def _land(folder, parts):
    """Message lists as files in landing order."""
    os.makedirs(folder, exist_ok=True)
    have = len(os.listdir(folder))
    for i, part in enumerate(parts, have):
        path = os.path.join(folder, f"part-{i:03d}.json")
        with open(path, "w") as f:
            f.write("\n".join(part) + "\n")
        os.utime(path, (1_000_000 + i, 1_000_000 + i))


def _batch_posts(spark, folder):
    return decode(drop_delete_notices(spark.read.text(folder).select(F.lit(None).cast("string").alias("key"), "value")))[0]


def _run(start, *args, **options):
    q = start(*args, trigger={"availableNow": True}, **options)
    q.awaitTermination(600)
    assert q.exception() is None
    return q


def _same(got, want, least=1):
    cols = [c for c in want.columns if c in got.columns]
    neat = lambda df: df.select(*[F.round(c, 9).alias(c) if c in SHARES else F.col(c) for c in cols])
    last = got.agg(F.max("w_idx")).first()[0]
    got, want = neat(got), neat(want.where(F.col("w_idx") <= last))
    assert got.count() == want.count() >= least
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def _message(post_id, hour, user, text, retweets=None):
    tweet = {"id": post_id, "timestamp_ms": str(int(hour * 3_600_000)), "text": text, "user": {"screen_name": user, "followers_count": post_id % 97, "friends_count": None}}
    if retweets is not None:
        tweet["retweeted_status"] = {"retweet_count": retweets}
    return json.dumps(tweet)


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    work = str(tmp_path_factory.mktemp("chained"))
    events = spark.read.parquet(f"{SF}/events.parquet")
    raw = raw_messages_from_events(events).join(events.select(F.col("event_id").cast("string").alias("key"), "ts"), "key")
    rows = [r.value for r in raw.orderBy("ts").select("value").collect()]
    size = -(-len(rows) // 4)
    _land(f"{work}/inbox", [rows[i : i + size] for i in range(0, len(rows), size)])
    return work, IndicatorTables(_batch_posts(spark, f"{work}/inbox"), HOURLY)


@pytest.mark.parametrize("stage,table", [("indicators", "wide"), ("feature_vectors", "feature_vectors"), ("recurrent_vectors", "recurrent_vectors")])
def test_chained_stages_equal_batch(spark, landed, stage, table):
    work, tables = landed
    posts, _ = posts_stream_from_json_lines(spark, f"{work}/inbox", max_files_per_trigger=1)
    q = _run(start_chained_stream, posts, f"{work}/out", HOURLY, stage)
    assert len(q.recentProgress) >= 4
    _same(spark.read.parquet(f"{work}/out/{stage}"), getattr(tables, table), 1000)


def test_shares_equal_batch(spark, landed):
    work, tables = landed
    posts, _ = posts_stream_from_json_lines(spark, f"{work}/inbox", max_files_per_trigger=1)
    _run(start_share_stream, posts, f"{work}/out", HOURLY, buckets=3)
    _same(spark.read.parquet(f"{work}/out/shares"), tables.indicators, 1000)


@pytest.fixture(scope="module")
def gappy():
    """Posts with hours of silence, tags that come and go, one hot tag, empty texts, nulls and retweets."""
    rng = random.Random(5)
    out, post_id = [], 0
    for hour in [*range(100, 112), *range(125, 131), 150, 151, *range(190, 200)]:
        for _ in range(rng.randint(1, 8)):
            post_id += 1
            tags = rng.sample(["#a", "#b", "#c", "#d", f"#once{hour}"], rng.randint(0, 3))
            text = " ".join(["#hot", *tags, *tags[:1], "word"]) if rng.random() < 0.8 else "no tag"
            out.append(_message(post_id, hour + rng.random(), f"u{rng.randint(1, 4)}", text, rng.choice([None, 3])))
    return out


def test_gaps_restart_and_forgetting(spark, tmp_path, gappy):
    """Silent hours close windows by timer; a query that stops and starts again goes on; tags out of reach are gone."""
    work = str(tmp_path)
    cut = len(gappy) // 3
    parts = [gappy[i : i + 12] for i in range(0, len(gappy), 12)]
    posts = lambda: posts_stream_from_json_lines(spark, f"{work}/inbox", max_files_per_trigger=1)[0]
    for some in (parts[: cut // 12], parts[cut // 12 :], [[_message(10_000, 260, "u1", "closing")]]):
        _land(f"{work}/inbox", some)
        _run(start_share_stream, posts(), f"{work}/out", SMALL, buckets=2)
        _run(start_chained_stream, posts(), f"{work}/out", SMALL, "recurrent_vectors")
    tables = IndicatorTables(_batch_posts(spark, f"{work}/inbox"), SMALL)
    _same(spark.read.parquet(f"{work}/out/shares"), tables.indicators, 100)
    _same(spark.read.parquet(f"{work}/out/recurrent_vectors"), tables.recurrent_vectors, 20)
    state = spark.read.format("statestore").option("stateVarName", "past").option("operatorId", _state_operator(work)).load(f"{work}/out/_checkpoint_shares")
    assert state.count() == 0  # every tag's last share left the reference window before hour 260


def _state_operator(work):
    """The operator id whose state has variables: transformWithState is the one with a schema folder of its own."""
    base = f"{work}/out/_checkpoint_shares/state"
    return next(int(d) for d in sorted(os.listdir(base)) if os.path.isdir(f"{base}/{d}/_stateSchema") and any("past" in open(os.path.join(r, f), errors="ignore").read() for r, _, fs in os.walk(f"{base}/{d}/_stateSchema") for f in fs))


def test_replayed_messages_count_once(spark, tmp_path, gappy):
    """Messages delivered again within the watermark's delay leave all tables as if they had come once."""
    work = str(tmp_path)
    once = gappy[:60]
    parts = [once[i : i + 12] for i in range(0, len(once), 12)]
    replayed = [part + part[::3] + (parts[k - 1][-2:] if k else []) for k, part in enumerate(parts)]
    _land(f"{work}/inbox", replayed)
    _land(f"{work}/once", parts)
    posts, _ = posts_stream_from_json_lines(spark, f"{work}/inbox", max_files_per_trigger=1)
    tables = IndicatorTables(_batch_posts(spark, f"{work}/once"), SMALL)
    _run(start_chained_stream, posts, f"{work}/out", SMALL, "indicators", watermark="12 hours", distinct=True)
    _run(start_share_stream, posts, f"{work}/out", SMALL, buckets=2, watermark="12 hours", distinct=True)
    _same(spark.read.parquet(f"{work}/out/indicators"), tables.wide, 20)
    _same(spark.read.parquet(f"{work}/out/shares"), tables.indicators, 20)


def test_unknown_stage(spark, landed):
    with pytest.raises(ValueError):
        start_chained_stream(None, "x", SMALL, "shares")
