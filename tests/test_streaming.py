"""Batch = stream: the stream over time-ordered message files gives the same
indicators, feature vectors and recurrent vectors as the batch engine on
every window the stream has closed."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from hashtrend.config import HOURLY
from hashtrend.plans.tables import INDICATOR_COLUMNS, IndicatorTables
from hashtrend.sources import decode, drop_delete_notices, raw_messages_from_events
from hashtrend.streaming.indicator_stream import (
    flush_stream,
    posts_stream_from_json_lines,
    start_bad_record_sink,
    start_indicator_stream,
)

SF = "/root/testdata/sf0.001"
N_FILES = 4


@pytest.fixture(scope="module")
def streamed(spark):
    work = tempfile.mkdtemp(prefix="hashtrend-stream-")
    inbox = os.path.join(work, "inbox")
    os.makedirs(inbox)
    raw = raw_messages_from_events(spark.read.parquet(f"{SF}/events.parquet"))
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_id").cast("string").alias("key"), "ts")
    # Small fixture: the chunks are written from the driver on purpose.
    rows = raw.join(events, "key").orderBy("ts").select("value").collect()
    size = -(-len(rows) // N_FILES)
    for i in range(N_FILES):
        path = os.path.join(inbox, f"part-{i:02d}.json")
        with open(path, "w") as f:
            f.write("\n".join(r.value for r in rows[i * size : (i + 1) * size]) + "\n")
        os.utime(path, (1_000_000 + i, 1_000_000 + i))

    posts, bad = posts_stream_from_json_lines(spark, inbox, max_files_per_trigger=1)
    out = os.path.join(work, "out")
    q = start_indicator_stream(
        posts,
        out,
        HOURLY,
        checkpoint=os.path.join(work, "ckpt"),
        trigger={"availableNow": True},
    )
    qb = start_bad_record_sink(
        bad, os.path.join(out, "bad_records"), checkpoint=os.path.join(work, "ckpt_bad"), trigger={"availableNow": True}
    )
    q.awaitTermination(600)
    qb.awaitTermination(600)
    assert q.exception() is None and qb.exception() is None
    frontier = spark.read.parquet(os.path.join(out, "progress")).agg(F.max("frontier")).first()[0]

    batch_posts, _ = decode(drop_delete_notices(spark.read.text(inbox).select(F.lit(None).cast("string").alias("key"), "value")))
    return spark, out, frontier, IndicatorTables(batch_posts, HOURLY), q


def test_bad_records_equal_batch(streamed):
    spark, out, frontier, tables, _ = streamed
    inbox_bad = decode(
        drop_delete_notices(raw_messages_from_events(spark.read.parquet(f"{SF}/events.parquet")))
    )[1].select("value")
    streamed_bad = spark.read.parquet(os.path.join(out, "bad_records")).select("value")
    assert streamed_bad.count() == inbox_bad.count() > 0
    assert streamed_bad.exceptAll(inbox_bad).count() == 0


def _same(a, b):
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0
    assert b.exceptAll(a).count() == 0


def _rounded(df, cols):
    return df.select(*[F.round(c, 9).alias(c) if c in {"percent_share", "reference_share_mean", "reference_share_halving", "delta_share", "delta_share_halving"} else F.col(c) for c in cols])


def test_stream_made_progress(streamed):
    spark, out, frontier, tables, q = streamed
    assert frontier is not None
    assert len(q.recentProgress) >= N_FILES
    # Only the last open pane(s) stay behind: the stream closed nearly every window.
    last_slot = tables.occurrences.agg(F.max("slot")).first()[0]
    assert frontier >= last_slot - 48
    closed = tables.indicators.where(F.col("w_idx") <= frontier).count()
    assert closed >= 0.9 * tables.indicators.count()


def test_indicators_equal_batch(streamed):
    spark, out, frontier, tables, _ = streamed
    cols = ["w_idx", "tag", *INDICATOR_COLUMNS]
    s = spark.read.parquet(os.path.join(out, "indicators")).where(F.col("w_idx") <= frontier)
    b = tables.indicators.where(F.col("w_idx") <= frontier)
    _same(_rounded(s, cols), _rounded(b, cols))


def test_feature_vectors_equal_batch(streamed):
    spark, out, frontier, tables, _ = streamed
    s = spark.read.parquet(os.path.join(out, "feature_vectors")).where(F.col("w_idx") <= frontier)
    b = tables.feature_vectors.where(F.col("w_idx") <= frontier)
    _same(s.select("w_idx", "tag", "features"), b.select("w_idx", "tag", "features"))


def test_recurrent_vectors_equal_batch(streamed):
    spark, out, frontier, tables, _ = streamed
    s = spark.read.parquet(os.path.join(out, "recurrent_vectors")).where(F.col("w_idx") <= frontier)
    b = tables.recurrent_vectors.where(F.col("w_idx") <= frontier)
    assert s.count() > 0
    _same(s.select("w_idx", "tag", "features"), b.select("w_idx", "tag", "features"))


def test_sink_replay_and_restart_are_idempotent(spark, tmp_path):
    """Replaying a micro-batch and restarting the sink leave the same tables."""
    from hashtrend.sources import posts_from_events
    from hashtrend.streaming.indicator_stream import IndicatorSink, pane_stream

    posts = posts_from_events(spark.read.parquet(f"{SF}/events.parquet"))
    panes = pane_stream(posts, HOURLY)  # the same aggregate, run as a batch
    slots = F.unix_micros(F.col("pane.start"))
    cuts = panes.select(F.percentile_approx(slots, [0.33, 0.66]).alias("q")).first().q
    chunks = [
        panes.where(slots < cuts[0]),
        panes.where((slots >= cuts[0]) & (slots < cuts[1])),
        panes.where(slots >= cuts[1]),
    ]
    out = str(tmp_path / "out")
    sink = IndicatorSink(out, HOURLY)
    sink(chunks[0], 0)
    sink(chunks[1], 1)
    sink(chunks[1], 1)  # replay: writes of batch 1 happened, commit did not
    IndicatorSink(out, HOURLY)(chunks[2], 2)  # restarted driver, fresh sink object

    frontier = spark.read.parquet(f"{out}/progress").agg(F.max("frontier")).first()[0]
    tables = IndicatorTables(posts, HOURLY)
    cols = ["w_idx", "tag", *INDICATOR_COLUMNS]
    s = spark.read.parquet(f"{out}/indicators").where(F.col("w_idx") <= frontier)
    _same(_rounded(s, cols), _rounded(tables.indicators.where(F.col("w_idx") <= frontier), cols))
    s = spark.read.parquet(f"{out}/recurrent_vectors").where(F.col("w_idx") <= frontier)
    b = tables.recurrent_vectors.where(F.col("w_idx") <= frontier)
    _same(s.select("w_idx", "tag", "features"), b.select("w_idx", "tag", "features"))


def test_stream_reports_equal_batch(streamed):
    from hashtrend.operators import top_n

    spark, out, frontier, tables, _ = streamed
    cols = ["w_idx", "rank", "tag", "value", "n_total"]
    for metric in ("volume", "delta_share"):
        s = spark.read.parquet(os.path.join(out, f"top_{metric}")).where(F.col("w_idx") <= frontier)
        b = top_n(tables.indicators, metric, 10).where(F.col("w_idx") <= frontier)
        assert s.count() > 0
        _same(s.select(*cols).withColumn("value", F.round("value", 9)), b.select(*cols).withColumn("value", F.round("value", 9)))
    s = spark.read.parquet(os.path.join(out, "top_vectors")).where(F.col("w_idx") <= frontier)
    rv = tables.recurrent_vectors.withColumn("newest_volume", F.col("features")[(HOURLY.rec_window - 1) * 4])
    b = top_n(rv, "newest_volume", 10).where(F.col("w_idx") <= frontier)
    _same(s.select(*cols), b.select(*cols))


def test_stream_reproduces_golden_fixture_at_reference_cadence(spark, tmp_path):
    """2 s batches, 32 s windows: the golden values of FIXTURES.md from the stream."""
    import json
    import math

    from fixture_posts import GOLDEN, GOLDEN_RECURRENT_10, POSTS

    from hashtrend.config import REFERENCE

    def msg(i, sec, user, fol, fri, rt, text):
        t = {"id": i, "timestamp_ms": str(int(sec * 1000)), "text": text,
             "user": {"screen_name": user, "followers_count": fol, "friends_count": fri}}
        if rt is not None:
            t["retweeted_status"] = {"retweet_count": rt}
        return json.dumps(t)

    inbox = tmp_path / "inbox"
    inbox.mkdir()
    # Two later sentinel posts move the watermark past every window up to t = 62.
    files = [POSTS[:5], POSTS[5:], [(300, "z", 0, 0, None, "#end")], [(400, "z", 0, 0, None, "#end2")]]
    n = 0
    for k, chunk in enumerate(files):
        lines = []
        for sec, user, fol, fri, rt, text in chunk:
            n += 1
            lines.append(msg(n, sec, user, fol, fri, rt, text))
        path = inbox / f"part-{k:02d}.json"
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (1_000_000 + k, 1_000_000 + k))

    posts, _ = posts_stream_from_json_lines(spark, str(inbox), max_files_per_trigger=1)
    out = str(tmp_path / "out")
    q = start_indicator_stream(
        posts, out, REFERENCE, checkpoint=str(tmp_path / "ckpt"), trigger={"availableNow": True}, reports={}
    )
    q.awaitTermination(600)
    assert q.exception() is None

    ind = {(r.w_idx * 2, r.tag): r for r in spark.read.parquet(f"{out}/indicators").collect()}
    fv = {(r.w_idx * 2, r.tag): r.features for r in spark.read.parquet(f"{out}/feature_vectors").collect()}
    for t, tag, vol, half, vel, users, fol, fri, rt, act, deg, sdeg, share, ref_mean, ref_halving in GOLDEN:
        assert fv[(t, tag)][3] == sdeg, (t, tag)
        if vol is None:
            assert (t, tag) not in ind
            continue
        r = ind[(t, tag)]
        assert (r.volume, r.half_volume, r.velocity, r.unique_users) == (vol, half, vel, users), (t, tag)
        assert (r.follower_reach, r.friend_reach, r.retweeted_volume) == (fol, fri, rt), (t, tag)
        assert (r.activeness, r.first_degree) == (act, deg), (t, tag)
        assert math.isclose(r.percent_share, share, abs_tol=1e-6)
        assert math.isclose(r.reference_share_mean, ref_mean, abs_tol=1e-6)
        assert math.isclose(r.reference_share_halving, ref_halving, abs_tol=1e-6)
    rv = {r.tag: r.features for r in spark.read.parquet(f"{out}/recurrent_vectors").where("w_idx = 5").collect()}
    assert {k: v[-20:] for k, v in rv.items()} == {k: [float(x) for x in v] for k, v in GOLDEN_RECURRENT_10.items()}


def test_stream_drops_posts_behind_the_watermark(spark, tmp_path):
    """T8: a post older than the watermark is dropped; closed windows keep their values.

    Spark filters late rows with the previous micro-batch's watermark (the
    current one only evicts), so the late post comes two files after the
    posts that moved the watermark past it.  A pane Spark does emit always
    ends after that previous watermark, hence after the sink's frontier.
    """
    import json

    from fixture_posts import GOLDEN, POSTS

    from hashtrend.config import REFERENCE

    def msg(i, sec, text, user="late"):
        return json.dumps({"id": i, "timestamp_ms": str(int(sec * 1000)), "text": text,
                           "user": {"screen_name": user, "followers_count": 1, "friends_count": 1}})

    inbox = tmp_path / "inbox"
    inbox.mkdir()
    files = [
        [msg(i + 1, s, text, user) for i, (s, user, _f, _r, _rt, text) in enumerate(POSTS)],
        [msg(101, 300, "#end")],
        [msg(100, 15, "#late #spark")],  # two batches behind: the late-row watermark is 40 s
        [msg(102, 400, "#end2")],
        [msg(103, 500, "#end3")],
    ]
    for k, lines in enumerate(files):
        path = inbox / f"part-{k:02d}.json"
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (1_000_000 + k, 1_000_000 + k))
    posts, _ = posts_stream_from_json_lines(spark, str(inbox), max_files_per_trigger=1)
    out = str(tmp_path / "out")
    q = start_indicator_stream(
        posts, out, REFERENCE, checkpoint=str(tmp_path / "ckpt"), trigger={"availableNow": True}, reports={}
    )
    q.awaitTermination(600)
    assert q.exception() is None
    dropped = sum(s.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for s in p.get("stateOperators", []))
    assert dropped > 0
    ind = spark.read.parquet(f"{out}/indicators")
    assert ind.where("tag = '#late'").count() == 0
    vol = {(r.w_idx * 2, r.tag): r.volume for r in ind.collect()}
    for t, tag, v, *_ in GOLDEN:
        if v is not None:
            assert vol[(t, tag)] == v, (t, tag)


def _landing(tmp_path, chunks, first=0):
    """JSON-lines files of (second, user, text) posts, one per chunk, in landing order."""
    import json

    inbox = tmp_path / "inbox"
    inbox.mkdir(exist_ok=True)
    for k, chunk in enumerate(chunks, first):
        lines = [
            json.dumps({"id": 1000 * k + i, "timestamp_ms": str(int(sec * 1000)), "text": text,
                        "user": {"screen_name": user, "followers_count": 1, "friends_count": 1}})
            for i, (sec, user, text) in enumerate(chunk)
        ]
        path = inbox / f"part-{k:02d}.json"
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (1_000_000 + k, 1_000_000 + k))
    return str(inbox)


def _run(spark, inbox, out):
    from hashtrend.config import REFERENCE

    posts, _ = posts_stream_from_json_lines(spark, inbox, max_files_per_trigger=1)
    q = start_indicator_stream(posts, out, REFERENCE, trigger={"availableNow": True}, reports={})
    q.awaitTermination(600)
    assert q.exception() is None


def test_stream_start_without_vectors_silence_and_restart(spark, tmp_path):
    """A first batch that closes no recurrent window, then only tagless posts; a second run goes on from the default
    checkpoint under the output folder and adds no second row for a window and tag."""
    from hashtrend.config import REFERENCE
    from hashtrend.sources import decode

    start = [(10 + i, f"u{i % 3}", "#a #b" if i % 2 else "#a") for i in range(8)]
    silent = [[(s, "u9", "no tags here")] for s in (46, 80, 120)]
    out = str(tmp_path / "out")
    inbox = _landing(tmp_path, [start, *silent[:2]])
    _run(spark, inbox, out)
    _landing(tmp_path, silent[2:], first=3)
    _run(spark, inbox, out)

    ind = spark.read.parquet(f"{out}/indicators")
    assert ind.groupBy("w_idx", "tag").count().where("count > 1").count() == 0
    frontier = spark.read.parquet(f"{out}/progress").agg(F.max("frontier")).first()[0]
    assert frontier >= 40  # ticks of tagless posts close the slides up to 80 s
    raw = spark.read.text(inbox).select(F.lit(None).cast("string").alias("key"), "value")
    tables = IndicatorTables(decode(raw)[0], REFERENCE)
    cols = ["w_idx", "tag", *INDICATOR_COLUMNS]
    batch = tables.indicators.where(F.col("w_idx") <= frontier)
    assert batch.count() == tables.indicators.count()  # all windows that hold a tag are closed
    _same(_rounded(ind, cols), _rounded(batch, cols))


def test_output_of_another_query_is_refused(spark, tmp_path):
    from hashtrend.config import REFERENCE

    out = tmp_path / "out"
    (out / "progress").mkdir(parents=True)
    posts, _ = posts_stream_from_json_lines(spark, _landing(tmp_path, [[(1, "u", "#a")]]))
    with pytest.raises(ValueError, match="checkpoint"):
        start_indicator_stream(posts, str(out), REFERENCE)


def test_flush_gives_every_window_of_bounded_input(streamed):
    """After the flush the tables equal the batch engine's on all windows; a second flush changes nothing and a
    stream cannot go on."""
    spark, out, frontier, tables, _ = streamed
    cols = ["w_idx", "tag", *INDICATOR_COLUMNS]
    owed = tables.indicators.where(F.col("w_idx") > frontier).count()
    assert owed > 0
    for _ in range(2):
        flush_stream(tables.posts, out, HOURLY)
        _same(_rounded(spark.read.parquet(f"{out}/indicators"), cols), _rounded(tables.indicators, cols))
    for name, want in (("feature_vectors", tables.feature_vectors), ("recurrent_vectors", tables.recurrent_vectors)):
        got = spark.read.parquet(f"{out}/{name}")
        _same(got.select("w_idx", "tag", "features"), want.select("w_idx", "tag", "features"))
    posts, _ = posts_stream_from_json_lines(spark, os.path.join(os.path.dirname(out), "inbox"))
    with pytest.raises(ValueError, match="flush_stream"):
        start_indicator_stream(posts, out, HOURLY, checkpoint=os.path.join(os.path.dirname(out), "ckpt"))
