"""Operator-level tests: windows, range frame chunking, vectors, reports, invariants."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hashtrend.config import HOURLY, REFERENCE, Windows, duration_us
from hashtrend.operators import assemble_vectors, bounded_range_frame, top_n
from hashtrend.plans import catalog
from hashtrend.sources import posts_from_events

SF = "/root/testdata/sf0.001"


def test_windows_defaults_and_validation():
    assert REFERENCE.batch_us == 2_000_000
    assert REFERENCE.vector_width == 240
    assert HOURLY.batch_us == 3_600_000_000
    w = Windows.from_durations("2 seconds", "32 seconds", "512 seconds", "2 minutes", "10 seconds")
    assert (w.analytic, w.half, w.reference, w.rec_window, w.rec_slide) == (16, 8, 256, 60, 5)
    with pytest.raises(ValueError, match="multiple"):
        Windows.from_durations("2 seconds", "32 seconds", "512 seconds", "121 seconds", "10 seconds")
    with pytest.raises(ValueError, match="multiple"):
        Windows.from_durations("2 seconds", "32 seconds", "512 seconds", "2 minutes", "3 seconds")
    with pytest.raises(ValueError):
        Windows(analytic=0)
    with pytest.raises(ValueError):
        Windows(half=20)
    with pytest.raises(ValueError):
        duration_us("soon")


def test_bounded_range_frame_matches_plain_window(spark):
    rows = [(k, i, float(i % 7)) for k in ("a", "b") for i in range(0, 300, 3)]
    df = spark.createDataFrame(rows, "k string, i long, x double")

    def cols(w):
        return {"s": F.sum("x").over(w), "c": F.count("x").over(w)}

    plain_w = Window.partitionBy("k").orderBy("i").rangeBetween(-19, 0)
    plain = df.select("k", "i", F.sum("x").over(plain_w).alias("s"), F.count("x").over(plain_w).alias("c"))
    chunked = bounded_range_frame(df, ["k"], "i", 20, cols, chunk=32).select("k", "i", "s", "c")
    assert chunked.count() == df.count()
    assert plain.exceptAll(chunked).count() == 0 and chunked.exceptAll(plain).count() == 0
    with pytest.raises(ValueError):
        bounded_range_frame(df, ["k"], "i", 20, cols, chunk=10)


def test_assemble_vectors_full_outer_semantics(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0)], "w_idx long, tag string, a double")
    b = spark.createDataFrame([(1, "y", 5.0), (1, "z", 7.0)], "w_idx long, tag string, b double")
    got = {(r.w_idx, r.tag): r.features for r in assemble_vectors([a, b]).collect()}
    assert got == {(1, "x"): [1.0, 0.0], (1, "y"): [2.0, 5.0], (1, "z"): [0.0, 7.0]}
    with pytest.raises(ValueError, match="empty"):
        assemble_vectors([])


def test_top_n_ties_and_totals(spark):
    df = spark.createDataFrame(
        [(1, "b", 5), (1, "a", 5), (1, "c", 9), (1, "d", None), (2, "a", 1)], "w_idx long, tag string, v long"
    )
    got = [tuple(r) for r in top_n(df, "v", 2).orderBy("w_idx", "rank").collect()]
    assert got == [(1, 1, "c", 9, 3), (1, 2, "a", 5, 3), (2, 1, "a", 1, 1)]


@pytest.fixture(scope="module")
def sf_tables(spark):
    return catalog.tables(spark, SF)


def test_invariants(sf_tables):
    ind = sf_tables.indicators
    bad = ind.where(
        (F.col("activeness") < 1)
        | (F.col("unique_users") > F.col("volume"))
        | (F.col("half_volume") > F.col("volume"))
        | (F.col("first_degree") < F.col("volume"))
        | (F.col("activeness") > F.col("first_degree"))
    )
    assert bad.count() == 0
    sums = ind.groupBy("w_idx").agg(F.sum("percent_share").alias("s")).collect()
    assert sums and all(math.isclose(r.s, 1.0, rel_tol=1e-9) for r in sums)
    tot = ind.groupBy("w_idx").agg(F.sum("volume").alias("v"), F.max("total_volume").alias("t"))
    assert tot.where(F.col("v") != F.col("t")).count() == 0


def test_vector_widths_constant(sf_tables):
    assert {r.n for r in sf_tables.feature_vectors.select(F.size("features").alias("n")).distinct().collect()} == {4}
    widths = sf_tables.recurrent_vectors.select(F.size("features").alias("n")).distinct().collect()
    assert {r.n for r in widths} == {HOURLY.vector_width}


def test_smoothed_keys_superset(sf_tables):
    ind_keys = sf_tables.indicators.select("w_idx", "tag")
    fv_keys = sf_tables.feature_vectors.select("w_idx", "tag")
    assert ind_keys.exceptAll(fv_keys).count() == 0


def test_posts_view_matches_fixture_rules(spark):
    posts = posts_from_events(spark.read.parquet(f"{SF}/events.parquet"))
    r = posts.where("post_id = 15").first()  # divisible by 3 and 5
    assert r.text.count("#") == 3 and r.text.startswith("#")
    assert posts.where("retweet_count IS NOT NULL AND NOT text LIKE '#view%'").count() == 0


def test_batch_job_tables_equal_lazy_plans(spark, tmp_path):
    from hashtrend.plans import job

    posts = posts_from_events(spark.read.parquet(f"{SF}/events.parquet"))
    paths = job.run(spark, posts, str(tmp_path / "out"), HOURLY, reports={"volume": 3, "first_degree_smoothed": 3})
    lazy = catalog.tables(spark, SF)
    for name, df in (("feature_vectors", lazy.feature_vectors), ("recurrent_vectors", lazy.recurrent_vectors)):
        written = spark.read.parquet(paths[name]).select("w_idx", "tag", "features")
        want = df.select("w_idx", "tag", "features")
        assert written.exceptAll(want).count() == 0 and want.exceptAll(written).count() == 0
    assert spark.read.parquet(paths["indicators"]).count() == lazy.indicators.count()
    for metric, df in (("volume", lazy.indicators), ("first_degree_smoothed", lazy.smoothed)):
        got = spark.read.parquet(paths[f"top_{metric}"]).select("w_idx", "rank", "tag", "value", "n_total")
        want = top_n(df, metric, 3).select("w_idx", "rank", "tag", "value", "n_total")
        assert got.count() > 0 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # a bucket is few files, however many tasks computed it
    import os

    for bucket in os.listdir(paths["indicators"]):
        if bucket.startswith("bucket="):
            files = [f for f in os.listdir(f"{paths['indicators']}/{bucket}") if f.endswith(".parquet")]
            assert len(files) <= job.BUCKET_PARTS


def test_materialized_tables_equal_lazy(spark):
    from hashtrend.plans.tables import IndicatorTables

    posts = posts_from_events(spark.read.parquet(f"{SF}/events.parquet"))
    lazy = IndicatorTables(posts, HOURLY)
    cut = IndicatorTables(posts, HOURLY, materialize=True)
    assert spark.sparkContext.getCheckpointDir()
    for name in ("indicators", "recurrent_vectors"):
        a, b = getattr(lazy, name), getattr(cut, name)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_big_posts_are_split_without_changing_pairs(spark):
    import datetime as dt

    from fixture_posts import POST_SCHEMA

    from hashtrend.operators import co_tags, slot_pairs, tagged_posts

    e = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    giant = " ".join(f"#t{i}" for i in range(300)) + " #t1 #t2"
    rows = [
        (1, e, "a", giant, 1, 1, None),
        (2, e + dt.timedelta(hours=3), "b", "#t1 #x", 1, 1, None),
        (3, e + dt.timedelta(hours=30), "c", "#x #y", 1, 1, None),
    ]
    tagged = tagged_posts(spark.createDataFrame(rows, POST_SCHEMA), HOURLY)
    split = slot_pairs(tagged, big_post_tags=64)
    whole = slot_pairs(tagged, big_post_tags=10_000)
    assert split.count() == 300 * 300 + 4 + 4
    assert split.exceptAll(whole).count() == 0 and whole.exceptAll(split).count() == 0
    act = dict(
        co_tags(tagged, HOURLY).groupBy("w_idx", "tag").count().where("tag = '#t1'").select("w_idx", "count").collect()
    )
    first = min(act)
    assert act[first] == 300  # the giant post alone
    assert act[first + 3] == 301  # plus #x from the second post


@pytest.mark.parametrize("span", [1, 2, 20, 256, 900])
def test_affine_halving_equals_collected_fold(spark, span):
    """Across chunk borders, for tags with gaps, a single row, tiny and equal shares."""
    import random

    from hashtrend.operators import reference_share

    rnd = random.Random(3)
    win = Windows(batch="1 hour", reference=span)
    rows = [(t, tag, rnd.random()) for tag in ("a", "b", "c") for t in range(0, 3000) if rnd.random() < 0.6]
    rows += [(t, "falling", 0.9 if t < 500 else 1e-9 * rnd.random()) for t in range(0, 3000, 3)]
    rows += [(t, "always", 0.125) for t in range(3000)] + [(t, "tiny", 1e-12 * rnd.random()) for t in range(0, 3000, 7)] + [(5, "once", 0.3)]
    share = spark.createDataFrame(rows, "w_idx long, tag string, percent_share double")
    fast = {(r.w_idx, r.tag): r for r in reference_share(share, win).collect()}
    slow = {(r.w_idx, r.tag): r for r in reference_share(share, win, halving="fold").collect()}
    assert fast.keys() == slow.keys() and len(fast) == len(rows)
    for k, a in fast.items():
        b = slow[k]
        assert math.isclose(a.reference_share_mean, b.reference_share_mean, rel_tol=1e-12)
        assert math.isclose(a.reference_share_halving, b.reference_share_halving, rel_tol=1e-12, abs_tol=1e-24)
    assert all(fast[t, "always"].reference_share_halving == 0.125 for t in range(3000))


def test_affine_halving_collects_nothing(spark):
    from hashtrend.operators import reference_share

    share = spark.createDataFrame([(1, "a", 0.5)], "w_idx long, tag string, percent_share double")
    assert "collect_list" not in reference_share(share, HOURLY)._jdf.queryExecution().executedPlan().toString()


def test_empty_and_tagless_input(spark):
    import datetime as dt

    from fixture_posts import POST_SCHEMA

    from hashtrend.plans.tables import IndicatorTables

    e = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    for rows in ([], [(1, e, "a", "no tags here", 1, 1, None), (2, e, None, None, None, None, None)]):
        t = IndicatorTables(spark.createDataFrame(rows, POST_SCHEMA), HOURLY)
        for name in ("indicators", "co_tags", "smoothed", "feature_vectors", "recurrent_vectors"):
            assert getattr(t, name).count() == 0, name


def test_validation_errors(spark):
    from hashtrend.operators import reference_share

    bad = spark.createDataFrame([(1, "x", 1.0, 2.0)], "w_idx long, tag string, a double, b double")
    with pytest.raises(ValueError, match="exactly one value column"):
        assemble_vectors([bad])
    w = Windows.from_durations("2 seconds", "32 seconds", "512 seconds", "2 minutes", "10 seconds", half="8 seconds")
    assert (w.analytic, w.half) == (16, 4)
    with pytest.raises(ValueError, match="halving"):
        reference_share(bad.select("w_idx", "tag", F.col("a").alias("percent_share")), HOURLY, halving="pairwise")


def test_ml_vectors_fit_an_estimator(spark):
    from pyspark.ml.clustering import KMeans

    from hashtrend.operators.vectors import ml_vectors

    rows = spark.createDataFrame([(1, [0.0, 0.1]), (2, [0.1, 0.0]), (3, [9.0, 9.1])], "w_idx long, features array<double>")
    model = KMeans(k=2, seed=1).fit(ml_vectors(rows))
    labels = {r.w_idx: r.prediction for r in model.transform(ml_vectors(rows)).collect()}
    assert labels[1] == labels[2] != labels[3]


def test_end_timestamp_is_free_of_the_session_zone(spark):
    import datetime as dt

    from hashtrend.functions.time import end_timestamp

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            row = spark.range(474_000, 474_001).select(end_timestamp("id", HOURLY.batch_us).alias("e")).first()
            assert row.e == dt.datetime(1970, 1, 1) + dt.timedelta(hours=474_000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def _skewed_posts(spark, hours=60):
    """One tag in every second post, with a neighbour of its own each time, and a bot that posts it in every slide."""
    import datetime as dt

    from fixture_posts import POST_SCHEMA

    e = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = []
    for h in range(hours):
        at = e + dt.timedelta(hours=h)
        rows.append((len(rows), at, "bot", "#hot", 1, 1, None))
        for k in range(40):
            text = f"#hot #n{k}_{h % 7}" if k % 2 else f"#a{k} #b{k}"
            rows.append((len(rows), at, f"u{k}", text, k, 1, None))
    return spark.createDataFrame(rows, POST_SCHEMA)


def test_first_cover_in_chunks_equals_one_partition_a_key(spark):
    from hashtrend.operators import post_panes
    from hashtrend.operators.panes import author_rows
    from hashtrend.operators.windowing import with_first_cover

    panes = author_rows(post_panes(_skewed_posts(spark), HOURLY))
    parts = with_first_cover(panes, ["tag", "screen_name"], "slot", 16, "first_i", chunk=16)
    whole = with_first_cover(panes, ["tag", "screen_name"], "slot", 16, "first_i", chunk=1 << 40)
    assert parts.count() == panes.count()
    assert parts.exceptAll(whole).count() == 0 and whole.exceptAll(parts).count() == 0


def test_hot_neighbour_is_several_join_keys(spark):
    from hashtrend.operators import first_degree, hot_neighbours, neighbour_join
    from hashtrend.plans.tables import IndicatorTables

    t = IndicatorTables(_skewed_posts(spark), HOURLY)
    vol = t.base.select("w_idx", F.col("tag").alias("neighbour"), F.col("volume").alias("nb_volume"))
    plain = t.co_tags.join(vol, ["w_idx", "neighbour"])
    for part_pairs, most in ((10, 50_000), (10, 3), (100_000, 50_000)):
        got = neighbour_join(t.co_tags, vol, part_pairs, most).select(*plain.columns)
        assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0
    whole = plain.groupBy("w_idx", "tag").agg(F.count(F.lit(1)).alias("activeness"), F.sum("nb_volume").alias("first_degree"))
    got = first_degree(t.co_tags, t.base)
    assert got.exceptAll(whole).count() == 0 and whole.exceptAll(got).count() == 0

    # as many parts as the pairs ask for, none for the rest, and a bounded table
    counts = {(r.w_idx, r.neighbour): r["count"] for r in t.co_tags.groupBy("w_idx", "neighbour").count().collect()}
    names = t.co_tags.select("neighbour", F.xxhash64("neighbour").alias("nb_key")).distinct()
    hot = {(r.w_idx, r.neighbour): r.parts for r in hot_neighbours(t.co_tags, 10).join(names, "nb_key").collect()}
    assert hot == {k: -(-n // 10) for k, n in counts.items() if n > 10} and 0 < len(hot) < len(counts)
    assert hot_neighbours(t.co_tags, 1, 3).count() <= 3
    # the largest key of the cut join holds a small share of what the hottest neighbour has
    parts = t.co_tags.withColumn("nb_key", F.xxhash64("neighbour")).join(hot_neighbours(t.co_tags, 10), ["w_idx", "nb_key"], "left")
    part = F.pmod(F.xxhash64("tag"), F.coalesce("parts", F.lit(1)).cast("long"))
    largest = parts.groupBy("w_idx", "neighbour", part).count().agg(F.max("count")).first()[0]
    assert 3 * largest < 2 * max(counts.values()) and largest <= 30
    plan = neighbour_join(t.co_tags, vol)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_part#") >= 2 and "SortMergeJoin [w_idx" in plan


def test_sketches_stay_within_their_error(spark):
    from hashtrend.operators import approx_distinct, sketch_error
    from hashtrend.plans.tables import IndicatorTables

    posts = posts_from_events(spark.read.parquet("/root/testdata/sf0.01/events.parquet"))
    t = IndicatorTables(posts, HOURLY)
    for exact, near, col in ((t.base, t.approx_unique_users, "unique_users"), (t.activeness, t.approx_activeness, "activeness")):
        both = exact.select("w_idx", "tag", col).join(near.withColumnRenamed(col, "near"), ["w_idx", "tag"], "full")
        rows = both.collect()
        assert rows and all(abs(r.near - r[col]) <= max(1, 4 * sketch_error() * r[col]) for r in rows)
    # large sets, and items that several panes share
    wide = spark.range(200_000).select(
        (F.col("id") % 8).alias("slot"), F.lit("a").alias("tag"), F.pmod(F.xxhash64("id"), F.lit(50_000)).cast("string").alias("item")
    )
    for lg_k in (8, 12, 16):
        r = approx_distinct(wide, "item", HOURLY, "n", lg_k).where("w_idx = 8").first()
        exact = wide.select("item").distinct().count()
        assert abs(r.n - exact) <= 4 * sketch_error(lg_k) * exact
    nulls = spark.createDataFrame([(1, "a", None)], "slot long, tag string, item string")
    assert {r.n for r in approx_distinct(nulls, "item", HOURLY, "n").collect()} == {0}


def test_stored_panes_are_the_only_source(spark, tmp_path):
    from hashtrend.operators import post_panes
    from hashtrend.plans.tables import IndicatorTables

    posts = posts_from_events(spark.read.parquet(f"{SF}/events.parquet"))
    panes = post_panes(posts, HOURLY)
    assert panes._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    path = str(tmp_path / "panes")
    panes.write.parquet(path)
    stored = IndicatorTables.from_panes(spark.read.parquet(path), HOURLY)
    lazy = IndicatorTables(posts, HOURLY)
    for name in ("indicators", "assembled_vectors"):
        a, b = getattr(lazy, name), getattr(stored, name)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    a, b = lazy.assembled_vectors, lazy.feature_vectors.select("w_idx", "tag", "features")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_top_n_all_equals_single_reports(spark):
    from hashtrend.operators import top_n, top_n_all

    rows = [(w, f"#t{k}", (k * 7 + w) % 5, None if k % 3 else k / 8) for w in range(3) for k in range(12)]
    df = spark.createDataFrame(rows, "w_idx long, tag string, a long, b double")
    got = {tuple(r) for r in top_n_all(df, ["a", "b"], 3).collect()}
    want = {(r.w_idx, m, r.rank, r.tag, float(r.value), r.n_total) for m in ("a", "b") for r in top_n(df, m, 3).collect()}
    assert got == want and len(got) == 18
