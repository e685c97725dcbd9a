"""Every indicator on the 7-post fixture against the golden values."""

from __future__ import annotations

import math

import pytest
from fixture_posts import COMPLETE_AT, GOLDEN, GOLDEN_RECURRENT_10, posts_df

from hashtrend.config import REFERENCE
from hashtrend.plans.tables import IndicatorTables

BATCH_S = 2
COLS = [
    "volume",
    "half_volume",
    "velocity",
    "unique_users",
    "follower_reach",
    "friend_reach",
    "retweeted_volume",
    "activeness",
    "first_degree",
]


@pytest.fixture(scope="module")
def tables(spark):
    return IndicatorTables(posts_df(spark), REFERENCE)


@pytest.fixture(scope="module")
def indicators(tables):
    rows = tables.indicators.collect()
    return {(r.w_idx * BATCH_S, r.tag): r for r in rows}


@pytest.fixture(scope="module")
def smoothed(tables):
    return {(r.w_idx * BATCH_S, r.tag): r.first_degree_smoothed for r in tables.smoothed.collect()}


def test_indicator_values(indicators):
    for t, tag, *vals in GOLDEN:
        row = indicators.get((t, tag))
        if vals[0] is None:
            assert row is None, (t, tag)
            continue
        assert row is not None, (t, tag)
        for c, v in zip(COLS, vals[:9]):
            assert row[c] == v, (t, tag, c, row[c], v)
        share, ref_mean, ref_halving = vals[10:]
        assert math.isclose(row.percent_share, share, abs_tol=1e-6)
        assert math.isclose(row.reference_share_mean, ref_mean, abs_tol=1e-6)
        assert math.isclose(row.reference_share_halving, ref_halving, abs_tol=1e-6)
        assert math.isclose(row.delta_share, row.percent_share - row.reference_share_mean)


def test_complete_tag_sets(indicators, smoothed):
    for t in COMPLETE_AT:
        want = {tag for tt, tag, *v in GOLDEN if tt == t and v[0] is not None}
        assert {tag for (tt, tag) in indicators if tt == t} == want
        want_s = {tag for tt, tag, *v in GOLDEN if tt == t}
        assert {tag for (tt, tag) in smoothed if tt == t} == want_s


def test_smoothed_first_degree(smoothed):
    for t, tag, *vals in GOLDEN:
        assert smoothed[(t, tag)] == vals[9], (t, tag)


def test_smoothed_outlives_volume(indicators, smoothed):
    # A10 keeps a tag for analytic-1 slides after its last first-degree row.
    last_ind = max(t for (t, tag) in indicators if tag == "#spark")
    last_s = max(t for (t, tag) in smoothed if tag == "#spark")
    assert last_s - last_ind == (REFERENCE.analytic - 1) * BATCH_S


def test_recurrent_vectors_golden(tables):
    rows = {r.tag: r.features for r in tables.recurrent_vectors.where("w_idx = 5").collect()}
    assert set(rows) == set(GOLDEN_RECURRENT_10)
    for tag, tail in GOLDEN_RECURRENT_10.items():
        v = rows[tag]
        assert len(v) == REFERENCE.vector_width
        assert v[:-20] == [0.0] * (REFERENCE.vector_width - 20)
        assert v[-20:] == [float(x) for x in tail], tag


def test_recurrent_liveness(tables):
    # Posts stop at 40 s; every recurrent window ends on a slide that has keys.
    fv_ends = {r.w_idx for r in tables.feature_vectors.select("w_idx").distinct().collect()}
    rv_ends = {r.w_idx for r in tables.recurrent_vectors.select("w_idx").distinct().collect()}
    assert rv_ends
    assert rv_ends <= fv_ends
    assert all(e % REFERENCE.rec_slide == 0 for e in rv_ends)
    assert max(rv_ends) == max(e for e in fv_ends if e % REFERENCE.rec_slide == 0)


def test_feature_vectors_zero_fill(tables):
    rows = {(r.w_idx * BATCH_S, r.tag): r.features for r in tables.feature_vectors.collect()}
    assert rows[(34, "#ml")] == [0.0, 0.0, 0.0, 66.0]
    assert rows[(20, "#spark")] == [4.0, 3.0, 4.0, 49.0]
    assert {len(v) for v in rows.values()} == {4}
