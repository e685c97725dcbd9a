"""The engine against a literal pure-Python model on random posts, with a
window geometry unlike the oracle's (odd lengths, recurrent slide that does
not divide the recurrent window)."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from fixture_posts import POST_SCHEMA

from hashtrend.config import Windows
from hashtrend.plans.tables import IndicatorTables

WIN = Windows(batch="3 seconds", analytic=5, half=2, reference=7, rec_window=8, rec_slide=3)
B = 3
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
WORDS = ["#a", "#b", "#c", "#a,", "#", "#A", "x", "", "#d\t#e", "rt"]


def random_posts(seed: int, n: int = 60):
    rnd = random.Random(seed)
    posts = []
    for i in range(n):
        ts = rnd.uniform(0, 150)
        text = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 5)))
        rt = rnd.randint(0, 9) if rnd.random() < 0.3 else None
        posts.append((i, ts, f"u{rnd.randint(0, 5)}", text, rnd.randint(0, 50), rnd.randint(0, 50), rt))
    return posts


def tags_of(text: str) -> list[str]:
    return [t for t in text.split(" ") if t.startswith("#")]


def model(posts):
    """Literal semantics: window ``e`` holds slots ``e - A … e - 1``."""
    A, H, R = WIN.analytic, WIN.half, WIN.reference
    by_slot = defaultdict(list)
    for p in posts:
        by_slot[math.floor(p[1] / B)].append(p)
    slots = sorted(by_slot)
    ind = {}
    for e in range(slots[0] + 1, slots[-1] + A + 1):
        win_posts = [(s, p) for s in range(e - A, e) for p in by_slot.get(s, [])]
        m = defaultdict(lambda: {"volume": 0, "half": 0, "users": set(), "fol": 0, "fri": 0, "rt": None, "nb": set()})
        for s, (_, _, user, text, fol, fri, rt) in win_posts:
            tags = tags_of(text)
            for t in tags:
                r = m[t]
                r["volume"] += 1
                r["half"] += s >= e - H
                r["users"].add(user)
                r["fol"] += fol
                r["fri"] += fri
                if rt is not None:
                    r["rt"] = (r["rt"] or 0) + rt
                r["nb"].update(tags)
        total = sum(r["volume"] for r in m.values())
        for t, r in m.items():
            ind[(e, t)] = {
                "volume": r["volume"],
                "half_volume": r["half"],
                "velocity": 2 * r["half"] - r["volume"] if r["half"] > 0 else None,
                "unique_users": len(r["users"]),
                "follower_reach": r["fol"],
                "friend_reach": r["fri"],
                "retweeted_volume": r["rt"],
                "activeness": len(r["nb"]),
                "first_degree": sum(m[y]["volume"] for y in r["nb"]),
                "total_volume": total,
                "percent_share": r["volume"] / total,
            }
    for (e, t), r in ind.items():
        hist = [ind[(e2, t)]["percent_share"] for e2 in range(e - R + 1, e + 1) if (e2, t) in ind]
        r["reference_share_mean"] = sum(hist) / len(hist)
        acc = hist[0]
        for x in hist[1:]:
            acc = (acc + x) / 2
        r["reference_share_halving"] = acc
    fv = {}
    ends = {e for e, _ in ind}
    for s in range(min(ends), max(ends) + A):
        for t in {t for (e, t) in ind if s - A < e <= s}:
            now = ind.get((s, t), {})
            sfd = sum(ind[(e, t)]["first_degree"] for e in range(s - A + 1, s + 1) if (e, t) in ind)
            fv[(s, t)] = [float(now.get("volume", 0)), float(now.get("unique_users", 0)), float(now.get("activeness", 0)), float(sfd)]
    rv = {}
    fv_ends = {s for s, _ in fv}
    for r_end in range(min(fv_ends), max(fv_ends) + WIN.rec_window):
        if r_end % WIN.rec_slide or r_end not in fv_ends:
            continue
        span = range(r_end - WIN.rec_window + 1, r_end + 1)
        for t in {t for (s, t) in fv if s in span}:
            rv[(r_end, t)] = [x for s in span for x in fv.get((s, t), [0.0] * 4)]
    return ind, fv, rv


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_engine_equals_model(spark, seed):
    posts = random_posts(seed)
    rows = [(i, EPOCH + dt.timedelta(seconds=ts), u, text, fol, fri, rt) for i, ts, u, text, fol, fri, rt in posts]
    t = IndicatorTables(spark.createDataFrame(rows, POST_SCHEMA), WIN)
    want_ind, want_fv, want_rv = model(posts)

    got_ind = {(r.w_idx, r.tag): r.asDict() for r in t.indicators.collect()}
    assert set(got_ind) == set(want_ind)
    for k, want in want_ind.items():
        got = got_ind[k]
        for c, v in want.items():
            if isinstance(v, float):
                assert math.isclose(got[c], v, rel_tol=1e-12, abs_tol=1e-12), (k, c, got[c], v)
            else:
                assert got[c] == v, (k, c, got[c], v)
        assert math.isclose(got["delta_share"], want["percent_share"] - want["reference_share_mean"], abs_tol=1e-12)

    got_fv = {(r.w_idx, r.tag): r.features for r in t.feature_vectors.collect()}
    assert got_fv == want_fv
    got_rv = {(r.w_idx, r.tag): r.features for r in t.recurrent_vectors.collect()}
    assert got_rv == want_rv
