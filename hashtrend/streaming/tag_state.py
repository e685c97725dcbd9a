"""Shares against the long reference window, kept per tag in state with event-time timers.

The share family needs a slide's total over all tags and up to ``reference`` past shares of each tag (T5).  Both live in
state here, so a micro-batch reads nothing it wrote:

- Posts are folded to one row per (slide, tag) by a streaming aggregate with map-side partial sums, so a hot tag is one
  row a slide; a second aggregate gives the slide's total, one copy for each of ``buckets`` tag buckets.
- ``transformWithState`` is keyed by tag bucket.  A map from tag to its panes holds the tags that occur in the open
  analytic window, a second one each tag's last shares; a tag whose last share has left the reference window is
  forgotten on that slide (``leaving``).
- A bucket is visited when it has new panes, and by a timer at the next slide's end while any of its tags is live (else
  when a tag's shares leave), so windows without new posts close as well.  Everything up to the watermark is final: the rows of those slides are
  computed in time order and emitted.

A bucket is one task at a time and its live tags are read one by one, so choose ``buckets`` by the number of live tags
(some hundreds a bucket).  It is part of the state: a query keeps it for life.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from hashtrend.config import Windows
from hashtrend.functions.tags import hashtags
from hashtrend.functions.time import slot_index
from hashtrend.session import use_rocksdb
from hashtrend.streaming.chained import interval
from hashtrend.streaming.posts import timed_posts

BUCKETS = 32
# A null sum on its way to pandas, which would make the whole column floats.
ABSENT = -(1 << 63)
_PANES = "slots array<bigint>, n array<bigint>, fol array<bigint>, fri array<bigint>, rt array<bigint>"
OUTPUT = (
    "w_idx long, tag string, volume long, half_volume long, velocity long, follower_reach long, friend_reach long,"
    " retweeted_volume long, total_volume long, percent_share double, reference_share_mean double,"
    " reference_share_halving double, delta_share double, delta_share_halving double"
)


def _sum(values) -> int | None:
    """Null where no pane has a value."""
    known = [v for v in values if v is not None]
    return sum(known) if known else None


def reference_of(shares: list[float]) -> tuple[float, float]:
    """(mean, halving fold) of shares in time order, added one by one as the batch engine's frame does."""
    total, halving = 0.0, None
    for x in shares:
        total += x
        halving = x if halving is None else (halving + x) / 2.0
    return total / len(shares), halving


class TagShares(StatefulProcessor):
    """All tags of a bucket; see the module."""

    def __init__(self, win: Windows):
        self.analytic, self.half, self.reference, self.batch_us = win.analytic, win.half, win.reference, win.batch_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frontier = handle.getValueState("frontier", "w_idx bigint")
        self.totals = handle.getValueState("totals", "slots array<bigint>, n array<bigint>")
        self.live = handle.getMapState("live", "tag string", _PANES)
        self.past = handle.getMapState("past", "tag string", "ends array<bigint>, shares array<double>")
        self.leaving = handle.getMapState("leaving", "w_idx bigint", "tags array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[int, list[tuple]] = {}
        totals: dict[int, int] = {}
        for frame in rows:
            for slot, tag, n, *reach in zip(*(frame[c].tolist() for c in ("slot", "tag", "n", "fol", "fri", "rt")), strict=True):
                if tag is None:
                    totals[slot] = n
                else:
                    fresh.setdefault(slot, []).append((tag, n, *(None if v == ABSENT else v for v in reach)))
        yield from self._advance(fresh, totals, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance({}, {}, timerValues)

    def _advance(self, fresh, new_totals, timer_values) -> Iterator[pd.DataFrame]:
        """The rows of all slides up to the watermark that are not out yet."""
        hi = timer_values.getCurrentWatermarkInMs() * 1000 // self.batch_us
        known = self.frontier.get()
        first = min(fresh, default=None)
        done = known[0] if known is not None else (first if first is not None else hi)
        stored = self.totals.get()
        totals = dict(zip(stored[0], stored[1], strict=True)) if stored is not None else {}
        totals.update(new_totals)
        # tag -> its panes in time order, each (slot, n, fol, fri, rt)
        live = {k[0]: [tuple(p) for p in zip(*v, strict=True)] for k, v in self.live.iterator()}
        before = set(live)
        past: dict[str, tuple[list[int], list[float]]] = {}
        touched: set[str] = set()
        out: list[tuple] = []
        w = done + 1
        while w <= hi:
            if not live and w - 1 not in fresh:
                # nothing is open: on to the next slide with a pane
                coming = [s + 1 for s in fresh if s >= w]
                if not coming:
                    break
                w = min(coming)
                continue
            for tag, *pane in fresh.pop(w - 1, ()):
                live.setdefault(tag, []).append((w - 1, *pane))
                touched.add(tag)
            total = sum(totals.get(s, 0) for s in range(w - self.analytic, w))
            for tag in sorted(live):
                panes = [p for p in live[tag] if p[0] >= w - self.analytic]
                if len(panes) != len(live[tag]):
                    touched.add(tag)
                if not panes:
                    del live[tag]
                    continue
                live[tag] = panes
                out.append((w, tag, *self._row(w, tag, panes, total, past)))
            w += 1
        self._store(live, before, touched, past, totals, done, hi)
        due = hi + 1 if live else min((k[0] for k in self.leaving.keys()), default=None)
        if due is not None:
            self.handle.registerTimer(-(-due * self.batch_us // 1000))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype(
                {"retweeted_volume": "Int64", "follower_reach": "Int64", "friend_reach": "Int64", "velocity": "Int64"}
            )

    def _row(self, w, tag, panes, total, past) -> tuple:
        volume = sum(p[1] for p in panes)
        half = sum(p[1] for p in panes if p[0] >= w - self.half)
        share = volume / total
        if tag not in past:
            held = self.past.getValue((tag,))
            past[tag] = (list(held[0]), list(held[1])) if held is not None else ([], [])
        ends, shares = past[tag]
        ends.append(w)
        shares.append(share)
        while ends[0] <= w - self.reference:
            del ends[0], shares[0]
        mean, halving = reference_of(shares)
        velocity = 2 * half - volume if half else None
        reach = (_sum(p[k] for p in panes) for k in (2, 3, 4))
        return (volume, half, velocity, *reach, total, share, mean, halving, share - mean, share - halving)

    def _store(self, live, before, touched, past, totals, done, hi) -> None:
        for tag in touched | (before - set(live)):
            if tag in live:
                slots, n, fol, fri, rt = (list(c) for c in zip(*live[tag], strict=True))
                self.live.updateValue((tag,), (slots, n, fol, fri, rt))
            elif tag in before:
                self.live.removeKey((tag,))
        for tag, (ends, shares) in past.items():
            self.past.updateValue((tag,), (ends, shares))
        for tag in (before | set(past)) - set(live):  # its last share leaves the reference window then
            held = past[tag] if tag in past else self.past.getValue((tag,))
            if held is not None:
                at = held[0][-1] + self.reference
                waiting = self.leaving.getValue((at,))
                self.leaving.updateValue((at,), ([*(waiting[0] if waiting else []), tag],))
        if hi > done:
            for (at,) in [k for k in self.leaving.keys() if k[0] <= hi]:
                for tag in self.leaving.getValue((at,))[0]:
                    held = self.past.getValue((tag,))
                    if held is not None and tag not in live and held[0][-1] + self.reference <= hi:
                        self.past.removeKey((tag,))
                self.leaving.removeKey((at,))
            self.frontier.update((max(hi, done),))
        open_ = {s: n for s, n in totals.items() if s >= hi - self.analytic}
        self.totals.update((list(open_), list(open_.values())))

    def close(self) -> None:
        pass


def share_stream(posts: DataFrame, win: Windows, buckets: int = BUCKETS) -> DataFrame:
    """Streaming rows of ``OUTPUT``: volume, velocity, reach and the share family, one row per slide and live tag;
    ``posts`` carry their watermark (:func:`~hashtrend.streaming.posts.timed_posts`)."""
    spread = posts.select(
        "ts",
        F.explode(hashtags("text")).alias("tag"),
        F.col("followers_count").cast("long").alias("fol"),
        F.col("friends_count").cast("long").alias("fri"),
        F.col("retweet_count").cast("long").alias("rt"),
    )
    pane = F.window("ts", interval(win.batch_us)).alias("pane")
    count = F.count(F.lit(1)).alias("n")
    absent = F.lit(ABSENT).cast("long")
    per_tag = spread.groupBy(pane, "tag").agg(
        count, *[F.coalesce(F.sum(c), absent).alias(c) for c in ("fol", "fri", "rt")]
    )
    total = spread.groupBy(pane).agg(count)
    rows = per_tag.withColumn("bucket", F.pmod(F.hash("tag"), F.lit(buckets))).unionByName(
        total.select(
            "pane",
            F.lit(None).cast("string").alias("tag"),
            "n",
            *[absent.alias(c) for c in ("fol", "fri", "rt")],
            F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"),
        )
    )
    slotted = rows.select(
        F.window_time("pane").alias("pane_ts"), slot_index(F.col("pane.start"), win.batch_us).alias("slot"), "tag", "n", "fol", "fri", "rt", "bucket"
    )
    return slotted.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=TagShares(win), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )


def start_share_stream(
    posts: DataFrame,
    out_dir: str,
    win: Windows,
    *,
    watermark: str = "0 seconds",
    distinct: bool = False,
    buckets: int = BUCKETS,
    checkpoint: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write :func:`share_stream` to ``<out_dir>/shares`` with Spark's Parquet sink; transformWithState needs RocksDB."""
    use_rocksdb(posts.sparkSession)
    out = out_dir.rstrip("/")
    writer = (
        share_stream(timed_posts(posts, watermark, distinct), win, buckets)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{out}/shares")
        .option("checkpointLocation", checkpoint or f"{out}/_checkpoint_shares")
    )
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
