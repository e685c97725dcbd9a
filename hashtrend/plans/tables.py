"""The engine's derived tables, composed lazily from one posts frame.

``occurrences -> indicators -> feature_vectors -> recurrent_vectors``.  Each
property is a Catalyst plan; nothing is collected.  Shuffle layout of the
wide table: author panes (by slot, tag, author) -> first-cover lag (by tag,
author) -> base aggregate (by window, tag); pair panes likewise; one join of
the pairs with the base table on ``(window, neighbour)`` and one aggregate per
``(window, tag)`` give every per-tag column; the per-slide totals (one row per
slide, from slot counts) join on the window; the reference frame is the last
re-shuffle (by tag and time chunk).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashtrend.config import Windows
from hashtrend.functions.time import end_timestamp
from hashtrend.operators import (
    activeness,
    approx_distinct,
    assemble_recurrent,
    assemble_vectors,
    author_rows,
    base_from_panes,
    base_indicators,
    co_tags,
    co_tags_from_pairs,
    delta_share,
    feature_vectors,
    first_degree,
    hop,
    neighbour_rows,
    occurrences,
    percent_share,
    post_panes,
    recurrent_groups,
    reference_share,
    slot_pairs,
    slot_totals,
    smoothed_first_degree,
    tagged_posts,
    with_first_degree,
    with_smoothed,
    with_velocity,
)
from hashtrend.session import cut_lineage

INDICATOR_COLUMNS = [
    "volume",
    "half_volume",
    "velocity",
    "unique_users",
    "follower_reach",
    "friend_reach",
    "retweeted_volume",
    "activeness",
    "first_degree",
    "total_volume",
    "percent_share",
    "reference_share_mean",
    "reference_share_halving",
    "delta_share",
    "delta_share_halving",
]

# The indicators that are ranked per slide (O1, O2).
RANKED_METRICS = [
    "volume",
    "velocity",
    "unique_users",
    "follower_reach",
    "friend_reach",
    "retweeted_volume",
    "activeness",
    "first_degree_smoothed",
    "percent_share",
    "delta_share",
]


class IndicatorTables:
    """Lazy derived tables.  With ``materialize=True`` the wide table and the
    feature vectors are reliably checkpointed (``spark.checkpoint.dir``) on
    first use: every table built from them then starts from stored data, both
    for reuse and for recovery after executor loss.  Off by default, as each
    checkpoint runs a job when the property is first read.

    With ``panes`` (stored :func:`post_panes` rows; see :meth:`from_panes`), or
    with ``materialize=True``, which checkpoints them, every table derives from
    the panes and the posts are scanned once.  Otherwise each branch of a plan
    scans the posts."""

    def __init__(self, posts: DataFrame | None, win: Windows, materialize: bool = False, panes: DataFrame | None = None):
        self.win = win
        self.posts = posts
        self.materialize = materialize
        self._stored_panes = panes

    @classmethod
    def from_panes(cls, panes: DataFrame, win: Windows, materialize: bool = False) -> IndicatorTables:
        return cls(None, win, materialize, panes)

    def _stage(self, df: DataFrame) -> DataFrame:
        return cut_lineage(df) if self.materialize else df

    @cached_property
    def panes(self) -> DataFrame | None:
        """Stored panes, or None where the tables derive from the posts."""
        if self._stored_panes is None and self.materialize:
            return cut_lineage(post_panes(self.posts, self.win))
        return self._stored_panes

    @cached_property
    def tagged(self) -> DataFrame:
        return tagged_posts(self.posts, self.win)

    @cached_property
    def occurrences(self) -> DataFrame:
        return occurrences(self.tagged)

    @cached_property
    def base(self) -> DataFrame:
        if self.panes is not None:
            return with_velocity(base_from_panes(author_rows(self.panes), self.win))
        return with_velocity(base_indicators(self.occurrences, self.win))

    @cached_property
    def velocity_with_cooling(self) -> DataFrame:
        """A3 with the tags whose recent half is empty kept."""
        return with_velocity(self.base.drop("velocity"), keep_cooling=True)

    @cached_property
    def co_tags(self) -> DataFrame:
        if self.panes is not None:
            return co_tags_from_pairs(neighbour_rows(self.panes), self.win)
        return co_tags(self.tagged, self.win)

    @cached_property
    def activeness(self) -> DataFrame:
        return activeness(self.co_tags)

    @cached_property
    def approx_unique_users(self) -> DataFrame:
        """A4 from mergeable sketches."""
        if self.panes is not None:
            return approx_distinct(author_rows(self.panes), "screen_name", self.win, "unique_users")
        return approx_distinct(self.occurrences, "screen_name", self.win, "unique_users")

    @cached_property
    def approx_activeness(self) -> DataFrame:
        """A8 from mergeable sketches."""
        pairs = slot_pairs(self.tagged) if self.panes is None else neighbour_rows(self.panes)
        return approx_distinct(pairs, "neighbour", self.win, "activeness")

    @cached_property
    def first_degree(self) -> DataFrame:
        return first_degree(self.co_tags, self.base)

    @cached_property
    def wide(self) -> DataFrame:
        """Base metrics + activeness + first-degree, one row per ``(w_idx, tag)``."""
        return self._stage(with_first_degree(self.co_tags, self.base))

    @cached_property
    def smoothed(self) -> DataFrame:
        return smoothed_first_degree(self.first_degree, self.win)

    @cached_property
    def total_volume(self) -> DataFrame:
        if self.panes is not None:
            return slot_totals(author_rows(self.panes), self.win, weight="n")
        return slot_totals(self.occurrences, self.win)

    @cached_property
    def share(self) -> DataFrame:
        return percent_share(self.base, self.total_volume)

    @cached_property
    def reference(self) -> DataFrame:
        return delta_share(reference_share(self.share, self.win))

    @cached_property
    def indicators(self) -> DataFrame:
        """Wide table, one row per ``(w_idx, tag)`` with any occurrence."""
        share = percent_share(self.wide, self.total_volume)
        return delta_share(reference_share(share, self.win)).select("w_idx", "tag", *INDICATOR_COLUMNS)

    @cached_property
    def ranked_metrics(self) -> DataFrame:
        """Every ranked indicator (O1, O2) in one table: the wide table's and the smoothed first-degree."""
        return with_smoothed(self.indicators, self.win, [m for m in RANKED_METRICS if m != "first_degree_smoothed"])

    @cached_property
    def feature_vectors(self) -> DataFrame:
        return self._stage(feature_vectors(self.wide, self.win))

    @cached_property
    def assembled_vectors(self) -> DataFrame:
        """V1 by the general assembly (J6): the same vectors from four keyed metric frames."""
        metrics = [
            self.base.select("w_idx", "tag", "volume"),
            self.base.select("w_idx", "tag", "unique_users"),
            self.first_degree.select("w_idx", "tag", "activeness"),
            self.smoothed,
        ]
        return assemble_vectors(metrics)

    @cached_property
    def vector_slides(self) -> DataFrame:
        """Slides that have feature vectors, one row each, from post slots alone.

        A smoothed key at ``s`` needs an indicator row in ``[s - analytic + 1,
        s]``, which needs an occurrence in the ``analytic`` slots before it:
        ``s`` has vectors iff some tagged post lies in ``[s - 2 * analytic + 1,
        s - 1]``.  Cheaper than deriving it from the vectors (one aggregate
        over slots instead of a second pass over the vector groups).
        """
        span = 2 * self.win.analytic - 1
        tagged = self.occurrences if self.panes is None else author_rows(self.panes)
        slots = tagged.select("slot").distinct()
        return hop(slots, "slot", span).select("w_idx").distinct()

    @cached_property
    def recurrent_groups(self) -> DataFrame:
        return recurrent_groups(self.feature_vectors, self.win, live=self.vector_slides)

    @cached_property
    def recurrent_vectors(self) -> DataFrame:
        return assemble_recurrent(self.recurrent_groups, self.win).select("w_idx", "tag", "features")

    def with_end(self, df: DataFrame, idx: str = "w_idx") -> DataFrame:
        """Replace the slide index by the window end timestamp (first column)."""
        rest = [c for c in df.columns if c != idx]
        return df.select(end_timestamp(idx, self.win.batch_us).alias("w_end"), *rest)


def vector_text(features: str = "features") -> F.Column:
    """Integral feature vector as space-separated integers (engine-neutral form)."""
    return F.array_join(F.transform(F.col(features), lambda x: x.cast("long").cast("string")), " ")
