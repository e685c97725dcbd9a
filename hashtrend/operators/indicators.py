"""Per-tag sliding-window indicators (A1-A10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashtrend.config import Windows
from hashtrend.operators.windowing import hop, with_first_cover

# Pairs of one (window, neighbour) beyond which the neighbour join cuts them into parts, and the most neighbours it
# treats so: with more, the parts grow (at 20 bytes each, the hot table that is broadcast stays below 1 MB).
PART_PAIRS = 100_000
MOST_HOT = 50_000

# Registers of a distinct-count sketch, as a power of two.
SKETCH_LG_K = 12


def sketch_error(lg_k: int = SKETCH_LG_K) -> float:
    """Relative standard error of merged sketches: 1.04 / sqrt(2 ** lg_k), 1.6 % at 12."""
    return 1.04 / 2 ** (lg_k / 2)


BASE_COLUMNS = [
    "volume",
    "half_volume",
    "unique_users",
    "follower_reach",
    "friend_reach",
    "retweeted_volume",
]


def author_panes(occ: DataFrame) -> DataFrame:
    """Occurrences folded per ``(slot, tag, author)``: ``n, fol, fri, rt``."""
    return occ.groupBy("slot", "tag", "screen_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("followers_count").alias("fol"),
        F.sum("friends_count").alias("fri"),
        F.sum("retweet_count").alias("rt"),
    )


def base_indicators(occ: DataFrame, win: Windows) -> DataFrame:
    """A1, A2, A4-A7 in one aggregate, keyed ``(w_idx, tag)``.

    Occurrences are first folded into panes per ``(slot, tag, author)``
    (map-side combine: a bot posting the same tag all the time becomes one row
    per slide), the panes are copied to the ``analytic`` windows that contain
    them, and one aggregate with map-side partial sums finishes every metric.
    Distinct authors use the first-cover rule: a pane counts its author only in
    windows where it is that author's earliest pane for the tag, so the count
    is a sum too.  ``retweeted_volume`` stays null when no occurrence came
    from a retweet (no row in the reference).
    """
    return base_from_panes(author_panes(occ), win)


def base_from_panes(panes: DataFrame, win: Windows) -> DataFrame:
    """Finish :func:`base_indicators` from :func:`author_panes` rows (the
    streaming path stores panes and calls this per micro-batch)."""
    panes = with_first_cover(panes, ["tag", "screen_name"], "slot", win.analytic, "first_i")
    offset = F.col("w_idx") - F.col("slot") - F.lit(1)
    recent = offset < F.lit(win.half)
    counted = F.col("screen_name").isNotNull() & (offset >= F.col("first_i"))
    return (
        hop(panes, "slot", win.analytic)
        .groupBy("w_idx", "tag")
        .agg(
            F.sum("n").alias("volume"),
            F.sum(F.when(recent, F.col("n")).otherwise(F.lit(0))).alias("half_volume"),
            F.sum(F.when(counted, F.lit(1)).otherwise(F.lit(0))).alias("unique_users"),
            F.sum("fol").alias("follower_reach"),
            F.sum("fri").alias("friend_reach"),
            F.sum("rt").alias("retweeted_volume"),
        )
    )


def with_velocity(base: DataFrame, keep_cooling: bool = False) -> DataFrame:
    """A3: ``2 * half - volume``; null where the recent half is empty (the
    reference's inner join drops those tags).  ``keep_cooling`` gives such tags
    their ``-volume`` instead."""
    v = F.lit(2) * F.col("half_volume") - F.col("volume")
    return base.withColumn("velocity", v if keep_cooling else F.when(F.col("half_volume") > 0, v))


def approx_distinct(rows: DataFrame, item: str, win: Windows, out: str, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """Distinct ``item`` values of each tag and analytic window from mergeable sketches (A4 of authors, A8 of co-tags),
    keyed ``(w_idx, tag)``.

    Occurrences fold into one sketch per ``(slot, tag)`` before the shuffle; only the sketches are copied to the windows
    that hold them and merged, so what crosses the network does not grow with the distinct items of a tag.  The relative
    standard error is ``sketch_error(lg_k)``; a null item is not counted, and a tag whose items are all null has 0.
    """
    sketches = rows.groupBy("slot", "tag").agg(F.hll_sketch_agg(item, F.lit(lg_k)).alias("sketch"))
    merged = hop(sketches, "slot", win.analytic).groupBy("w_idx", "tag").agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("w_idx", "tag", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).cast("long").alias(out))


def activeness(pairs: DataFrame) -> DataFrame:
    """A8: distinct co-occurring tags, itself included."""
    return pairs.groupBy("w_idx", "tag").agg(F.count(F.lit(1)).alias("activeness"))


def hot_neighbours(pairs: DataFrame, part_pairs: int = PART_PAIRS, most: int = MOST_HOT) -> DataFrame:
    """``(w_idx, nb_key, parts)`` of the neighbours that have more than ``part_pairs`` pairs in a window, counted
    exactly, and in how many parts they go.

    At most ``most`` neighbours can each hold more than a ``most``-th of all pairs, so that is the least size of a part:
    the table has at most ``most`` rows of fixed width (a neighbour goes by its hash; one that shares it gets parts too).
    """
    key = F.xxhash64("neighbour").alias("nb_key")
    counts = pairs.groupBy("w_idx", key).agg(F.count(F.lit(1)).alias("n"))
    part = F.greatest(F.lit(part_pairs), F.call_function("div", counts.agg(F.sum("n")).scalar(), F.lit(most)))
    return counts.where(F.col("n") > part).select("w_idx", "nb_key", F.ceil(F.col("n") / part).cast("int").alias("parts"))


def neighbour_join(pairs: DataFrame, rows: DataFrame, part_pairs: int = PART_PAIRS, most: int = MOST_HOT) -> DataFrame:
    """``pairs`` joined with ``rows`` (one per ``(w_idx, neighbour)``).

    The pairs of a hot neighbour (:func:`hot_neighbours`) are cut into its number of parts by the other tag, and its
    row is copied to each part, so a tag that co-occurs with all others is as many keys as its pairs ask for.  All
    other rows are joined as they are, without copies.
    """
    hot = F.broadcast(hot_neighbours(pairs, part_pairs, most))

    def with_parts(df: DataFrame) -> DataFrame:
        return df.withColumn("nb_key", F.xxhash64("neighbour")).join(hot, ["w_idx", "nb_key"], "left").drop("nb_key")

    part = F.coalesce(F.pmod(F.xxhash64("tag"), F.col("parts").cast("long")), F.lit(0).cast("long"))
    cut = with_parts(pairs).withColumn("_part", part).drop("parts")
    every = F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - F.lit(1).cast("long"))
    copies = with_parts(rows).withColumn("_part", F.explode(every)).drop("parts")
    return cut.join(copies, ["w_idx", "neighbour", "_part"]).drop("_part")


def first_degree(pairs: DataFrame, base: DataFrame) -> DataFrame:
    """A8 and A9 together: each distinct neighbour joined to its volume in the
    same window, then ``count`` and ``sum`` per tag.

    Every neighbour occurs in the window, so the inner join keeps every pair.
    The volume side is one row per ``(w_idx, tag)``; AQE turns the join into a
    broadcast when that side is measured small (see :func:`neighbour_join` for
    hot neighbours beyond that).
    """
    vol = base.select("w_idx", F.col("tag").alias("neighbour"), F.col("volume").alias("nb_volume"))
    return (
        neighbour_join(pairs, vol)
        .groupBy("w_idx", "tag")
        .agg(F.count(F.lit(1)).alias("activeness"), F.sum("nb_volume").alias("first_degree"))
    )


def with_first_degree(pairs: DataFrame, base: DataFrame) -> DataFrame:
    """The wide table: every column of ``base`` plus ``activeness`` and
    ``first_degree``, from a single join.

    Each tag is its own neighbour, so joining the pairs with the *whole* base
    table on ``(w_idx, neighbour)`` and aggregating per ``(w_idx, tag)`` yields
    A8 and A9, and the self pair carries the tag's own metrics.  The base
    aggregate is computed once; no second join with it is needed.
    """
    metrics = [c for c in base.columns if c not in ("w_idx", "tag")]
    me = F.col("neighbour") == F.col("tag")
    joined = neighbour_join(pairs, base.withColumnRenamed("tag", "neighbour"))
    return joined.groupBy("w_idx", "tag").agg(
        *[F.max(F.when(me, F.col(c))).alias(c) for c in metrics],
        F.count(F.lit(1)).alias("activeness"),
        F.sum("volume").alias("first_degree"),
    )


def with_smoothed(ind: DataFrame, win: Windows, carry: list[str]) -> DataFrame:
    """A10 with the current slide's ``carry`` columns beside it: the smoothed aggregate has every key of the others, so
    it picks their values up where the copy offset is 0 (null for a tag that only its past keeps)."""
    now = F.col("s_idx") == F.col("w_idx")
    return (
        hop(ind.select("w_idx", "tag", "first_degree", *carry), "w_idx", win.analytic, shift=0, out="s_idx")
        .groupBy(F.col("s_idx").alias("w_idx"), "tag")
        .agg(*[F.max(F.when(now, F.col(c))).alias(c) for c in carry], F.sum("first_degree").alias("first_degree_smoothed"))
    )


def smoothed_first_degree(fd: DataFrame, win: Windows) -> DataFrame:
    """A10: first-degree summed again over the latest ``analytic`` slides.

    A tag keeps a row for ``analytic - 1`` slides after its last A9 row.
    """
    return (
        hop(fd.select("w_idx", "tag", "first_degree"), "w_idx", win.analytic, shift=0, out="s_idx")
        .groupBy(F.col("s_idx").alias("w_idx"), "tag")
        .agg(F.sum("first_degree").alias("first_degree_smoothed"))
    )
