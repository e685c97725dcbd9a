"""Percent share family (A11-A14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashtrend.config import Windows
from hashtrend.functions.vectors import halving_fold
from hashtrend.operators.windowing import bounded_range_frame, chunk_copies, hop

# Reference slides at most for the affine form, and the shift of its exponents: 2**(row - shift) and its inverse stay
# normal doubles for every row of a block.
MAX_AFFINE_SPAN = 1800
EXPONENT_SHIFT = 900

# Parts that the tags of one slide are cut into for the join with its total.
TOTAL_SALTS = 16


def total_volume(base: DataFrame) -> DataFrame:
    """A11: one row per window.  A grouped aggregate (partial sums before the
    shuffle), not a window over all tags of a slide."""
    return base.groupBy("w_idx").agg(F.sum("volume").alias("total_volume"))


def slot_totals(occ: DataFrame, win: Windows, weight: str | None = None) -> DataFrame:
    """A11 straight from occurrences: per-slot counts (one row per slide)
    copied to the windows holding them.  Equal to summing the tag volumes,
    but independent of the per-tag aggregate, so using it never recomputes
    that aggregate.  ``weight`` sums a count column instead (pane rows)."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    per_slot = occ.groupBy("slot").agg(n.alias("n"))
    return hop(per_slot, "slot", win.analytic).groupBy("w_idx").agg(F.sum("n").alias("total_volume"))


def percent_share(base: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """A12: ``volume / total`` as a fraction.  The per-window totals are one
    row per slide; AQE broadcasts them once measured small.  Beyond that, each
    total is copied to ``TOTAL_SALTS`` parts, so the tags of one slide are that
    many keys, not one."""
    totals = total_volume(base) if totals is None else totals
    cut = base.withColumn("_salt", F.pmod(F.hash("tag"), F.lit(TOTAL_SALTS)))
    copies = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(TOTAL_SALTS - 1))))
    joined = cut.join(copies, ["w_idx", "_salt"]).drop("_salt")
    return joined.withColumn("percent_share", F.col("volume").cast("double") / F.col("total_volume"))


def reference_share(
    share: DataFrame, win: Windows, *, chunk: int | None = None, halving: str = "affine"
) -> DataFrame:
    """A13: the tag's shares over the slides ending in ``(t - reference, t]``.

    ``reference_share_mean`` is their average (deterministic stand-in for the
    reference's order-dependent pairwise halving); ``reference_share_halving``
    folds ``(acc + x) / 2`` oldest to newest over the same present slides.

    ``halving="affine"`` (default) collects nothing.  A halving step is the map
    ``acc -> acc / 2 + x / 2``, and such maps compose associatively, so a
    sliding frame can be put together from blocks of ``reference`` slides: the
    suffix of the block before (composed from its end backwards) and the prefix
    of the row's own block, applied to the frame's first share (a value halved
    with itself stays).  Prefixes and suffixes are running sums with powers of
    two as weights, which scale without rounding; every row costs the same
    whatever the span, and only its block and a copy of the one before meet in
    a partition.  The mean is put together likewise.  No sum is subtracted from
    another, so shares that fall by orders of magnitude keep their digits; the
    result agrees with the step-by-step fold to about 1e-14 relative, not bit
    for bit.

    ``halving="fold"`` collects the ordered frame and folds it: exactly the
    sequential definition, bit for bit, for up to ``reference`` values a row.
    It also serves references of more than ``MAX_AFFINE_SPAN`` slides and a
    given ``chunk``.
    """
    if halving not in ("fold", "affine"):
        raise ValueError(f"unknown halving mode {halving!r}")
    span = win.reference
    if halving == "fold" or chunk is not None or span > MAX_AFFINE_SPAN:
        return _reference_share_collected(share, win, chunk=chunk)

    x, two, zero = F.col("percent_share"), F.lit(2.0), F.lit(0.0)
    staged = chunk_copies(share, "w_idx", span, span)
    staged = staged.select("*", (F.col("_chunk") == F.col("_home")).alias("_own"))
    block = Window.partitionBy("tag", "_chunk")
    forward, backward = block.orderBy("w_idx"), block.orderBy(F.desc("w_idx"))
    running = lambda c, w: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own, old = F.col("_own"), ~F.col("_own")
    placed = staged.select(
        "*",
        running(F.when(own, 1).otherwise(0), forward).alias("_r"),  # rows of the own block so far
        running(F.when(old, 1).otherwise(0), backward).alias("_e"),  # rows of the block before, from its end
    )
    power = lambda n: F.pow(two, n.cast("double"))
    weighted = placed.select(
        "*",
        F.when(own, x * power(F.col("_r") - EXPONENT_SHIFT)).otherwise(zero).alias("_w"),
        F.when(old, x * power(-F.col("_e"))).otherwise(zero).alias("_v"),
    )
    composed = weighted.select(
        "*",
        running("_w", forward).alias("_prefix"),
        running(F.when(own, x).otherwise(zero), forward).alias("_prefix_sum"),
        running("_v", backward).alias("_suffix"),
        running(F.when(old, x).otherwise(zero), backward).alias("_suffix_sum"),
    )
    # the frame's first row: the one behind the last row before the frame, else the first of all
    start = F.struct(x.alias("x"), F.when(old, F.col("_e")).otherwise(0).alias("n"), F.col("_suffix").alias("b"), F.col("_suffix_sum").alias("s"))
    before = forward.rangeBetween(Window.unboundedPreceding, -span)
    found = composed.select("*", start.alias("_this"), F.lead(start).over(forward).alias("_next"))
    found = found.select("*", F.coalesce(F.last("_next").over(before), F.first("_this").over(forward)).alias("_start"))
    first = F.col("_start")
    older = first["x"] * power(-first["n"]) + first["b"]
    folded = older * power(-F.col("_r")) + F.col("_prefix") * power(F.lit(EXPONENT_SHIFT - 1) - F.col("_r"))
    mean = (first["s"] + F.col("_prefix_sum")) / (first["n"] + F.col("_r"))
    return found.where("_own").select(*share.columns, mean.alias("reference_share_mean"), folded.alias("reference_share_halving"))


def _reference_share_collected(share: DataFrame, win: Windows, *, chunk: int | None = None) -> DataFrame:
    """A13 by collecting the frame and folding it (any span)."""

    def cols(w):
        return {
            "reference_share_mean": F.avg("percent_share").over(w),
            "reference_share_halving": halving_fold(F.collect_list("percent_share").over(w)),
        }

    return bounded_range_frame(share, ["tag"], "w_idx", win.reference, cols, chunk=chunk)


def delta_share(ref: DataFrame) -> DataFrame:
    """A14: share minus its reference (the current slide is inside the
    reference window, so every share row has one)."""
    return ref.withColumn("delta_share", F.col("percent_share") - F.col("reference_share_mean")).withColumn(
        "delta_share_halving", F.col("percent_share") - F.col("reference_share_halving")
    )
