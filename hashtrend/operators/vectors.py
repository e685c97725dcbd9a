"""Feature vectors (V1) and recurrent vectors (V2) for Spark ML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashtrend.config import Windows
from hashtrend.functions.vectors import slot_vector, zero_filled
from hashtrend.operators.windowing import hop

# Fixed feature order of the reference's vector: volume, unique users,
# activeness, smoothed first-degree (velocity is left out).
FEATURES = ["volume", "unique_users", "activeness", "first_degree_smoothed"]


def assemble_vectors(metrics: list[DataFrame], key: tuple[str, ...] = ("w_idx", "tag")) -> DataFrame:
    """General V1: N keyed metric frames ``(*key, value)`` -> one row per key
    present in *any* of them, ``features[i]`` = metric i or 0.0.

    A full outer join chain is replaced by a union and one aggregate, so the
    cost is one shuffle whatever N is.
    """
    if not metrics:
        raise ValueError("assemble_vectors got an empty list; pass at least one metric frame")
    tagged = None
    for i, m in enumerate(metrics):
        value_col = [c for c in m.columns if c not in key]
        if len(value_col) != 1:
            raise ValueError(f"metric frame {i} must have exactly one value column besides {key}")
        part = m.select(*key, F.lit(i).alias("_m"), F.col(value_col[0]).cast("double").alias("_v"))
        tagged = part if tagged is None else tagged.unionByName(part)
    slots = [F.max(F.when(F.col("_m") == i, F.col("_v"))) for i in range(len(metrics))]
    return tagged.groupBy(*key).agg(zero_filled(slots).alias("features"))


def ml_vectors(frame: DataFrame, column: str = "features") -> DataFrame:
    """The same rows with ``column`` as a Spark ML vector, ready for ``pyspark.ml`` estimators."""
    from pyspark.ml.functions import array_to_vector

    return frame.withColumn(column, array_to_vector(column))


def feature_vectors(ind: DataFrame, win: Windows) -> DataFrame:
    """V1 over (volume, unique users, activeness, smoothed first-degree).

    The smoothed first-degree aggregate (A10) already has every key of the
    other three, so the same aggregate picks up the current slide's values
    (copy offset 0) and no outer join is needed.  Output keeps the metric
    columns (null = absent) next to ``features``.
    """
    current = FEATURES[:3]
    h = hop(ind.select("w_idx", "tag", *current, "first_degree"), "w_idx", win.analytic, shift=0, out="s_idx")
    now = F.col("s_idx") == F.col("w_idx")
    agg = h.groupBy(F.col("s_idx").alias("w_idx"), "tag").agg(
        *[F.max(F.when(now, F.col(c))).alias(c) for c in current],
        F.sum("first_degree").alias("first_degree_smoothed"),
    )
    return agg.withColumn("features", zero_filled([F.col(c) for c in FEATURES]))


def recurrent_groups(fv: DataFrame, win: Windows, live: DataFrame | None = None) -> DataFrame:
    """Live recurrent windows as ``(w_idx, tag, slots, newest_volume)``:
    ``slots`` holds the ``struct(pos, features)`` entries present (at most
    ``rec_window``), ``newest_volume`` the volume of the newest slot (0 if
    absent).  :func:`recurrent_vectors` assembles the dense vectors from it;
    reports can rank first and assemble only the rows they keep.

    Each slot row is copied to the ``rec_window / rec_slide`` recurrent windows
    holding it and grouped per ``(window, tag)``: at most ``rec_window``
    entries per group, whatever the data size.  ``live`` (one ``w_idx`` per
    slide that has feature vectors) may be given when the caller knows it more
    cheaply than from ``fv`` itself.
    """
    rs, rw = win.rec_slide, win.rec_window
    s = F.col("w_idx")
    first_r = s + F.pmod(-s, F.lit(rs))
    n_copies = -(-rw // rs)
    last_r = first_r + F.lit((n_copies - 1) * rs)
    expanded = fv.select(
        "w_idx", "tag", "features", F.explode(F.sequence(first_r, last_r, F.lit(rs).cast("long"))).alias("r_idx")
    ).where(F.col("r_idx") - s < F.lit(rw))
    pos = (F.lit(rw - 1) - (F.col("r_idx") - s)).cast("int")
    grouped = expanded.groupBy("r_idx", "tag").agg(
        F.collect_list(F.struct(pos.alias("pos"), F.col("features"))).alias("slots"),
        F.max(pos).alias("newest"),
        F.coalesce(F.max(F.when(pos == F.lit(rw - 1), F.col("features")[0])), F.lit(0.0)).alias("newest_volume"),
    )
    if live is None:
        # From the same groups: the newest slot of a window has keys iff some
        # group holds an entry at the last position.  One row per slide.  The
        # filter also reads ``slots`` so that column pruning leaves this branch
        # identical to the main one and Spark reuses its exchange instead of
        # computing the feature vectors a second time.
        live = grouped.where((F.col("newest") == F.lit(rw - 1)) & (F.size("slots") > 0)).select("r_idx").distinct()
    else:
        live = live.select(F.col("w_idx").alias("r_idx")).where(F.pmod("r_idx", F.lit(rs)) == 0)
    return grouped.join(live, "r_idx", "left_semi").select(
        F.col("r_idx").alias("w_idx"), "tag", "slots", "newest_volume"
    )


def recurrent_vectors(fv: DataFrame, win: Windows, live: DataFrame | None = None) -> DataFrame:
    """V2: every ``rec_slide`` slides, for each tag seen in the latest
    ``rec_window`` slides, its slot vectors oldest first, zero-filled to a
    constant width.  Nothing is emitted for a window whose newest slot has no
    keys at all (the reference's liveness rule).  See :func:`recurrent_groups`.
    """
    return assemble_recurrent(recurrent_groups(fv, win, live), win).select("w_idx", "tag", "features")


def assemble_recurrent(groups: DataFrame, win: Windows) -> DataFrame:
    """Dense ``features`` (``rec_window * n_features`` values) from ``slots``."""
    return groups.withColumn("features", slot_vector(F.col("slots"), win.rec_window, win.n_features)).drop("slots")
