"""Top-N reports per slide (O1-O3, A15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(
    df: DataFrame,
    metric: str | Column,
    n: int = 10,
    *,
    key: str = "w_idx",
    label: str = "tag",
    order: Column | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """Rank ``label`` per ``key`` by ``metric`` descending (ties by label),
    keep ``rank <= n`` and carry ``n_total``, the number of ranked rows of the
    slide.  ``order`` ranks on another expression than the reported value;
    ``carry`` keeps more columns on the ranked rows.

    ``row_number`` with ``rank <= n`` is planned as a window group limit, so
    each map task ships at most ``n`` rows per slide to the final ranking;
    the totals are a grouped count.
    """
    value = F.col(metric) if isinstance(metric, str) else metric
    carry = carry or []
    present = df.select(
        key, label, value.alias("value"), (order if order is not None else value).alias("_order"), *carry
    ).where(F.col("value").isNotNull())
    w = Window.partitionBy(key).orderBy(F.desc("_order"), F.asc(label))
    ranked = present.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    totals = present.groupBy(key).agg(F.count(F.lit(1)).alias("n_total"))
    return ranked.join(totals, key).select(key, "rank", label, "value", "n_total", *carry)


def top_n_all(df: DataFrame, metrics: list[str], n: int = 10, *, key: str = "w_idx", label: str = "tag", settle: int = 9) -> DataFrame:
    """The :func:`top_n` of every column in ``metrics`` from one pass: ``(key, metric, rank, label, value, n_total)``.

    The columns are unpivoted and ranked per ``(key, metric)``, so all reports share one scan, one exchange and one
    window group limit.  Values are doubles; ranks go by the value rounded to ``settle`` places, as the last bits of a
    float sum must not decide between equal histories.
    """
    tall = df.unpivot([key, label], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    present = tall.where(F.col("value").isNotNull())
    w = Window.partitionBy(key, "metric").orderBy(F.desc(F.round("value", settle)), F.asc(label))
    ranked = present.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    totals = present.groupBy(key, "metric").agg(F.count(F.lit(1)).alias("n_total"))
    return ranked.join(totals, [key, "metric"]).select(key, "metric", "rank", label, "value", "n_total")
