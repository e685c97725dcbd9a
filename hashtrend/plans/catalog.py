"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each one reads the driver's ``events`` table (posts derive from it, see
``hashtrend.sources.events``) and runs the engine on all of it; the window
geometry is ``HOURLY`` (the reference ratios on 1 h batches, TESTDATA pace).
Doubles are rounded to 6 places and vectors rendered as integer text so that
results compare across engines; the engine itself keeps full precision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashtrend.config import HOURLY, Windows
from hashtrend.operators import assemble_recurrent, sketch_error, top_n, top_n_all
from hashtrend.plans.tables import RANKED_METRICS, IndicatorTables, vector_text
from hashtrend.session import ensure_engine_conf, spread_input
from hashtrend.sources import decode, drop_delete_notices, posts_from_events, raw_messages_from_events

Query = Callable[[SparkSession, str], DataFrame]

WIN: Windows = HOURLY
DIGITS = 6


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_engine_conf(spark)
    return spread_input(spark.read.parquet(f"{sf_dir}/events.parquet"))


def tables(spark: SparkSession, sf_dir: str, win: Windows = WIN) -> IndicatorTables:
    return IndicatorTables(posts_from_events(read_events(spark, sf_dir)), win)


# Sums of shares may differ in the last bits from one added in another order; halved fractions often lie exactly
# half way between two rounded values, where such a bit would decide.
SETTLED = 12


def rounded(col: str | F.Column, digits: int = DIGITS) -> F.Column:
    """Round for cross-engine comparison, after the last bits are settled; ``+ 0.0`` folds -0.0 into 0.0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(F.round(c, SETTLED), digits) + F.lit(0.0)


def _r(col: str) -> F.Column:
    return rounded(col).alias(col)


def _metric(table: str, col: str, *, not_null: bool = False) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = tables(spark, sf_dir)
        df = getattr(t, table)
        if not_null:
            df = df.where(F.col(col).isNotNull())
        return t.with_end(df.select("w_idx", "tag", col))

    q.__name__ = f"q_{col}"
    return q


def _sketched(exact: str, near: str, col: str) -> Query:
    """The exact value of every key, and whether the sketch's is within four standard errors of it (and at least one)."""

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = tables(spark, sf_dir)
        sketch = getattr(t, near).withColumnRenamed(col, "estimate")
        both = getattr(t, exact).select("w_idx", "tag", col).join(sketch, ["w_idx", "tag"], "full")
        error = F.abs(F.col("estimate") - F.col(col))
        within = F.coalesce(error <= F.greatest(F.lit(1.0), 4 * sketch_error() * F.col(col)), F.lit(False))
        return t.with_end(both.select("w_idx", "tag", col, within.alias("within_error")))

    q.__name__ = f"q_{near}"
    return q


def q_delete_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_delete_notices(raw_messages_from_events(read_events(spark, sf_dir)))


def q_posts_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, _ = decode(q_delete_filter(spark, sf_dir))
    return posts.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def q_posts_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = decode(q_delete_filter(spark, sf_dir))
    return bad


def q_hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return t.occurrences.select(
        "post_id",
        "pos",
        "tag",
        "screen_name",
        "followers_count",
        "friends_count",
        "retweet_count",
        F.size("tags").alias("n_tags"),
    )


def q_co_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return t.with_end(t.co_tags)


def q_total_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return t.with_end(t.total_volume)


def q_percent_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return t.with_end(t.share.select("w_idx", "tag", _r("percent_share")))


def q_reference_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return t.with_end(t.reference.select("w_idx", "tag", _r("reference_share_mean"), _r("reference_share_halving")))


def q_delta_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return t.with_end(t.reference.select("w_idx", "tag", _r("delta_share"), _r("delta_share_halving")))


ROUNDED = {
    "percent_share",
    "reference_share_mean",
    "reference_share_halving",
    "delta_share",
    "delta_share_halving",
}


def q_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    ind = t.indicators
    return t.with_end(ind.select(*[_r(c) if c in ROUNDED else F.col(c) for c in ind.columns]))


def q_feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return t.with_end(t.feature_vectors.select("w_idx", "tag", vector_text().alias("features")))


def q_assembled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return t.with_end(t.assembled_vectors.select("w_idx", "tag", vector_text().alias("features")))


def q_recurrent_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return t.with_end(t.recurrent_vectors.select("w_idx", "tag", vector_text().alias("features")))


def _top(table: str, metric: str, *, digits: int | None = None, n: int = 10) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = tables(spark, sf_dir)
        rep = top_n(getattr(t, table), metric, n)
        if digits is not None:
            rep = rep.withColumn("value", rounded("value", digits))
        return t.with_end(rep)

    q.__name__ = f"q_top_{metric}"
    return q


def q_top_delta_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Ranked on the value rounded to 9 places: the reference mean is a float
    # sum whose last bit depends on summation order, and exact ties between
    # tags with equal histories must not be broken by that bit.
    t = tables(spark, sf_dir)
    ranked = top_n(t.reference, "delta_share", 10, order=F.round("delta_share", 9))
    return t.with_end(ranked.withColumn("value", rounded("value")))


def q_top_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: the first 10 recurrent vectors of each window (by newest-slot
    volume), with the window's vector count.  Ranked on the collected slot
    entries; only the kept rows are assembled into dense vectors."""
    t = tables(spark, sf_dir)
    ranked = top_n(t.recurrent_groups, "newest_volume", 10, carry=["slots"])
    vec = assemble_recurrent(ranked, WIN)
    return t.with_end(vec.select("w_idx", "rank", "tag", "value", "n_total", vector_text().alias("features")))


def q_top_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 10 of all ten ranked indicators of each slide, from one ranking."""
    t = tables(spark, sf_dir)
    return t.with_end(top_n_all(t.ranked_metrics, RANKED_METRICS).withColumn("value", rounded("value")))


TOP_METRICS = {
    "velocity": ("base", None),
    "unique_users": ("base", None),
    "follower_reach": ("base", None),
    "friend_reach": ("base", None),
    "retweeted_volume": ("base", None),
    "activeness": ("activeness", None),
    "first_degree_smoothed": ("smoothed", None),
    "percent_share": ("share", DIGITS),
}


def registry() -> dict[str, Query]:
    q: dict[str, Query] = {
        "delete_filter": q_delete_filter,
        "posts_decode": q_posts_decode,
        "posts_bad": q_posts_bad,
        "hashtags": q_hashtags,
        "co_tags": q_co_tags,
        "volume": _metric("base", "volume"),
        "half_volume": _metric("base", "half_volume"),
        "velocity": _metric("base", "velocity", not_null=True),
        "velocity_with_cooling": _metric("velocity_with_cooling", "velocity"),
        "unique_users": _metric("base", "unique_users"),
        "follower_reach": _metric("base", "follower_reach"),
        "friend_reach": _metric("base", "friend_reach"),
        "retweeted_volume": _metric("base", "retweeted_volume", not_null=True),
        "activeness": _metric("activeness", "activeness"),
        "approx_unique_users": _sketched("base", "approx_unique_users", "unique_users"),
        "approx_activeness": _sketched("activeness", "approx_activeness", "activeness"),
        "first_degree": _metric("first_degree", "first_degree"),
        "first_degree_smoothed": _metric("smoothed", "first_degree_smoothed"),
        "total_volume": q_total_volume,
        "percent_share": q_percent_share,
        "reference_share": q_reference_share,
        "delta_share": q_delta_share,
        "indicators": q_indicators,
        "feature_vectors": q_feature_vectors,
        "assembled_vectors": q_assembled_vectors,
        "recurrent_vectors": q_recurrent_vectors,
        "top_tags": _top("base", "volume"),
        "top_delta_share": q_top_delta_share,
        "top_vectors": q_top_vectors,
        "top_all": q_top_all,
    }
    for metric, (table, digits) in TOP_METRICS.items():
        q[f"top_{metric}"] = _top(table, metric, digits=digits)
    return q
