"""Posts folded into panes, one pass over the source for every indicator.

A pane row is ``(slot, kind, tag, item) -> n, fol, fri, rt``: kind ``'u'`` holds
the author of a tag's occurrences (with counts and reach), kind ``'n'`` a distinct
co-occurring neighbour and kind ``'t'`` is the tick of a slide that had any post,
tagged or not.  The stream aggregates the same rows (``streaming.pane_stream``);
the batch job writes them once and derives every table from what it wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashtrend.config import Windows
from hashtrend.functions.tags import hashtags
from hashtrend.functions.time import slot_index

PANE_COLUMNS = ["slot", "kind", "tag", "item", "n", "fol", "fri", "rt"]


def pane_rows(posts: DataFrame) -> DataFrame:
    """``(ts, kind, tag, item, n, fol, fri, rt)`` before the aggregate.

    Two chained generators, both lazy: first one row per tag occurrence (kind
    'u') and per distinct tag (kind 'n'), then the item of each: the author for
    'u', every distinct tag of the post for 'n'.  No array of all pairs of a
    post is ever built.
    """
    tagged = posts.select(
        "ts",
        "screen_name",
        F.col("followers_count").cast("long").alias("fol"),
        F.col("friends_count").cast("long").alias("fri"),
        F.col("retweet_count").cast("long").alias("rt"),
        hashtags("text").alias("tags"),
    )
    distinct_tags = F.array_distinct("tags")
    none = F.array().cast("array<struct<kind:string,tag:string>>")
    keyed = F.concat(
        F.coalesce(F.transform("tags", lambda t: F.struct(F.lit("u").alias("kind"), t.alias("tag"))), none),
        F.coalesce(F.transform(distinct_tags, lambda t: F.struct(F.lit("n").alias("kind"), t.alias("tag"))), none),
        # one tick per post, tagged or not, so that every slide with any post closes
        F.array(F.struct(F.lit("t").alias("kind"), F.lit("").alias("tag"))),
    )
    first = tagged.select("ts", "screen_name", "fol", "fri", "rt", distinct_tags.alias("dtags"), F.explode(keyed).alias("k"))
    author = F.col("k.kind") == "u"
    tick = F.col("k.kind") == "t"
    items = F.when(author, F.array(F.col("screen_name"))).when(tick, F.array(F.lit(""))).otherwise(F.col("dtags"))
    return first.select(
        "ts",
        F.col("k.kind").alias("kind"),
        F.col("k.tag").alias("tag"),
        F.explode(items).alias("item"),
        F.lit(1).cast("long").alias("n"),
        F.when(author, F.col("fol")).alias("fol"),
        F.when(author, F.col("fri")).alias("fri"),
        F.when(author, F.col("rt")).alias("rt"),
    )


def fold_panes(rows: DataFrame, pane: Column) -> DataFrame:
    """One row per ``(pane, kind, tag, item)``, with map-side partial sums."""
    return rows.groupBy(pane, "kind", "tag", "item").agg(
        F.sum("n").alias("n"), F.sum("fol").alias("fol"), F.sum("fri").alias("fri"), F.sum("rt").alias("rt")
    )


def post_panes(posts: DataFrame, win: Windows) -> DataFrame:
    """Batch panes: ``PANE_COLUMNS`` from one scan of the posts."""
    return fold_panes(pane_rows(posts), slot_index("ts", win.batch_us).alias("slot")).select(*PANE_COLUMNS)


def author_rows(panes: DataFrame) -> DataFrame:
    """The rows :func:`~hashtrend.operators.indicators.base_from_panes` takes."""
    return panes.where(F.col("kind") == "u").select(
        "slot", "tag", F.col("item").alias("screen_name"), "n", "fol", "fri", "rt"
    )


def neighbour_rows(panes: DataFrame) -> DataFrame:
    """The rows :func:`~hashtrend.operators.extract.co_tags_from_pairs` takes."""
    return panes.where(F.col("kind") == "n").select("slot", "tag", F.col("item").alias("neighbour"))
