"""Posts -> tagged posts -> tag occurrences and co-tag pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashtrend.config import Windows
from hashtrend.functions.tags import hashtags
from hashtrend.functions.time import slot_index
from hashtrend.operators.windowing import hop_first_cover


def tagged_posts(posts: DataFrame, win: Windows) -> DataFrame:
    """Posts with their ``tags`` array and integer ``slot``; the text is dropped."""
    return posts.select(
        "post_id",
        slot_index("ts", win.batch_us).alias("slot"),
        "screen_name",
        "followers_count",
        "friends_count",
        "retweet_count",
        hashtags("text").alias("tags"),
    )


def occurrences(tagged: DataFrame) -> DataFrame:
    """One row per tag occurrence (a tag twice in a post gives two rows)."""
    return tagged.select(
        "post_id",
        "slot",
        "screen_name",
        "followers_count",
        "friends_count",
        "retweet_count",
        "tags",
        F.posexplode("tags").alias("pos", "tag"),
    )


# Neighbours per row while pairs are generated (tweets stay far below).
BIG_POST_TAGS = 256


def slot_pairs(tagged: DataFrame, big_post_tags: int = BIG_POST_TAGS) -> DataFrame:
    """Distinct ``(slot, tag, neighbour)``: each tag of a post paired with every
    distinct tag of the same post, itself included.  The pairs of one post are
    the edges of its co-tag clique; deduplicating per slot right away lets the
    map-side partial aggregate shrink them before any shuffle.

    A post with ``k`` distinct tags yields ``k**2`` pairs.  Every post's
    neighbour list is cut into chunks of ``big_post_tags`` (one chunk for all
    but huge texts), so no row holds more than that many neighbours.
    """
    K = big_post_tags
    posts = tagged.select("slot", F.array_distinct("tags").alias("tags")).where(F.size("tags") > 0)
    last_chunk = F.call_function("div", F.size("tags") - F.lit(1), F.lit(K))
    chunked = posts.select("slot", "tags", F.explode(F.sequence(F.lit(0).cast("long"), last_chunk)).alias("c")).select(
        "slot", "tags", F.slice("tags", (F.col("c") * K + 1).cast("int"), F.lit(K)).alias("nbs")
    )
    return (
        chunked.select("slot", F.explode("tags").alias("tag"), "nbs")
        .select("slot", "tag", F.explode("nbs").alias("neighbour"))
        .distinct()
    )


def co_tags(tagged: DataFrame, win: Windows) -> DataFrame:
    """Distinct ``(w_idx, tag, neighbour)`` per analytic window (P5, P6).

    Each distinct slot pair is copied only to the windows where it is the
    pair's earliest slot, so the result is distinct without a second
    distinct over the 16x copies.
    """
    return co_tags_from_pairs(slot_pairs(tagged), win)


def co_tags_from_pairs(pairs: DataFrame, win: Windows) -> DataFrame:
    """Finish :func:`co_tags` from distinct :func:`slot_pairs` rows."""
    return hop_first_cover(pairs, ["tag", "neighbour"], "slot", win.analytic).select("w_idx", "tag", "neighbour")
