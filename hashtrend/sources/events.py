"""The driver's ``events`` table seen as a stream of posts.

The generated tables carry no hashtags, so posts are derived from event
fields (rules fixed in FIXTURES.md §5): a tag from the event type, a ``#k…``
tag from the props on every third event, the type tag repeated on every fifth,
and every ``view`` event is a retweet.  Everything downstream grows with
``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def posts_from_events(events: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    etype = F.col("event_type")
    text = F.concat(
        F.lit("#"),
        etype,
        F.when(eid % 3 == 0, F.concat(F.lit(" #k"), F.get_json_object("props", "$.k"))).otherwise(F.lit("")),
        F.when(eid % 5 == 0, F.concat(F.lit(" #"), etype)).otherwise(F.lit(" word")),
    )
    return events.select(
        eid.alias("post_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("screen_name"),
        text.alias("text"),
        (F.col("user_id") * 37 % 1000).cast("int").alias("followers_count"),
        (F.col("user_id") * 17 % 500).cast("int").alias("friends_count"),
        F.when(etype == "view", F.floor("value").cast("int")).alias("retweet_count"),
    )


def raw_messages_from_events(events: DataFrame) -> DataFrame:
    """Kafka-shaped ``(key, value)`` messages: posts in the nested tweet JSON,
    every 7th event a delete notice and otherwise every 11th malformed."""
    p = posts_from_events(events)
    tweet = F.to_json(
        F.struct(
            F.col("post_id").alias("id"),
            F.unix_millis("ts").cast("string").alias("timestamp_ms"),
            F.col("text"),
            F.struct("screen_name", "followers_count", "friends_count").alias("user"),
            F.when(
                F.col("retweet_count").isNotNull(),
                F.struct(F.col("retweet_count")),
            ).alias("retweeted_status"),
        )
    )
    delete = F.concat(F.lit('{"delete":{"status":{"id":'), F.col("post_id").cast("string"), F.lit("}}}"))
    value = (
        F.when(F.col("post_id") % 7 == 0, delete)
        .when(F.col("post_id") % 11 == 0, F.lit("x"))
        .otherwise(tweet)
    )
    return p.select(F.col("post_id").cast("string").alias("key"), value.alias("value"))
