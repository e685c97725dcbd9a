"""Raw tweet messages -> posts.

A raw message is ``(key string, value string)`` with ``value`` one tweet in
the public JSON format.  Decoding is ``from_json`` with a fixed schema (no
inference, and only the fields the indicators read are materialised), so it
stays inside whole-stage codegen and works unchanged on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashtrend.functions.tags import is_delete_notice

TWEET_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("timestamp_ms", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField(
            "user",
            T.StructType(
                [
                    T.StructField("screen_name", T.StringType()),
                    T.StructField("followers_count", T.IntegerType()),
                    T.StructField("friends_count", T.IntegerType()),
                ]
            ),
        ),
        T.StructField(
            "retweeted_status",
            T.StructType([T.StructField("retweet_count", T.IntegerType())]),
        ),
    ]
)

POST_COLUMNS = [
    "post_id",
    "ts",
    "screen_name",
    "text",
    "followers_count",
    "friends_count",
    "retweet_count",
]

# Fixed value of the public tweet format: created_at looks like
# "Wed Oct 10 20:19:24 +0000 2018"; the weekday is skipped because Spark does
# not parse day-of-week text.
CREATED_AT_PATTERN = "MMM dd HH:mm:ss Z yyyy"


def read_kafka(
    spark: SparkSession,
    bootstrap_servers: str,
    topic: str = "Tweet",
    *,
    streaming: bool = True,
    starting_offsets: str | None = None,
) -> DataFrame:
    """Kafka topic as raw messages (needs the spark-sql-kafka package)."""
    reader = spark.readStream if streaming else spark.read
    r = reader.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers).option("subscribe", topic)
    if starting_offsets:
        r = r.option("startingOffsets", starting_offsets)
    try:
        df = r.load()
    except Exception as e:  # connector missing: fail with the fix, not a class-path trace
        if "kafka" in str(e).lower() and ("find data source" in str(e).lower() or "DATA_SOURCE_NOT_FOUND" in str(e)):
            raise RuntimeError(
                "The Kafka source needs the spark-sql-kafka-0-10 package matching this Spark version "
                "(e.g. --packages org.apache.spark:spark-sql-kafka-0-10_2.13:<spark version>)."
            ) from e
        raise
    return df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def read_json_lines(
    spark: SparkSession,
    path: str,
    *,
    streaming: bool = False,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Landed JSON-lines files (one tweet per line) as raw messages."""
    if streaming:
        r = spark.readStream.format("text")
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        raw = r.load(path)
    else:
        raw = spark.read.text(path)
    return raw.select(F.lit(None).cast("string").alias("key"), F.col("value"))


def drop_delete_notices(raw: DataFrame) -> DataFrame:
    """Drop messages starting with exactly ``{"delete"``; short values are safe."""
    return raw.where(~is_delete_notice("value"))


def _event_time(t: F.Column) -> F.Column:
    from_millis = F.timestamp_millis(t["timestamp_ms"].try_cast("bigint"))
    from_created = F.try_to_timestamp(F.substring(t["created_at"], 5, 64), F.lit(CREATED_AT_PATTERN))
    return F.coalesce(from_millis, from_created)


def decode(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(posts, bad)``: malformed messages (no id or no time) never fail the job.

    ``raw`` should already have delete notices removed.
    """
    parsed = raw.select("key", "value", F.from_json("value", TWEET_SCHEMA).alias("m"))
    posts_all = parsed.select(
        "key",
        "value",
        F.col("m.id").alias("post_id"),
        _event_time(F.col("m")).alias("ts"),
        F.col("m.user.screen_name").alias("screen_name"),
        F.col("m.text").alias("text"),
        F.col("m.user.followers_count").alias("followers_count"),
        F.col("m.user.friends_count").alias("friends_count"),
        F.col("m.retweeted_status.retweet_count").alias("retweet_count"),
    )
    ok = F.col("post_id").isNotNull() & F.col("ts").isNotNull()
    posts = posts_all.where(ok).select(*POST_COLUMNS)
    bad = posts_all.where(~ok).select("key", "value")
    return posts, bad
