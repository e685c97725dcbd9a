"""The 7-post hand fixture and its golden values (FIXTURES.md §4)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

POST_SCHEMA = T.StructType(
    [
        T.StructField("post_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("screen_name", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("followers_count", T.IntegerType()),
        T.StructField("friends_count", T.IntegerType()),
        T.StructField("retweet_count", T.IntegerType()),
    ]
)

_E = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)

# (seconds after the epoch, user, followers, friends, retweet_count, text)
POSTS = [
    (1, "alice", 100, 10, None, "#spark rocks #ml"),
    (5, "bob", 50, 5, None, "#spark #spark #"),
    (9, "alice", 100, 10, None, "hello #ML,"),
    (17, "carol", 7, 70, 40, "RT @x: #spark #graph"),
    (19, "bob", 50, 5, 41, "RT @x: #graph"),
    (33, "dave", 3, 4, None, "#ml\t#tab #graph no"),
    (40, "erin", 9, 9, None, "no tags"),
]


def posts_df(spark):
    rows = [
        (i + 1, _E + dt.timedelta(seconds=s), u, text, fol, fri, rt)
        for i, (s, u, fol, fri, rt, text) in enumerate(POSTS)
    ]
    return spark.createDataFrame(rows, POST_SCHEMA)


N = None
# t, tag, volume, half, velocity, users, followers, friends, retweeted,
# activeness, first_degree, smoothed, share, ref mean, ref halving
GOLDEN = [
    (20, "#", 1, 1, 1, 1, 50, 5, N, 2, 5, 34, 0.111111, 0.162847, 0.128993),
    (20, "#ML,", 1, 1, 1, 1, 100, 10, N, 1, 1, 6, 0.111111, 0.150463, 0.128472),
    (20, "#graph", 2, 2, 2, 2, 57, 75, 81, 2, 6, 11, 0.222222, 0.173611, 0.173611),
    (20, "#ml", 1, 0, N, 1, 100, 10, N, 2, 5, 38, 0.111111, 0.230278, 0.130165),
    (20, "#spark", 4, 3, 2, 3, 207, 90, 40, 4, 8, 49, 0.444444, 0.514444, 0.473394),
    (32, "#graph", 2, 2, 2, 2, 57, 75, 81, 2, 6, 47, 0.222222, 0.210069, 0.221463),
    (32, "#spark", 4, 1, -2, 3, 207, 90, 40, 4, 8, 97, 0.444444, 0.488194, 0.444897),
    (34, "#", 1, 0, N, 1, 50, 5, N, 2, 4, 68, 0.111111, 0.138704, 0.111251),
    (34, "#ML,", 1, 0, N, 1, 100, 10, N, 1, 1, 13, 0.111111, 0.129274, 0.111247),
    (34, "#graph", 3, 2, 1, 3, 60, 79, 81, 3, 7, 54, 0.333333, 0.223765, 0.277398),
    (34, "#ml", N, N, N, N, N, N, N, N, N, 66, N, N, N),
    (34, "#ml\t#tab", 1, 1, 1, 1, 3, 4, N, 2, 4, 4, 0.111111, 0.111111, 0.111111),
    (34, "#spark", 3, 0, N, 2, 107, 80, 40, 3, 7, 102, 0.333333, 0.479085, 0.389115),
    (62, "#", N, N, N, N, N, N, N, N, N, 13, N, N, N),
    (62, "#ML,", N, N, N, N, N, N, N, N, N, 5, N, N, N),
    (62, "#graph", 1, 0, N, 1, 3, 4, N, 2, 2, 65, 0.5, 0.409300, 0.502011),
    (62, "#ml", N, N, N, N, N, N, N, N, N, 5, N, N, N),
    (62, "#ml\t#tab", 1, 0, N, 1, 3, 4, N, 2, 2, 47, 0.5, 0.312593, 0.496331),
    (62, "#spark", N, N, N, N, N, N, N, N, N, 46, N, N, N),
]
# Slide ends whose full tag set is listed above.
COMPLETE_AT = {20, 34, 62}

# Recurrent vectors at t = 10: the last five slots (ends 2..10), 4 values each.
GOLDEN_RECURRENT_10 = {
    "#": [0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 2, 4, 1, 1, 2, 8, 1, 1, 2, 12],
    "#ML,": [0] * 16 + [1, 1, 1, 1],
    "#ml": [1, 1, 2, 2, 1, 1, 2, 4, 1, 1, 2, 8, 1, 1, 2, 12, 1, 1, 2, 16],
    "#spark": [1, 1, 2, 2, 1, 1, 2, 4, 3, 2, 3, 9, 3, 2, 3, 14, 3, 2, 3, 19],
}
