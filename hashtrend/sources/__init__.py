"""Sources: raw message streams (Kafka, landed JSON lines) and their decode
path, plus the derived post view over the driver's ``events`` table."""

from hashtrend.sources.events import posts_from_events, raw_messages_from_events
from hashtrend.sources.messages import (
    POST_COLUMNS,
    TWEET_SCHEMA,
    decode,
    drop_delete_notices,
    read_json_lines,
    read_kafka,
)

__all__ = [
    "POST_COLUMNS",
    "TWEET_SCHEMA",
    "decode",
    "drop_delete_notices",
    "read_json_lines",
    "read_kafka",
    "posts_from_events",
    "raw_messages_from_events",
]
