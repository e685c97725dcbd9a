"""Hashtag extraction and message predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference: tokens are split on one ASCII
# space only, a hashtag is any token starting with "#", and a delete notice is
# a message whose first nine characters are exactly '{"delete"'.
TOKEN_SEPARATOR = " "
TAG_PREFIX = "#"
DELETE_PREFIX = '{"delete"'


def hashtags(text: Column | str) -> Column:
    """Tags of one post, in text order, duplicates and punctuation kept.

    ``split`` takes a regex; a single space has no special meaning.  Limit -1
    keeps empty tokens, which never start with ``#`` anyway.
    """
    col = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(col, TOKEN_SEPARATOR, -1), lambda t: t.startswith(TAG_PREFIX))


def is_delete_notice(value: Column | str) -> Column:
    col = F.col(value) if isinstance(value, str) else value
    return F.coalesce(col.startswith(DELETE_PREFIX), F.lit(False))
