"""Fixed schemas of the post tables the reference reads and writes."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    FloatType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# Posts CSV: every value read as a string, typed once after the read.
POST_COLUMNS = [
    "tweet_id", "account_id", "created_at", "full_text", "retweet_count", "favorite_count",
    "reply_to_tweet_id", "reply_to_user_id", "reply_to_username", "username",
]
POSTS_CSV = StructType([StructField(c, StringType()) for c in POST_COLUMNS])

# Typed `posts` table (the search index mapping).
POSTS = StructType([
    StructField("tweet_id", StringType()),
    StructField("account_id", StringType()),
    StructField("created_at", TimestampType()),
    StructField("full_text", StringType()),
    StructField("retweet_count", IntegerType()),
    StructField("favorite_count", IntegerType()),
    StructField("reply_to_tweet_id", StringType()),
    StructField("reply_to_user_id", StringType()),
    StructField("reply_to_username", StringType()),
    StructField("username", StringType()),
    StructField("full_text_vector", ArrayType(FloatType(), containsNull=False)),
])

# Embedded-posts JSON lines: CSV columns as strings plus the vector. Numeric
# fields are read as strings so that a bad value is a typed reject, not a
# corrupt record.
POSTS_JSONL = StructType(
    [StructField(c, StringType()) for c in POST_COLUMNS]
    + [
        StructField("full_text_vector", ArrayType(StringType())),
        StructField("_corrupt_record", StringType()),
    ]
)

# Account archive document.
_TWEET = StructType([
    StructField("id", StringType()),
    StructField("full_text", StringType()),
    StructField("created_at", StringType()),
    StructField("in_reply_to_user_id", StringType()),
    StructField("in_reply_to_status_id", StringType()),
    StructField("retweeted", BooleanType()),
])
ARCHIVE = StructType([
    StructField("account", ArrayType(StructType([
        StructField("account", StructType([StructField("accountId", StringType())])),
    ]))),
    StructField("tweets", ArrayType(StructType([
        StructField("retweeted", BooleanType()),
        StructField("tweet", _TWEET),
    ]))),
])
