"""Release and privacy views."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RELEASE_COLUMNS = ("comment_id", "parent_id", "video_id", "channel_name", "channel_id",
                   "published_at", "like_count", "reply_count", "has_telugu_script",
                   "script_mix_ratio", "roman_telugu_hits", "is_tenglish")


def release_view(enriched: DataFrame, columns: Sequence[str] = RELEASE_COLUMNS) -> DataFrame:
    """Published rows carry ids and metadata only — never text or author."""
    forbidden = {"text", "text_original", "author"}
    return enriched.select(*[c for c in columns if c not in forbidden])


RELEASE_KEY_CONF = "spark.corpusforge.release.key"
HASH_BLOCK = 64     # bytes of a SHA-256 block


def release_key(spark: SparkSession) -> str:
    """The secret key of a release, from the session's configuration; there is no default."""
    key = spark.conf.get(RELEASE_KEY_CONF, None)
    if not key:
        raise ValueError(f"{RELEASE_KEY_CONF} is not set: names are only released under a secret key of the release's own")
    return key


def anonymize_author(author: Column, key: str) -> Column:
    """R2: HMAC-SHA-256 of the author name under a secret key (a null name counts as an empty one).

    Two native digests over the padded key.  Without the key, names can't be guessed back from a list of candidates.
    """
    if not key:
        raise ValueError("the key must not be empty")
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > HASH_BLOCK else raw).ljust(HASH_BLOCK, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in raw)) for pad in (0x36, 0x5C))
    name = F.coalesce(author, F.lit("")).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, name), 256))), 256)


def row_digest(cols: Sequence[str]) -> Column:
    """A 60-bit integer digest of one row (first 15 hex digits of MD5)."""
    joined = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("bigint")


def fingerprint(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Order-free fingerprint ``(n_rows, digest_sum)`` of a table."""
    cols = list(cols or df.columns)
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                  F.sum(row_digest(cols).cast("decimal(38,0)")).cast("decimal(38,0)").alias("digest_sum"))


def locked_snapshot(df: DataFrame, path: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Write the snapshot once (fails if the path exists) and return its fingerprint read back."""
    df.write.mode("errorifexists").parquet(path)
    return fingerprint(df.sparkSession.read.parquet(path), cols)


def rehydrate(ids: DataFrame, fetched: DataFrame, id_col: str = "comment_id") -> DataFrame:
    """Published ids joined to freshly fetched text, with a ``missing`` flag."""
    return (ids.join(fetched, id_col, "left")
            .withColumn("missing", F.col("text").isNull()))
