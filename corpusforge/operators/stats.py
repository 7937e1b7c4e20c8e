"""Corpus statistics; runs and the dataset card (A12) are in ``runs``.

Every statistic is one grouped aggregate; per-video figures are aggregated
on the comment side first (map-side combine) and only then joined to the
listing, so a video holding a third of all comments never becomes one
join group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def per_video_log(videos: DataFrame, channels: DataFrame, enriched: DataFrame) -> DataFrame:
    """A3: per listed video: comments and code-mixed comments, zero-comment videos included."""
    counts = enriched.groupBy("video_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("total_comments"),
        F.count(F.when(F.col("is_tenglish"), 1)).cast("bigint").alias("tenglish"))
    return (videos.join(channels, "channel_idx")
            .join(counts, "video_id", "left")
            .select(F.col("channel_name").alias("channel"), "video_id",
                    T.title_preview(F.col("video_title"), 80).alias("video_title"),
                    F.coalesce("total_comments", F.lit(0)).cast("bigint").alias("total_comments"),
                    F.coalesce("tenglish", F.lit(0)).cast("bigint").alias("tenglish")))


def corpus_stats(enriched: DataFrame) -> DataFrame:
    """A4: total, code-mixed, native-script, roman-only (= mixed − native) and % mixed."""
    agg = enriched.agg(
        F.count(F.lit(1)).cast("bigint").alias("total"),
        F.count(F.when(F.col("is_tenglish"), 1)).cast("bigint").alias("tenglish"),
        F.count(F.when(F.col("has_telugu_script"), 1)).cast("bigint").alias("has_script"))
    return agg.select("total", "tenglish", "has_script",
                      (F.col("tenglish") - F.col("has_script")).alias("roman_only"),
                      T.pct_one_dp(F.col("tenglish"), F.col("total")).alias("pct_tenglish"))


def posts_per_account(posts: DataFrame) -> DataFrame:
    """A5 + W8: posts per account, most first (ties by name)."""
    return (posts.groupBy("source_account").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .orderBy(F.col("n").desc(), F.col("source_account")))


def account_mixed_count(posts: DataFrame) -> DataFrame:
    """Collected and code-mixed posts per account plus a grand-total row (account null)."""
    return (posts.rollup("source_account").agg(
        F.count(F.lit(1)).cast("bigint").alias("collected"),
        F.count(F.when(F.col("is_tenglish"), 1)).cast("bigint").alias("tenglish"))
        .withColumn("pct_tenglish", T.pct_one_dp(F.col("tenglish"), F.col("collected"))))
