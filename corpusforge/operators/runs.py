"""Collection runs (E2, A3, A12): one ledger per run, of which the log and the dataset card are views.

A run writes its comment rows once, counts them once per video, and publishes the counts as its ledger: the processed videos in
the order of the run, with the run's start, end and method in the table's pointer (``sources.versions``).  Nothing is collected or
scored again for the log, the statistics or the card, and a reader sees a whole run or the one before.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import consts as K
from ..functions import text as T
from ..sources import versions
from . import collect as L

#: sections of the card in the order of its text form
SECTIONS = ("collection", "sources", "statistics", "detection")


def now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")


def video_counts(enriched: DataFrame) -> DataFrame:
    """Per video its comments, code-mixed and native-script comments, and first and last comment dates."""
    return enriched.groupBy("video_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("total_comments"),
        F.count(F.when(F.col("is_tenglish"), 1)).cast("bigint").alias("tenglish"),
        F.count(F.when(F.col("has_telugu_script"), 1)).cast("bigint").alias("has_script"),
        F.min(F.substring("published_at", 1, 10)).alias("first_date"), F.max(F.substring("published_at", 1, 10)).alias("last_date"))


def write_ledger(path: str, videos: DataFrame, channels: DataFrame, counts: DataFrame, started_at: str, ended_at: str | None = None,
                 method: Mapping[str, str] | None = None, run: int | None = None) -> int:
    """Publish a run's ledger at ``path``; returns the run's number.

    ``videos``: the processed ones, in the order of (channel_idx, video_rank) if they carry a rank, else newest first in a channel;
    ``counts``: :func:`video_counts` (videos without comments are processed videos, too).
    """
    spark = videos.sparkSession
    if run is None:
        says = versions.read_pointer(spark, path)
        run = 0 if says is None else says["version"] + 1
    place = "video_rank" if "video_rank" in videos.columns else "published_at"
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total_comments", "tenglish", "has_script")]
    ledger = (videos.select("video_id", "channel_idx", "video_title", F.col(place).alias("_place")).join(channels, "channel_idx")
              .join(counts, "video_id", "left")
              .select(F.struct("channel_idx", F.col("_place").alias("place"), "video_id").alias("position"),
                      F.col("channel_name").alias("channel"), "video_id", T.title_preview(F.col("video_title"), 80).alias("video_title"),
                      *zero, "first_date", "last_date"))
    versions.publish(ledger, path, run, started_at=started_at, ended_at=ended_at or now(), method=dict(method or {}))
    return run


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The current run's ledger and what was recorded with it (version, started_at, ended_at, method)."""
    ledger = versions.read_current(spark, path)
    if ledger is None:
        raise ValueError(f"no run under {path}")
    return ledger, versions.read_pointer(spark, path)


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """A3 as a view of the ledger: the processed videos with their comments and code-mixed comments."""
    ledger, _ = read_ledger(spark, path)
    return ledger.select("channel", "video_id", "video_title", "total_comments", "tenglish")


def _card_lines(spark: SparkSession, path: str, block: K.ScriptBlock) -> DataFrame:
    """The card's rows with their place: (section number, place, metric number)."""
    ledger, says = read_ledger(spark, path)

    def rows(df: DataFrame, section: str, place, item, pairs) -> DataFrame:
        cells = [F.struct(F.lit(i).alias("_k"), F.lit(m).alias("metric"), v.cast("string").alias("value")) for i, (m, v) in enumerate(pairs)]
        return df.select(F.lit(SECTIONS.index(section)).alias("_s"), F.lit(section).alias("section"), place.alias("_p"), item.alias("item"),
                         F.inline(F.array(*cells)))

    sources = rows(ledger, "sources", F.col("position"), F.concat_ws(":", "channel", F.col("video_id").cast("string")),
                   [("comments", F.col("total_comments")), ("tenglish", F.col("tenglish"))])
    total = ledger.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("total_comments", "tenglish", "has_script")],
                       F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))
    n, mixed, native = F.col("total_comments"), F.col("tenglish"), F.col("has_script")
    nowhere = F.lit(None).cast(ledger.schema["position"].dataType)
    statistics = rows(total, "statistics", nowhere, F.lit("corpus"), [("total", n), ("tenglish", mixed), ("telugu_script", native),
                      ("roman_only", mixed - native), ("pct_tenglish", T.pct_one_dp(mixed, n))])
    window = rows(total, "collection", nowhere, F.lit("window"), [("first_date", F.lit(says["started_at"][:10])), ("last_date", F.lit(says["ended_at"][:10]))])
    dates = rows(total, "collection", nowhere, F.lit("comments"), [("first_date", F.col("first_date")), ("last_date", F.col("last_date"))])
    method = rows(total, "collection", nowhere, F.lit("method"), [(k, F.lit(str(v))) for k, v in says["method"].items()]) if says["method"] else None
    rule = rows(total, "detection", nowhere, F.lit("any_of"), [
        ("native_script", F.lit(f"U+{block.lo:04X}-U+{block.hi:04X}")), ("script_mix_ratio", F.lit(f">= {K.MIX_RATIO}")),
        ("vocabulary", F.lit(f">= 1 of {len(dict.fromkeys(K.LEXICON_COMMENTS))} words"))])
    out = sources
    for part in (statistics, window, dates, method, rule):
        out = out if part is None else out.unionByName(part)
    return out


def run_card(spark: SparkSession, path: str, block: K.ScriptBlock = K.TELUGU) -> DataFrame:
    """A12 as a view of the ledger: (section, item, metric, value) rows: run window and method, sources, statistics, detection rule."""
    return _card_lines(spark, path, block).select("section", "item", "metric", "value")


def write_card_text(spark: SparkSession, path: str, out: str, block: K.ScriptBlock = K.TELUGU) -> None:
    """The card as text lines, section by section, sources in the order of the run (a range-partitioned sort, parts in order)."""
    lines = _card_lines(spark, path, block)
    heads = spark.createDataFrame([(i, s.upper()) for i, s in enumerate(SECTIONS)], "_s int, line string")
    body = lines.select("_s", F.lit(1).alias("_h"), "_p", "item", "_k", F.concat(F.lit("  "), F.concat_ws("  ", "item", F.concat_ws(
        ": ", "metric", F.coalesce("value", F.lit(""))))).alias("line"))
    head = heads.select("_s", F.lit(0).alias("_h"), F.lit(None).cast(lines.schema["_p"].dataType).alias("_p"), F.lit("").alias("item"),
                        F.lit(0).alias("_k"), "line")
    (head.unionByName(body).orderBy("_s", "_h", "_p", "item", "_k").select(F.col("line").alias("value"))
     .write.mode("overwrite").text(out))


def collect_run(path: str, videos: DataFrame, comments: DataFrame, channels: DataFrame, videos_per_channel: int = K.VIDEOS_PER_CHANNEL,
                rows_per_video: int = K.ROWS_PER_VIDEO, page: int = K.PAGE_SIZE, target: int = K.TOTAL_TARGET, collect_replies: bool = True,
                started_at: str | None = None, ended_at: str | None = None, block: K.ScriptBlock = K.TELUGU) -> DataFrame:
    """E2 as a run: collect and score the comments, write them under ``path/comments``, then the ledger under ``path/ledger``.

    Returns the written comments.  A run that fails before its ledger leaves the run before current.
    """
    spark = videos.sparkSession
    started = started_at or now()
    says = versions.read_pointer(spark, f"{path}/ledger")
    run = 0 if says is None else says["version"] + 1
    done, rows = L.collect_comment_rows(videos, comments, channels, videos_per_channel, rows_per_video, page, target, collect_replies, block)
    versions.publish(rows, f"{path}/comments", run)
    written = versions.read_current(spark, f"{path}/comments")
    processed = videos.join(done.select("video_id", "video_rank"), "video_id")
    method = {"comment_order": "relevance", "replies_collected": str(collect_replies).lower(), "videos_per_channel": str(videos_per_channel),
              "rows_per_video": str(rows_per_video), "target": str(target)}
    write_ledger(f"{path}/ledger", processed, channels, video_counts(written), started, ended_at, method, run)
    return written
