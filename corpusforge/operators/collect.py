"""Collection-side operators: caps, budgets, enrichment, post extraction.

SURVEY IDs: W1–W5, F5, F7, D2, J1, J4, P24–P26, U1, U2.

The reference collects rows in nested loops with early stops.  Here each
stop rule is a set operation:

* per-group caps (W1, W2) are ``row_number() <= N`` filters, which Spark
  turns into a partial per-partition top-N before the shuffle
  (WindowGroupLimit), so a hot channel/account ships at most N rows per
  input partition;
* the paged soft cap (W3) only ever looks at the first ``cap`` threads of a
  video (every fetched page starts below the cap and every thread adds at
  least one row), so the sequential page recurrence folds over an array of
  at most ``cap`` elements per video;
* global budgets (W4, W5) use the distributed running sum in ``prefix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import consts as K
from ..functions import text as T
from ..session import materialize
from .prefix import exclusive_running_sum


def _cols(cs: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def top_n_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column | str],
                    n: int, rank_col: str = "rank") -> DataFrame:
    """Keep the first ``n`` rows per group in ``order_cols`` order, with their 1-based rank."""
    w = Window.partitionBy(*group_cols).orderBy(*_cols(order_cols))
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def recent_videos_per_channel(videos: DataFrame, n: int = K.VIDEOS_PER_CHANNEL) -> DataFrame:
    """Newest ``n`` videos per channel (ties broken by video id)."""
    return top_n_per_group(videos, ["channel_idx"],
                           [F.col("published_at").desc(), F.col("video_id")], n, "video_rank")


def enabled_sources(channels: DataFrame, videos: DataFrame) -> DataFrame:
    """channels with at least one listed video (others are skipped)."""
    return channels.join(videos.select("channel_idx"), "channel_idx", "left_semi")


# --- threads and comment rows ------------------------------------------------

def thread_rows(comments: DataFrame, collect_replies: bool = True) -> DataFrame:
    """Per thread: its relevance inputs and the number of rows fetching it yields.

    A thread yields its top-level comment plus all its replies when replies
    are collected.
    """
    per_thread = comments.groupBy("video_id", "thread_id").agg(
        F.count(F.when(F.col("turn") > 0, 1)).cast("bigint").alias("reply_count"),
        F.max(F.when(F.col("turn") == 0, F.col("like_count"))).alias("top_likes"),
    )
    replies = F.col("reply_count") if collect_replies else F.lit(0)
    return per_thread.withColumn("n_rows", (F.lit(1) + replies).cast("bigint"))


def paged_soft_cap(threads: DataFrame, cap: int = K.ROWS_PER_VIDEO, page: int = K.PAGE_SIZE,
                   rank_cols: Sequence[Column | str] | None = None) -> DataFrame:
    """Threads fetched per video under the soft row cap with paged requests.

    Pages of ``min(page, cap - rows_so_far)`` threads are fetched while the
    row count is below ``cap``; replies count as rows, so the cap can be
    overshot.  Returns the fetched threads with their ``thread_rank``.
    """
    rank_cols = rank_cols or (F.col("top_likes").desc(), "thread_id")
    ranked = top_n_per_group(threads, ["video_id"], rank_cols, cap, "thread_rank")
    fields = ["thread_rank", *[c for c in threads.columns if c != "video_id"]]
    per_video = ranked.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_t"))

    def state(total: Column, left: Column, kept: Column, done: Column) -> Column:
        return F.struct(total.cast("bigint").alias("total"), left.cast("bigint").alias("left"),
                        kept.cast("bigint").alias("kept"), done.alias("done"))

    init = state(F.lit(0), F.lit(0), F.lit(0), F.lit(False))

    def step(acc: Column, x: Column) -> Column:
        take = acc["total"] + x["n_rows"]
        return (F.when(acc["done"], acc)
                .when(acc["left"] > 0, state(take, acc["left"] - 1, acc["kept"] + 1, F.lit(False)))
                .when(acc["total"] < cap,
                      state(take, F.least(F.lit(page), F.lit(cap) - acc["total"]) - 1,
                            acc["kept"] + 1, F.lit(False)))
                .otherwise(state(acc["total"], F.lit(0), acc["kept"], F.lit(True))))

    # the fold tells how many threads were fetched; those are the answer, so nothing is joined back
    fetched = F.slice("_t", F.lit(1), F.aggregate("_t", init, step)["kept"].cast("int"))
    return per_video.select("video_id", F.inline(fetched)).select(*threads.columns, "thread_rank")


def fetched_comment_rows(comments: DataFrame, fetched_threads: DataFrame,
                         collect_replies: bool = True) -> DataFrame:
    """Comment rows of fetched threads: the top comment and, if collected, its replies."""
    return ((comments if collect_replies else comments.where("turn = 0"))
            .join(fetched_threads.select("video_id", "thread_id", "reply_count"),
                  ["video_id", "thread_id"])
            .withColumn("reply_count", F.when(F.col("turn") == 0, F.col("reply_count"))
                        .otherwise(F.lit(0)).cast("bigint")))


def budget_soft(per_video: DataFrame, target: int = K.TOTAL_TARGET,
                order_cols: Sequence[Column | str] = ("channel_idx", "video_rank", "video_id"),
                count_col: str = "n_rows") -> DataFrame:
    """Videos processed under a soft global target.

    A video is processed iff the rows of all videos before it (in channel,
    then listing order) are still below ``target``; the last processed video
    may overshoot.  Returns processed videos with ``rows_before``.
    """
    with_prefix = exclusive_running_sum(per_video, order_cols, count_col, "rows_before")
    return with_prefix.where(F.col("rows_before") < target)


def reply_counts(comments: DataFrame) -> DataFrame:
    """Replies per thread (total, not just those embedded)."""
    return comments.groupBy("thread_id").agg(
        F.count(F.when(F.col("turn") > 0, 1)).cast("bigint").alias("reply_count"))


def enrich_comments(comments: DataFrame, videos: DataFrame, channels: DataFrame,
                    block: K.ScriptBlock = K.TELUGU) -> DataFrame:
    """J1 + P10: comment x video x channel with the code-mix score (raw_comments schema).

    The configured channel name wins over any name carried by the payload.
    """
    if "reply_count" in comments.columns:
        base = comments  # already carries the thread totals (e.g. from a payload)
    else:
        # counts meet the ids of top rows; texts are joined once, on the comment id
        heads = (comments.where(F.col("turn") == 0).select("comment_id", "thread_id").join(reply_counts(comments), "thread_id")
                 .groupBy("comment_id").agg(F.max("reply_count").alias("_replies")))
        base = comments.join(heads, "comment_id", "left").withColumn(
            "reply_count", F.when(F.col("turn") == 0, F.coalesce("_replies", F.lit(0))).otherwise(F.lit(0)).cast("bigint"))
    v = videos.select("video_id", "channel_idx", "video_title",
                      F.col("published_at").alias("video_published_at"))
    joined = base.join(v, "video_id").join(channels, "channel_idx")
    score = T.code_mix_score(F.coalesce("text", F.lit("")), block)     # a missing text has no score: 0 and false
    return joined.select(
        "comment_id", "parent_id", "video_id", "text", "author", "like_count", "published_at",
        "reply_count", "channel_name", "channel_id", "video_title", "video_published_at",
        score["has_telugu_script"].alias("has_telugu_script"),
        score["script_mix_ratio"].alias("script_mix_ratio"),
        score["roman_telugu_hits"].alias("roman_telugu_hits"),
        score["is_tenglish"].alias("is_tenglish"),
    )


def reply_to_parent(comments: DataFrame) -> DataFrame:
    """Every reply joined to its parent comment (self equi-join)."""
    r = comments.where(F.col("parent_id").isNotNull()).select(
        F.col("comment_id").alias("reply_id"), "parent_id", F.col("text").alias("reply_text"))
    # replies are never parents
    p = comments.where(F.col("parent_id").isNull()).select(
        F.col("comment_id").alias("parent_id"), F.col("text").alias("parent_text"),
                        F.col("author").alias("parent_author"))
    return r.join(p, "parent_id")


def collect_comment_rows(videos: DataFrame, comments: DataFrame, channels: DataFrame,
                         videos_per_channel: int = K.VIDEOS_PER_CHANNEL, rows_per_video: int = K.ROWS_PER_VIDEO,
                         page: int = K.PAGE_SIZE, target: int = K.TOTAL_TARGET, collect_replies: bool = True,
                         block: K.ScriptBlock = K.TELUGU):
    """Listing cut (W1) -> paged soft cap (W3) -> soft budget (W4) -> rows + score.

    Returns ``(processed videos with rows_before, collected comment rows)``.
    The fetched threads are bounded (<= ``rows_per_video`` per video) and
    used twice, so they are written once: the pass over all comments runs once.
    """
    listed = recent_videos_per_channel(videos, videos_per_channel)
    own = comments.join(listed.select("video_id"), "video_id", "left_semi")
    fetched = materialize(paged_soft_cap(thread_rows(own, collect_replies),
                                         rows_per_video, page), "fetched_threads")
    per_video = fetched.groupBy("video_id").agg(F.sum("n_rows").cast("bigint").alias("n"))
    pv = (listed.join(per_video, "video_id", "left")
          .select("video_id", "channel_idx", "video_rank",
                  F.coalesce("n", F.lit(0)).cast("bigint").alias("n_rows")))
    done = budget_soft(pv, target, ("channel_idx", "video_rank", "video_id"))
    threads = fetched.join(done.select("video_id"), "video_id", "left_semi")
    rows = fetched_comment_rows(comments, threads, collect_replies)
    return done, enrich_comments(rows, videos, channels, block)


# --- posts ------------------------------------------------------------------

def min_text_length(text: Column, n: int = K.MIN_POST_CHARS) -> Column:
    """a post is kept only if its trimmed text has at least ``n`` characters."""
    return F.coalesce(F.length(T.unicode_trim(text)) >= n, F.lit(False))


def dedup_posts(posts: DataFrame, order_col: str = "ord", min_chars: int = K.MIN_POST_CHARS) -> DataFrame:
    """F5 + D2: first post per (account, post id) among posts long enough.

    The same id may remain under two accounts.  Partial aggregation makes a
    hot account cost one row per (id, partition) on the wire.
    """
    cols = posts.columns
    ok = posts.where(min_text_length(F.col("text"), min_chars))
    firsts = ok.groupBy("username", "post_id").agg(
        F.min_by(F.struct(*cols), F.struct(F.col(order_col).isNull(), F.col(order_col))).alias("_row"))
    return firsts.select("_row.*")


def cap_posts_per_account(posts: DataFrame, cap: int = K.POSTS_PER_ACCOUNT,
                          order_col: str = "ord") -> DataFrame:
    """At most ``cap`` posts per account, in arrival order, with ``post_rank``."""
    return top_n_per_group(posts, ["username"], [F.col(order_col)], cap, "post_rank")


def budget_hard(capped: DataFrame, target: int = K.TOTAL_TARGET,
                account_order: Sequence[str] = ("account_idx", "username")) -> DataFrame:
    """Hard global target; account k may take ``min(cap, target - rows_before)`` posts.

    ``capped`` is the output of :func:`cap_posts_per_account`.  With
    ``c`` = posts an account yields under its own cap and ``S`` the sum of
    ``c`` over earlier accounts, the account keeps ``least(c, max(0, target - S))``.
    """
    # capped rows are bounded (<= cap per account) and read twice: write them once
    capped = materialize(capped, "capped_posts")
    per_acc = capped.groupBy(*account_order).agg(F.count(F.lit(1)).cast("bigint").alias("c"))
    pref = exclusive_running_sum(per_acc, list(account_order), "c", "rows_before")
    allowed = pref.select(*account_order, F.least(
        F.col("c"), F.greatest(F.lit(0), F.lit(target) - F.col("rows_before"))).alias("_allowed"))
    return (capped.join(allowed, list(account_order))
            .where(F.col("post_rank") <= F.col("_allowed")).drop("_allowed"))


def stamp_posts(posts: DataFrame, scraped_at: Column, block: K.ScriptBlock = K.TELUGU) -> DataFrame:
    """The raw_tweets schema from archived post rows."""
    pid = T.fallback_id(T.permalink_id(F.col("href")), F.col("text"))

    def stat(name: str) -> F.Column:
        # a stat the archived page does not show is missing, i.e. "0"
        return F.col(name) if name in posts.columns else F.lit(None).cast("string")

    return posts.select(
        pid.alias("tweet_id"),
        F.col("username").alias("source_account"),
        T.unicode_trim(F.col("text")).alias("text"),
        F.coalesce(F.col("date"), F.lit("")).alias("date"),
        T.default_stat(stat("likes")).alias("likes"),
        T.default_stat(stat("retweets")).alias("retweets"),
        T.default_stat(stat("replies")).alias("replies"),
        T.stat_number(stat("likes")).alias("likes_n"),
        T.is_code_mixed(F.col("text"), block).alias("is_tenglish"),
        scraped_at.alias("scraped_at"),
    )


# --- unions and schema alignment ---------------------------------------------

SCORE_DEFAULTS = {"is_tenglish": False, "has_telugu_script": False,
                  "roman_telugu_hits": 0, "script_mix_ratio": 0.0}


def backfill_columns(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Add missing score columns (``is_*``/``has_*`` -> False, others -> 0)."""
    defaults = defaults or SCORE_DEFAULTS
    missing = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name; columns missing on one side become null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def union_comments_posts(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Comments and posts viewed as one (kind, item_id, source, date, text, flag)."""
    c = comments.select(F.lit("comment").alias("kind"), F.col("comment_id").cast("string").alias("item_id"),
                        T.coalesce_source(F.col("channel_name"), F.lit(None).cast("string")).alias("source"),
                        T.date_part(F.col("published_at"), F.lit(None).cast("string")).alias("date"),
                        F.col("text"), F.col("is_tenglish").alias("flag"))
    p = posts.select(F.lit("post").alias("kind"), F.col("tweet_id").cast("string").alias("item_id"),
                     T.coalesce_source(F.lit(None).cast("string"), F.col("source_account")).alias("source"),
                     T.date_part(F.lit(None).cast("string"), F.col("date")).alias("date"),
                     F.col("text"), F.col("is_tenglish").alias("flag"))
    return c.unionByName(p)
