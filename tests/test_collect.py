"""Caps and budgets checked against plain loops (the reference's sequential semantics)."""

import random

from pyspark.sql import functions as F

from corpusforge.operators import collect as L
from corpusforge.operators.prefix import exclusive_running_sum


def py_paged(n_rows, cap, page):
    """Threads fetched by the paged loop: pages while rows < cap, page = min(page, cap - rows)."""
    total = kept = 0
    while total < cap and kept < len(n_rows):
        size = min(page, cap - total)
        for x in n_rows[kept:kept + size]:
            total += x
            kept += 1
    return kept


def test_paged_soft_cap_matches_loop(spark):
    rnd = random.Random(7)
    rows, expect = [], {}
    for v in range(60):
        n = [1 + rnd.choice([0, 0, 1, 5]) for _ in range(rnd.randint(0, 30))]
        for i, x in enumerate(n):
            rows.append((v, v * 1000 + i, -i, x))
        expect[v] = py_paged(n, 12, 5)
    df = spark.createDataFrame(rows, "video_id long, thread_id long, top_likes long, n_rows long")
    got = {r.video_id: r.n for r in L.paged_soft_cap(df, 12, 5).groupBy("video_id").count()
           .withColumnRenamed("count", "n").collect()}
    assert {v: k for v, k in expect.items() if k} == got


def test_prefix_sum_matches_cumsum(spark):
    rnd = random.Random(3)
    vals = [(i, rnd.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(vals, "k long, v long").repartition(7)
    got = {r.k: r.prefix_before for r in exclusive_running_sum(df, ["k"], "v").collect()}
    run = 0
    for k, v in vals:
        assert got[k] == run
        run += v


def test_budget_hard_matches_loop(spark):
    rnd = random.Random(11)
    rows, avail = [], {}
    for a in range(12):
        n = rnd.randint(0, 40)
        avail[a] = n
        rows += [(a, f"u{a}", a * 1000 + j, j) for j in range(n)]
    df = spark.createDataFrame(rows, "account_idx int, username string, ord long, post_id long")
    capped = L.cap_posts_per_account(df, 20)
    got = {r.account_idx: r["count"] for r in L.budget_hard(capped, 150).groupBy("account_idx").count().collect()}
    total, expect = 0, {}
    for a in range(12):
        if total >= 150:
            break
        take = min(min(20, 150 - total), avail[a])
        total += take
        if take:
            expect[a] = take
    assert got == expect and sum(got.values()) == min(150, sum(min(20, n) for n in avail.values()))


def test_budget_soft_overshoots(spark):
    df = spark.createDataFrame([(0, 1, 1, 120), (0, 2, 2, 120), (1, 1, 3, 0), (1, 2, 4, 50), (2, 1, 5, 10)],
                               "channel_idx int, video_rank int, video_id long, n_rows long")
    kept = {r.video_id for r in L.budget_soft(df, 200).collect()}
    assert kept == {1, 2}        # 120 < 200 before video 2, 240 >= 200 after it


def test_dedup_posts_per_account(spark):
    df = spark.createDataFrame([("a", 1, 1, "x" * 12), ("a", 2, 1, "y" * 12), ("b", 3, 1, "z" * 12),
                                ("a", 4, 2, "short")], "username string, ord long, post_id long, text string")
    got = sorted((r.username, r.post_id, r.ord) for r in L.dedup_posts(df).collect())
    assert got == [("a", 1, 1), ("b", 1, 3)]


def test_recent_videos_top_n(spark):
    df = spark.createDataFrame([(i, i % 2, f"2024-01-{i + 1:02d}") for i in range(10)],
                               "video_id long, channel_idx int, published_at string")
    got = sorted((r.channel_idx, r.video_id) for r in L.recent_videos_per_channel(df, 2).collect())
    assert got == [(0, 6), (0, 8), (1, 7), (1, 9)]


def _plan(df):
    import contextlib
    import io
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_missing_text_scores_nothing_and_counts_carry_no_text(spark):
    comments = spark.createDataFrame(
        [("t", None, 1, 5, 0, None, "a", 1, "2024"), ("r1", "t", 1, 5, 1, "bagundi bro", "b", 1, "2024"), ("r2", "t", 1, 5, 2, None, "b", 1, "2024"),
         ("t", None, 1, 5, 0, "the same id again", "a", 1, "2024"), (None, None, 1, 6, 0, "no id", "a", 1, "2024")],
        "comment_id string, parent_id string, video_id long, thread_id long, turn int, text string, author string, like_count long, published_at string")
    videos = spark.createDataFrame([(1, 0, "v", "2024")], "video_id long, channel_idx int, video_title string, published_at string")
    channels = spark.createDataFrame([(0, "c", "UC")], "channel_idx int, channel_name string, channel_id string")
    out = L.enrich_comments(comments, videos, channels)
    got = sorted((r.comment_id or "", r.reply_count, r.roman_telugu_hits, r.is_tenglish) for r in out.collect() if r.text is None)
    assert got == [("r2", 0, 0, False), ("t", 2, 0, False)]
    assert out.count() == 5
    for line in _plan(out).splitlines():
        assert not ("Exchange hashpartitioning(thread_id" in line and "text" in line)


def test_soft_cap_is_one_window_and_no_join(spark):
    threads = spark.createDataFrame([(1, i, 3, i % 5, 4) for i in range(30)], "video_id long, thread_id long, reply_count long, top_likes long, n_rows long")
    kept = L.paged_soft_cap(threads, 10, 2)
    plan = _plan(kept)
    assert plan.count("Window [") == 1 and "Join" not in plan
    assert kept.columns == [*threads.columns, "thread_rank"] and kept.count() == 4     # two pages of two threads: 16 rows, over the cap
