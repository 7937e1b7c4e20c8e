"""The command-line clean job: CSV in, clean CSV + text report out."""

import os

from corpusforge.__main__ import cmd_clean
from corpusforge.session import scratch_path


def test_cli_clean(spark):
    base = scratch_path(spark, "t_cli")
    local = base[len("file:"):] if base.startswith("file:") else base
    os.makedirs(local)
    with open(f"{local}/in.csv", "w", encoding="utf-8") as f:
        f.write('comment_id,text\n1,"A  B c"\n2,"a b C 👍"\n3,NA\n4,"చాలా"\n5,"fake news"\n')
    cmd_clean(spark, f"{base}/in.csv", f"{base}/out")
    report = {r.value.split(": ")[0]: r.value.split(": ")[1] for r in spark.read.text(f"{base}/out/cleaning_report").collect()}
    assert report["final_count"] == "2.0" and report["exact_duplicate"] == "1.0" and report["empty_or_nan"] == "1.0"
    clean = spark.read.options(header="true", multiLine="true", escape='"').csv(f"{base}/out/clean_csv")
    assert sorted(r.comment_id for r in clean.collect()) == ["1", "4"]
    assert set(clean.columns) == {"comment_id", "text", "text_original"}


def test_cli_export(spark):
    import datetime as dt

    from corpusforge.__main__ import cmd_export
    base = scratch_path(spark, "t_cli_export")
    spark.createDataFrame([(1, "a"), (2, "b")], "item long, text string").write.parquet(f"{base}/corpus")
    t0 = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, t0, 1, 0, 0, 1, 2), (2, t0 + dt.timedelta(hours=1), 1, 0, 2, 1, 2)],
                          "event_id long, ts timestamp, item long, annotator int, sent int, tox int, sta int") \
        .write.parquet(f"{base}/labels")
    cmd_export(spark, f"{base}/corpus", f"{base}/labels", f"{base}/out", 0, "ann", "2024-01-05")
    out = {r.item: r for r in spark.read.options(header="true", multiLine="true", escape='"')
           .csv(f"{base}/out/annotated_csv").collect()}
    assert out["1"].sentiment_label == "neutral" and out["1"].annotation_date == "2024-01-05"
    assert out["2"].annotated == "false"
    assert out["2"].sentiment_numeric in (None, "")      # unlabeled: blank cell


def test_cli_card(spark):
    from corpusforge.__main__ import cmd_card
    base = scratch_path(spark, "t_cli_card")
    spark.createDataFrame([("1", "True", "False"), ("2", "True", "True"), ("3", "False", "False")],
                          "comment_id string, is_tenglish string, has_telugu_script string") \
        .write.parquet(f"{base}/comments")
    cmd_card(spark, f"{base}/comments", f"{base}/out")
    r = spark.read.parquet(f"{base}/out/corpus_stats").first()
    assert (r.total, r.tenglish, r.has_script, r.roman_only, r.pct_tenglish) == (3, 2, 1, 1, 66.7)


def test_cli_clean_keeps_file_order_and_columns(spark):
    """The row of the earlier file wins, the output is in file order, and a column called ``ord`` is data like any other."""
    base = scratch_path(spark, "t_cli_order")
    local = base[len("file:"):] if base.startswith("file:") else base
    os.makedirs(f"{local}/in.csv")
    with open(f"{local}/in.csv/1.csv", "w", encoding="utf-8") as f:
        f.write("comment_id,ord,text\n9,10,one good comment\n8,9,two good comments\n")
    with open(f"{local}/in.csv/2.csv", "w", encoding="utf-8") as f:
        f.write("comment_id,ord,text\n1,1,One  good comment\n2,2,three good comments\n")
    cmd_clean(spark, f"{base}/in.csv", f"{base}/out")
    files = sorted(n for n in os.listdir(f"{local}/out/clean_csv") if n.startswith("part-"))
    lines = [x for n in files for x in open(f"{local}/out/clean_csv/{n}", encoding="utf-8").read().splitlines() if not x.startswith('"comment_id"')]
    assert lines == ['"9","10","one good comment","one good comment"', '"8","9","two good comments","two good comments"',
                     '"2","2","three good comments","three good comments"']


def _payloads(spark, base):
    """Two channels; one listing line and one thread line are cut off."""
    import json

    def comment(cid, text, likes=0):
        return {"id": cid, "snippet": {"textDisplay": text, "authorDisplayName": "a", "likeCount": likes, "publishedAt": "2024-02-03T00:00:00Z"}}

    def thread(video, cid, text, replies, likes=0):
        return {"snippet": {"videoId": video, "totalReplyCount": len(replies), "topLevelComment": comment(cid, text, likes)},
                "replies": {"comments": [comment(f"{cid}.{i}", r) for i, r in enumerate(replies)]}}

    def video(vid, day):
        return {"id": {"videoId": vid}, "snippet": {"title": f"title {vid}", "publishedAt": f"2024-01-{day:02}T00:00:00Z", "channelTitle": "payload name"}}

    listings = [{"channelId": "UC2", "items": [video("v3", 3), video("v4", 9)]}, {"channelId": "UC1", "items": [video("v1", 1), video("v2", 2)]},
                {"channelId": "UC9", "items": [video("v9", 1)]}]
    threads = [{"items": [thread("v1", "t1", "చాలా bagundi", ["reply one", "reply two"], 5), thread("v1", "t2", "plain words", [], 1)]},
               {"items": [thread("v2", "t3", "plain words here", ["one"], 0), thread("v4", "t4", "ledu bro", [])]},
               {"items": [thread("v3", "t5", "older video", [])]}, {"items": [thread("v9", "t9", "channel not configured", [])]}]
    local = base[len("file:"):] if base.startswith("file:") else base
    os.makedirs(local)
    for name, rows in (("listings", listings), ("threads", threads)):
        with open(f"{local}/{name}.json", "w", encoding="utf-8") as f:
            f.write("\n".join(json.dumps(r) for r in rows) + '\n{"items": [{"id": \n')
    with open(f"{local}/channels.csv", "w", encoding="utf-8") as f:
        f.write("channel_id,channel_name\nUC1,First\nUC2,Second\n")
    return local


def test_cli_collect(spark):
    """Payload lines to comments, log and card text: newest videos first, channel by channel, until the target is reached."""
    from corpusforge.__main__ import cmd_collect
    from corpusforge.operators import runs as RUN
    base = scratch_path(spark, "t_cli_collect")
    local = _payloads(spark, base)
    cmd_collect(spark, f"{base}/listings.json", f"{base}/threads.json", f"{base}/channels.csv", f"{base}/out", target=6)
    ledger, says = RUN.read_ledger(spark, f"{base}/out/ledger")
    log = [(r.channel, r.video_id, r.total_comments, r.tenglish) for r in ledger.orderBy("position").collect()]
    assert log == [("First", "v2", 2, 0), ("First", "v1", 4, 1), ]      # six rows: the second channel is not begun
    rows = spark.read.parquet(f"{base}/out/comments/version=0").collect()
    assert {(r.comment_id, r.parent_id, r.reply_count) for r in rows} == {
        ("t1", None, 2), ("t1.0", "t1", 0), ("t1.1", "t1", 0), ("t2", None, 0), ("t3", None, 1), ("t3.0", "t3", 0)}
    assert {r.channel_name for r in rows} == {"First"} and says["method"]["target"] == "6"
    text = "".join(open(f"{local}/out/card/{n}", encoding="utf-8").read() for n in sorted(os.listdir(f"{local}/out/card")) if n.startswith("part-"))
    lines = text.splitlines()
    assert [x for x in lines if not x.startswith(" ")] == ["COLLECTION", "SOURCES", "STATISTICS", "DETECTION"]
    assert lines.index("  First:v2  comments: 2") < lines.index("  First:v1  comments: 4") < lines.index("  corpus  total: 6")
    # a second run, without limits and replies, replaces the first one
    cmd_collect(spark, f"{base}/listings.json", f"{base}/threads.json", f"{base}/channels.csv", f"{base}/out", replies=False)
    log = {(r.video_id, r.total_comments) for r in RUN.run_log(spark, f"{base}/out/ledger").collect()}
    assert log == {("v1", 2), ("v2", 1), ("v3", 1), ("v4", 1)}
    assert RUN.read_ledger(spark, f"{base}/out/ledger")[1]["version"] == 1


def test_cli_collect_posts(spark):
    from corpusforge.__main__ import cmd_collect_posts
    base = scratch_path(spark, "t_cli_posts")
    post = '<article data-testid="tweet"><a href="/{0}/status/{1}"></a><div data-testid="tweetText">{2}</div></article>'
    pages = [(1, "https://x.example/alpha", post.format("alpha", 1, "చాలా long enough") + post.format("alpha", 2, "short") +
              post.format("alpha", 1, "the same post again")), (2, "https://x.example/beta", post.format("alpha", 1, "shared by another") +
              post.format("beta", 3, "third text here"))]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{base}/pages")
    cmd_collect_posts(spark, f"{base}/pages", f"{base}/out", target=3)
    posts = spark.read.parquet(f"{base}/out/posts").collect()
    assert sorted((r.source_account, r.tweet_id, r.is_tenglish) for r in posts) == [("alpha", "1", True), ("beta", "1", False), ("beta", "3", False)]
    counts = {r.source_account: r.collected for r in spark.read.parquet(f"{base}/out/accounts").collect()}
    assert counts == {"alpha": 1, "beta": 2, None: 3}


def test_cli_card_of_comments(spark):
    from corpusforge.__main__ import cmd_card
    base = scratch_path(spark, "t_cli_card2")
    spark.createDataFrame([("C", "v1", "t", "2024-01-02", True, False), ("C", "v1", "t", "2024-01-03", False, False), ("D", "v2", "u", "2024-01-01", True, True)],
                          "channel_name string, video_id string, video_title string, published_at string, is_tenglish boolean, has_telugu_script boolean") \
        .write.parquet(f"{base}/comments")
    cmd_card(spark, f"{base}/comments", f"{base}/out", "2024-05-01", "2024-05-02")
    card = {(r.section, r.item, r.metric): r.value for r in spark.read.parquet(f"{base}/out/card_rows").collect()}
    assert card["sources", "C:v1", "comments"] == "2" and card["statistics", "corpus", "roman_only"] == "1"
    assert card["collection", "window", "first_date"] == "2024-05-01" and card["collection", "comments", "last_date"] == "2024-01-03"
