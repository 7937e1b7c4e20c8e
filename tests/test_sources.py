"""Sources and sinks: CSV sentinels and quoting, payload flattening, page extraction, snapshots."""

import hashlib
import json
import os

from corpusforge.session import scratch_path


def local_dir(spark, name):
    """A scratch folder under the checkpoint dir, as (spark path, local path)."""
    path = scratch_path(spark, name)
    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local)
    return path, local
from corpusforge.sources import files as IO
from corpusforge.sources import payloads as PL


def test_csv_round_trip_and_sentinels(spark):
    rows = [("1", 'He said "hi",\nthen left  '), ("2", "NA"), ("3", None), ("4", "null"), ("5", "  ok")]
    df = spark.createDataFrame(rows, "comment_id string, text string")
    path = scratch_path(spark, "t_csv")
    IO.write_corpus_csv(df, path)
    got = {r.comment_id: r.text for r in IO.read_corpus_csv(spark, path, ["comment_id", "text"]).collect()}
    assert got == {"1": 'He said "hi",\nthen left  ', "2": None, "3": None, "4": None, "5": "  ok"}
    batch = {r.comment_id: r.text for r in IO.read_annotation_batch(spark, path, ["comment_id", "text"]).collect()}
    assert batch["1"] == 'He said "hi",\nthen left' and batch["3"] == "" and batch["5"] == "ok"


def test_thread_payload_flatten(spark):
    page = {"items": [
        {"snippet": {"videoId": "v", "totalReplyCount": 7,
                     "topLevelComment": {"id": "t1", "snippet": {"textDisplay": "top", "authorDisplayName": "a",
                                                                 "likeCount": 3, "publishedAt": "2024"}}},
         "replies": {"comments": [{"id": "r1", "snippet": {"textDisplay": "re", "authorDisplayName": "b",
                                                           "likeCount": 0, "publishedAt": "2024"}}]}},
        {"snippet": {"videoId": "v", "totalReplyCount": 0,
                     "topLevelComment": {"id": "t2", "snippet": {"textDisplay": "x", "authorDisplayName": "c",
                                                                 "likeCount": 1, "publishedAt": "2024"}}}}]}
    path, local = local_dir(spark, "t_threads")
    with open(f"{local}/p.json", "w") as f:
        f.write(json.dumps(page))
    pages = spark.read.schema(PL.THREAD_PAGE).json(path)
    got = {r.comment_id: (r.parent_id, r.reply_count) for r in PL.flatten_threads(pages).collect()}
    assert got == {"t1": (None, 7), "r1": ("t1", 0), "t2": (None, 0)}
    no_replies = {r.comment_id for r in PL.flatten_threads(pages, collect_replies=False).collect()}
    assert no_replies == {"t1", "t2"}


def test_listing_without_items(spark):
    df = spark.createDataFrame([("c1", None)], PL.VIDEO_LISTING)
    assert PL.flatten_video_listing(df).count() == 0


POST_PAGE = """<!DOCTYPE html><html lang="te"><body><nav><p>menu</p></nav>
<article data-testid="tweet"><a href="https://x.example/u/status/99?s=1&amp;t=2"><time datetime="2024-05-01T10:00:00Z"></time></a>
<div lang="te" data-testid="tweetText"><span>Fish &amp;amp; <div>nested <div>twice</div></div> chips</span><br>line  2 &#128077;&#x41;&lt;b&gt; </div>
<div aria-label="12 Likes" data-testid="like"></div><button data-testid="retweet" aria-label="1,204 Retweets"></button>
<div data-testid="reply" aria-label=""></div>not text</article>
<article class="x"><!-- <p>hidden</p> --><h1>plain  one</h1><p>two<b>bold</b></p><script>x="<p>no</p>"</script>&#0; &nope; last</article>
<article data-testid="tweet"><div data-testid="tweetText">  </div><time></article>
<ARTICLE data-testid="tweet"><a href="/u/status/7"></a><span data-testid="tweetText">unclosed <i>post"""


def test_every_article_of_a_page_is_a_post(spark):
    df = spark.createDataFrame([(1, "https://x.example/account?x=1", POST_PAGE)], "page_id long, url string, html string")
    rows = PL.extract_posts(df).orderBy("position").collect()
    assert [r.position for r in rows] == [1, 2, 4]
    first, plain, last = rows
    assert (first.post_id, first.href, first.username) == ("99", "https://x.example/u/status/99?s=1&t=2", "account")
    assert first.text == "Fish &amp; nested twice chips\nline  2 \U0001F44DA<b>"
    assert (first.date, first.likes, first.retweets, first.replies) == ("2024-05-01T10:00:00Z", "12 Likes", "1,204 Retweets", "0")
    assert plain.text == "plain one\ntwobold\n&#0; &nope; last" and plain.n_paragraphs == 1
    assert plain.post_id == hashlib.sha256(plain.text.encode()).hexdigest() and plain.date == ""
    assert (last.post_id, last.text, last.likes) == ("7", "unclosed post", "0")


def test_single_article_takes_its_id_from_the_url(spark):
    rows = [(1, "https://e.com/a/b.html?q=1", "<html lang='x'><article><h1> Title </h1><p>a</p></article>"), (2, "https://e.com/", "<article>x y</article>"),
            (3, "https://e.com/c", "<html><article><h1>  </h1></article>"), (4, None, None), (5, "", "<p>no article</p>")]
    got = {r.page_id: r for r in PL.extract_posts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(got) == {1, 2}
    assert (got[1].post_id, got[1].text, got[1].lang, got[1].username) == ("b.html", "Title\na", "", "a")
    assert got[2].post_id == hashlib.sha256(b"x y").hexdigest() and got[2].username == "e.com"


def test_broken_markup_takes_linear_time(spark):
    """Unclosed comments, tags, articles and references of a large page."""
    import time
    html = "<article><p>a" + "<!-- x " * 40_000 + "</article>" + "<article" * 40_000 + "<article>" + "<a b " * 40_000 + "&#12" * 40_000
    df = spark.createDataFrame([(1, "https://e.com/a", html)], "page_id long, url string, html string")
    PL.extract_posts(df.limit(0)).collect()
    start = time.time()
    PL.extract_posts(df).collect()
    assert time.time() - start < 20


def test_timeline_pages_give_the_posts_back(spark):
    """Texts with markup characters and line breaks, missing elements, several pages of an account."""
    rows = [("a", 5, "https://x.example/a/status/5?s=20", 'x < y & "z"\n\nnext  line', "2024-01-01", "3 Likes", None, ""),
            ("a", 2500, "https://x.example/a/status/25?s=20", "  later &lt; page ", "2024-01-02", None, "1", "2"),
            ("b", 6, None, "no link", None, None, None, None), ("b", 7, "https://x.example/b/status/1", None, "d", "1", "1", "1")]
    posts = spark.createDataFrame(rows, "username string, ord long, href string, text string, date string, likes string, retweets string, replies string")
    pages = PL.build_timeline_pages(posts)
    assert pages.count() == 3
    got = {(r.username, r.text): (r.post_id, r.date, r.likes, r.retweets, r.replies) for r in PL.extract_posts(pages).collect()}
    assert got == {("a", 'x < y & "z"\n\nnext  line'): ("5", "2024-01-01", "3 Likes", "0", "0"),
                   ("a", "later &lt; page"): ("25", "2024-01-02", "0", "1", "2"),
                   ("b", "no link"): (hashlib.sha256(b"no link").hexdigest(), "", "0", "0", "0")}


def test_restore_progress_object(spark):
    path, local = local_dir(spark, "t_progress")
    with open(f"{local}/p.json", "w") as f:
        json.dump({"labels": {"3": {"sent": 0, "tox": 1, "sta": 2}}, "cur": 3, "total": 10,
                   "saved_at": "2024"}, f, indent=2)
    rows = IO.restore_progress_object(spark, path).collect()
    assert [(r.key, r.sent, r.tox, r.sta, r.cur) for r in rows] == [("3", 0, 1, 2, 3)]


def test_permissive_payloads_keep_good_pages(spark):
    path, local = local_dir(spark, "t_permissive")
    good = {"channelId": "c1", "items": [{"id": {"videoId": "v1"},
                                          "snippet": {"title": "t", "publishedAt": "2024", "channelTitle": "C"}}]}
    with open(f"{local}/p.json", "w") as f:
        f.write(json.dumps(good) + "\n" + '{"channelId": "c2", "items": [{"id": ' + "\n")
    df = PL.read_payloads(spark, path, PL.VIDEO_LISTING).cache()
    assert df.where(df[PL.CORRUPT].isNotNull()).count() == 1
    rows = PL.flatten_video_listing(PL.valid_payloads(df)).collect()
    assert [(r.video_id, r.channel_name) for r in rows] == [("v1", "C")]


def test_report_text_sink(spark):
    from corpusforge.operators import clean as C
    df = spark.createDataFrame([(1, "a b c", 1), (2, "", 2)], "comment_id long, text string, ord long")
    path, local = local_dir(spark, "t_report")
    IO.write_report_text(C.cleaning_report(df), path + "/r")
    lines = spark.read.text(path + "/r").collect()
    assert any(r.value == "original_count: 2.0" for r in lines)


def test_long_thread_is_split_over_payload_items(spark):
    """Every reply of a long thread comes back once, no item holds more than the bound."""
    rows = [("t", None, 1, 7, 0, "top", "a", 3, "2024-01-01")]
    rows += [(f"r{i}", "t", 1, 7, i, f"reply {i}", "b", 0, "2024-01-02") for i in range(1, 8)]
    comments = spark.createDataFrame(rows, "comment_id string, parent_id string, video_id long, thread_id long, turn int, "
                                           "text string, author string, like_count long, published_at string")
    pages = PL.parse_payload(PL.payload_text(PL.build_thread_pages(comments, replies_per_item=3)),
                                   "payload", PL.THREAD_PAGE)
    assert pages.selectExpr("max(aggregate(items, 0, (m, x) -> greatest(m, size(x.replies.comments))))").first()[0] == 3
    got = {r["comment_id"]: (r["parent_id"], r["text"], r["reply_count"]) for r in PL.flatten_threads(pages).collect()}
    assert PL.flatten_threads(pages).count() == 8
    assert got == {"t": (None, "top", 7)} | {f"r{i}": ("t", f"reply {i}", 0) for i in range(1, 8)}


def test_landing_keeps_cells_names_and_file_order(spark):
    """Two files land in name order, quoted line breaks inside; a data column called ``ord`` passes through untouched."""
    path, local = local_dir(spark, "t_land_src")
    with open(f"{local}/a.csv", "w", encoding="utf-8") as f:
        f.write('comment_id,ord, text \n1,z,"first ""one""\nline"\n2,,NA\n')
    with open(f"{local}/b.csv", "w", encoding="utf-8") as f:
        f.write('comment_id,ord, text \n3,y,  padded \n')
    landing = IO.land_csv(spark, path, scratch_path(spark, "t_land"))
    rows = landing.orderBy(IO.LANDED).collect()
    assert [(r.comment_id, r.ord, r[" text "]) for r in rows] == [("1", "z", 'first "one"\nline'), ("2", None, "NA"), ("3", "y", "  padded ")]
    assert [r[" text "] for r in IO.corpus_rows(landing).orderBy(IO.LANDED).collect()] == ['first "one"\nline', None, "  padded "]
    batch = IO.annotation_rows(landing)
    assert batch.columns == ["comment_id", "ord", "text", IO.LANDED]
    assert [(r.ord, r.text) for r in batch.orderBy(IO.LANDED).collect()] == [("z", 'first "one"\nline'), ("", "NA"), ("y", "padded")]


def test_snapshot_versions_hold_labels_cursor_and_total(spark, monkeypatch):
    monkeypatch.setattr(IO, "LABELS_PER_OBJECT", 2)
    labels = spark.createDataFrame([(0, i, i % 3, 0, 1) for i in range(7)] + [(1, 3, 2, 2, None)],
                                   "annotator int, item long, sent int, tox int, sta int")
    cursors = spark.createDataFrame([(0, 6), (2, 9)], "annotator int, cur long")
    path = scratch_path(spark, "t_snapshots")
    assert IO.snapshot_labels(labels.limit(0), path, "2024-01-01") == 0
    assert IO.restore_labels(spark, path).collect() == []
    assert IO.snapshot_labels(labels, path, "2024-01-02", cursors, 10) == 1
    got = sorted(tuple(r) for r in IO.restore_labels(spark, path).collect())
    assert got == [(0, i, i % 3, 0, 1, 6, 10) for i in range(7)] + [(1, 3, 2, 2, None, 0, 10)]
    assert sorted(tuple(r) for r in IO.restore_cursors(spark, path).collect()) == [
        (0, 6, 10, "2024-01-02"), (1, 0, 10, "2024-01-02"), (2, 9, 10, "2024-01-02")]
    # what a snapshot wrote is read by the reader of progress objects, too
    objects = IO.restore_progress_object(spark, f"{path}/version=1", multi_line=False).collect()
    assert sorted((r.key, r.sent, r.cur, r.total) for r in objects if r.cur == 6) == [(str(i), i % 3, 6, 10) for i in range(7)]


def test_a_page_is_parsed_once_and_not_for_each_of_its_articles(spark):
    """Above the explosion into articles nothing reads the page's markup, so work stays linear in pages of many posts."""
    article = '<article><a href="/a/status/{0}"></a><div data-testid="tweetText">text {0}</div></article>'
    html = '<html lang="te">' + "".join(article.format(i) for i in range(300))
    posts = PL.extract_posts(spark.createDataFrame([(1, "https://x.example/a", html)], "page_id long, url string, html string"))
    lines = posts._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "Generate posexplode" in line)
    assert not [line for line in lines[:at + 1] if "html#" in line]
    got = sorted((r["position"], r["post_id"], r["text"], r["lang"]) for r in posts.collect())
    assert got == [(i + 1, str(i), f"text {i}", "te") for i in range(300)]
