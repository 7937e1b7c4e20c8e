"""Nested API payloads -> flat rows and archived pages -> posts.

Payloads are read with a declared schema (``read.json(schema=...)`` or
``from_json``) and flattened with ``explode``; nothing is parsed in Python.
The ``build_*`` helpers produce payload tables from flat tables (used to
round-trip the driver tables); they group into bounded pages only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import consts as K
from ..functions import text as T

S = T_.StringType()

VIDEO_ITEM = T_.StructType([
    T_.StructField("id", T_.StructType([T_.StructField("videoId", S)])),
    T_.StructField("snippet", T_.StructType([T_.StructField("title", S), T_.StructField("publishedAt", S),
                                             T_.StructField("channelTitle", S)])),
])
VIDEO_LISTING = T_.StructType([T_.StructField("channelId", S),
                               T_.StructField("items", T_.ArrayType(VIDEO_ITEM))])

COMMENT_SNIPPET = T_.StructType([T_.StructField("textDisplay", S), T_.StructField("authorDisplayName", S),
                                 T_.StructField("likeCount", T_.LongType()),
                                 T_.StructField("publishedAt", S)])
COMMENT = T_.StructType([T_.StructField("id", S), T_.StructField("snippet", COMMENT_SNIPPET)])
THREAD_ITEM = T_.StructType([
    T_.StructField("snippet", T_.StructType([T_.StructField("videoId", S),
                                             T_.StructField("topLevelComment", COMMENT),
                                             T_.StructField("totalReplyCount", T_.LongType())])),
    T_.StructField("replies", T_.StructType([T_.StructField("comments", T_.ArrayType(COMMENT))])),
])
THREAD_PAGE = T_.StructType([T_.StructField("items", T_.ArrayType(THREAD_ITEM)),
                             T_.StructField("nextPageToken", S)])


CORRUPT = "_corrupt_record"


def read_payloads(spark, path: str, schema: T_.StructType) -> DataFrame:
    """Read JSON-lines payloads with a declared schema; malformed lines are kept, not fatal.

    A fetch that failed half-way leaves a truncated line: it lands in
    ``_corrupt_record`` (PERMISSIVE mode) instead of failing the job, and the
    rows fetched before it still flow through.
    """
    full = T_.StructType(schema.fields + [T_.StructField(CORRUPT, S)])
    return (spark.read.schema(full).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def parse_payload(df: DataFrame, col: str, schema: T_.StructType) -> DataFrame:
    """JSON text column -> the declared payload struct's fields (``from_json``; malformed text -> null row)."""
    parsed = F.from_json(F.col(col), schema, {"mode": "PERMISSIVE"})
    # 0/1-element array + inline: the JSON is parsed once (a Filter on the
    # parsed column would be evaluated separately from the projection).
    return df.select(F.inline(F.filter(F.array(parsed), lambda p: p.isNotNull())))


def payload_text(df: DataFrame) -> DataFrame:
    """Payload rows -> one JSON text column ``payload`` (what an API call returns)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("payload"))


def valid_payloads(df: DataFrame) -> DataFrame:
    """Only the well-formed payloads (corrupt-record column dropped)."""
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


# --- S2 ----------------------------------------------------------------------

def build_video_listing(videos: DataFrame, channels: DataFrame, page: int = 50) -> DataFrame:
    """Listing payloads, one per (channel, page of ``page`` video ids)."""
    item = F.struct(F.struct(F.col("video_id").cast("string").alias("videoId")).alias("id"),
                    F.struct(F.col("video_title").alias("title"), F.col("published_at").alias("publishedAt"),
                             F.col("channel_name").alias("channelTitle")).alias("snippet"))
    return (videos.join(channels, "channel_idx")
            .groupBy("channel_id", F.floor(F.col("video_id") / page).alias("_page"))
            .agg(F.collect_list(item).alias("items"))
            .select(F.col("channel_id").alias("channelId"), "items"))


def flatten_video_listing(payload: DataFrame) -> DataFrame:
    """Listing payload -> (channel_id, video_id, video_title, published_at, channel_name); no items -> no rows."""
    it = payload.select("channelId", F.explode(F.coalesce(
        "items", F.array().cast(T_.ArrayType(VIDEO_ITEM)))).alias("it"))
    return it.select(F.col("channelId").alias("channel_id"), F.col("it.id.videoId").alias("video_id"), F.col("it.snippet.title").alias("video_title"),
                     F.col("it.snippet.publishedAt").alias("published_at"),
                     F.col("it.snippet.channelTitle").alias("channel_name"))


# --- S3 ----------------------------------------------------------------------

def _comment(prefix: str = "") -> F.Column:
    return F.struct(F.col(f"{prefix}comment_id").alias("id"),
                    F.struct(F.col(f"{prefix}text").alias("textDisplay"),
                             F.col(f"{prefix}author").alias("authorDisplayName"),
                             F.col(f"{prefix}like_count").alias("likeCount"),
                             F.col(f"{prefix}published_at").alias("publishedAt")).alias("snippet"))


def build_thread_pages(comments: DataFrame, replies_per_item: int = K.PAGE_SIZE, page: int = K.PAGE_SIZE) -> DataFrame:
    """Thread payload pages that hold every comment once.

    An item carries a thread's top comment and at most ``replies_per_item``
    replies; further replies follow in continuation items, whose top comment
    is only named by its id.  So no array grows with a thread, and a page
    holds at most ``page`` items (grouped by thread id range).
    """
    part = F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / replies_per_item)).otherwise(F.lit(0))
    per_item = (comments.withColumn("_part", part).groupBy("video_id", "thread_id", "_part").agg(
        F.max(F.coalesce("parent_id", "comment_id")).alias("top_id"),
        F.max_by(_comment(), F.when(F.col("turn") == 0, F.lit(1))).alias("top"),
        F.sort_array(F.collect_list(F.when(F.col("turn") > 0,
                                           F.struct(F.col("turn"), _comment().alias("c"))))).alias("_r")))
    totals = comments.groupBy("thread_id").agg(F.count(F.when(F.col("turn") > 0, 1)).cast("bigint").alias("total"))
    top = F.struct(F.coalesce("top.id", "top_id").alias("id"), F.col("top.snippet").alias("snippet"))
    item = F.struct(
        F.struct(F.col("video_id").cast("string").alias("videoId"), top.alias("topLevelComment"),
                 F.col("total").alias("totalReplyCount")).alias("snippet"),
        F.struct(F.transform("_r", lambda x: x["c"]).alias("comments")).alias("replies"))
    return (per_item.join(totals, "thread_id")
            .groupBy("video_id", F.floor(F.col("thread_id") / page).alias("_page"), "_part")
            .agg(F.collect_list(item).alias("items"))
            .select("items", F.lit(None).cast("string").alias("nextPageToken")))


def flatten_threads(pages: DataFrame, collect_replies: bool = True) -> DataFrame:
    """S3: one row per top-level comment (parent null, reply_count = total) plus one per embedded reply.

    Replies are emitted only when collected and the thread reports replies;
    a missing ``replies`` field yields none.  A continuation item, whose top
    comment has no snippet, emits its replies only.  ``thread_id`` is the top
    comment's id on every row of a thread; ``turn`` is 0 on the top comment and
    the place among its item's replies (from 1) on the others, as the paged
    collection needs them.
    """
    items = pages.select(F.explode("items").alias("it"))
    top = F.col("it.snippet.topLevelComment")
    total = F.col("it.snippet.totalReplyCount")
    vid = F.col("it.snippet.videoId")

    def row(c, parent, rc, turn):
        return F.struct(c["id"].alias("comment_id"), parent.alias("parent_id"), vid.alias("video_id"),
                        top["id"].alias("thread_id"), turn.cast("int").alias("turn"), c["snippet"]["textDisplay"].alias("text"),
                        c["snippet"]["authorDisplayName"].alias("author"),
                        c["snippet"]["likeCount"].alias("like_count"),
                        c["snippet"]["publishedAt"].alias("published_at"),
                        rc.cast("bigint").alias("reply_count"))

    top_row = F.filter(F.array(row(top, F.lit(None).cast("string"), total, F.lit(0))), lambda _: top["snippet"].isNotNull())
    replies = F.coalesce(F.col("it.replies.comments"), F.array().cast(T_.ArrayType(COMMENT)))
    reply_rows = F.transform(replies, lambda r, i: row(r, top["id"], F.lit(0), i + 1))
    if collect_replies:
        rows = F.when(total > 0, F.concat(top_row, reply_rows)).otherwise(top_row)
    else:
        rows = top_row
    return items.select(F.explode(rows).alias("r")).select("r.*")


# --- S4 ----------------------------------------------------------------------

# Fixed values of the archived markup: what marks a post's text element and its three statistics.
TEXT_MARK = 'data-testid="tweetText"'
STATS = {"likes": "like", "retweets": "retweet", "replies": "reply"}
# Elements that stand on lines of their own, and the character references that are decoded besides numeric ones.
BLOCKS = ("address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|h[1-6]|header|hr|li|main|nav|ol|p|pre|"
          "section|table|td|th|tr|ul")
REFERENCES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}


def _after(c: F.Column, mark: str) -> F.Column:
    """What follows the first ``mark`` (nothing if there is none)."""
    at = F.instr(c, mark)
    return F.when(at > 0, F.substring(c, at + len(mark), F.length(c))).otherwise(F.lit(""))


def _tag_attribute(markup: F.Column, tag: str, attribute: str) -> F.Column:
    """An attribute's value in the first start tag that matches ``tag`` ('' if either is missing)."""
    first = F.regexp_extract(markup, f"<{tag}[^<>]*>", 0)
    return F.regexp_extract(first, f'\\s{attribute}="([^"]*)"', 1)


def decode_references(c: F.Column) -> F.Column:
    """Character references as characters: numeric ones and the names in ``REFERENCES``; ``&amp;`` last, so nothing is decoded twice."""
    pieces = F.split(c, "&#(?=[0-9]{1,7};|[xX][0-9a-fA-F]{1,6};)")

    def one(piece: F.Column) -> F.Column:
        code = F.substring_index(piece, ";", 1)
        number = F.when(F.lower(F.substring(code, 1, 1)) == "x", F.conv(F.substring(code, 2, 6), 16, 10)).otherwise(code).cast("int")
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(valid, F.concat(char, _after(piece, ";"))).otherwise(F.concat(F.lit("&#"), piece))

    tail = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))), one)
    text = F.when(F.instr(c, "&#") > 0, F.concat(pieces[0], F.array_join(tail, ""))).otherwise(c)
    for name, char in REFERENCES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def _without_hidden(markup: F.Column) -> F.Column:
    return F.regexp_replace(markup, r"(?s)<!--.*?(?:-->|$)|<script\b.*?(?:</script>|$)|<style\b.*?(?:</style>|$)", "")


def element_inside(markup: F.Column, mark: str) -> F.Column:
    """The whole inside of the element whose start tag holds ``mark``, elements of its own name included (null: no such element)."""
    at = F.instr(markup, mark)
    name = F.regexp_extract(F.substring_index(F.substring(markup, F.lit(1), at - 1), "<", -1), "^[A-Za-z][A-Za-z0-9]*", 0)
    pieces = F.split(_after(F.substring(markup, at, F.length(markup)), ">"), F.concat(F.lit("<(?=/?"), name, F.lit("[\\s>])")))
    # depth after each start or end tag of that name; the element ends where it reaches 0
    state = F.struct(F.lit(0).alias("i"), F.lit(1).alias("depth"), F.lit(0).alias("end"))
    last = F.aggregate(pieces, state, lambda a, x: F.struct(
        (a["i"] + 1).alias("i"),
        F.when(a["i"] == 0, a["depth"]).when(x.startswith("/"), a["depth"] - 1).otherwise(a["depth"] + 1).alias("depth"),
        F.when((a["end"] == 0) & (a["i"] > 0) & x.startswith("/") & (a["depth"] == 1), a["i"]).otherwise(a["end"]).alias("end")))
    inside = F.array_join(F.slice(pieces, F.lit(1), F.when(last["end"] > 0, last["end"]).otherwise(F.size(pieces))), "<")
    return F.when(at > 0, inside)


def post_markup_text(inside: F.Column) -> F.Column:
    """A post's text element without markup: ``<br>`` a line break, its own white space kept; references still to be decoded."""
    lines = F.regexp_replace(inside, r"(?i)<br\s*/?>", "\n")
    return F.regexp_replace(lines, "<[^<>]*>", "")


def article_markup_text(body: F.Column) -> F.Column:
    """An article without markup: one line per block, white space inside a block as one space; references still to be decoded."""
    flat = F.regexp_replace(body, r"[ \t\r\n\f]+", " ")
    lines = F.regexp_replace(flat, rf"(?i) ?</?(?:{BLOCKS})(?:[\s/][^<>]*)?> ?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, "<[^<>]*>", ""), r" *\n[ \n]*", "\n")


def extract_posts(pages: DataFrame) -> DataFrame:
    """Archived page -> one row per post of the page, in page order (``position`` from 1); posts without text are skipped.

    Every ``<article`` starts a post, which goes up to its end tag or the next article.  text = the whole element marked as the
    post's text, or, in articles without that mark, the whole article; id = permalink id when the article links a ``/status/``
    URL, else the last path segment of the page's URL if the article is the page's only one, else the digest of the text;
    account = first path segment of the page's URL (its host if the path is empty); date = ``<time datetime>`` or ''; each of
    the three statistics = the aria-label of its element or '0'.  Work is linear in the page: it is split once, and every
    article is parsed on its own piece.
    """
    pieces = F.split("html", r"(?i)<article(?=[\s>])")
    # What belongs to the page is computed before its articles are exploded: a select with a generator computes its other
    # expressions once per article, on the whole page each time.
    whole = pages.select("page_id", "url", F.size(pieces).alias("_n"), F.regexp_extract("html", r'<html[^>]*lang="([^"]*)"', 1).alias("lang"),
                         F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))).alias("_pieces"))
    arts = whole.select("page_id", "url", "_n", "lang", F.posexplode("_pieces").alias("_p", "_piece"))
    # One projection a step: what a later step uses several times (body, markup-free text) is computed once per article.
    body, raw = F.col("_body"), F.col("_raw")
    marked = F.instr(body, TEXT_MARK) > 0
    link = F.regexp_extract(body, 'href="([^"]*/status/[^"]*)"', 1)
    path = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    steps = (arts.withColumn("_body", _without_hidden(F.substring_index(_after(F.col("_piece"), ">"), "</article", 1)))
             .withColumns({"_inside": F.when(marked, element_inside(body, TEXT_MARK)), "_link": F.nullif(link, F.lit("")), "_path": path})
             .withColumn("_raw", F.when(F.col("_inside").isNotNull(), post_markup_text(F.col("_inside"))).otherwise(article_markup_text(body)))
             .withColumns({"_text": T.unicode_trim(decode_references(raw)), "_href": decode_references(F.col("_link")),
                           "_date": _tag_attribute(body, r"time\b", "datetime"),
                           **{f"_{name}": _tag_attribute(body, f'[^<>]*\\sdata-testid="{mark}"', "aria-label") for name, mark in STATS.items()}}))
    last = F.when(F.col("_n") == 2, F.nullif(F.substring_index("_path", "/", -1), F.lit("")))
    account = F.coalesce(F.nullif(F.split_part(F.col("_path"), F.lit("/"), F.lit(2)), F.lit("")),
                         F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    row = F.struct(
        F.col("page_id"), (F.col("_p") + 1).alias("position"), F.coalesce(T.permalink_id("_href"), last).alias("post_id"),
        account.alias("username"), F.col("_href").alias("href"), F.col("_text").alias("text"), F.col("lang"),
        decode_references(F.col("_date")).alias("date"),
        *[T.default_stat(decode_references(F.col(f"_{name}"))).alias(name) for name in STATS],
        F.regexp_count(body, F.lit("<p[ >]")).cast("bigint").alias("n_paragraphs"))
    # Emit 0 or 1 rows per article from an array instead of a Filter: a filter on the extracted text would be pushed below this
    # projection and run the article expressions a second time.
    kept = steps.select(F.inline(F.filter(F.array(row), lambda r: r["text"] != "")))
    return kept.withColumn("post_id", T.fallback_id("post_id", "text"))


def build_timeline_pages(posts: DataFrame, span: int = 1000) -> DataFrame:
    """Archived account pages in the markup that :func:`extract_posts` reads (one page per account and ``span`` of ``ord``).

    Columns of ``posts``: username, ord, href, text, date, likes, retweets, replies; nulls leave their element out.
    """
    def escaped(c: str) -> F.Column:
        out = F.replace(F.col(c), F.lit("&"), F.lit("&amp;"))
        return F.replace(F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))

    parts = [F.concat(F.lit('<a href="'), escaped("href"), F.lit('"><time datetime="'), escaped("date"), F.lit('"></time></a>')),
             F.concat(F.lit(f'<div lang="te" {TEXT_MARK}><span>'), escaped("text"), F.lit("</span></div>")),
             *[F.concat(F.lit(f'<div role="button" data-testid="{mark}" aria-label="'), escaped(name), F.lit('"></div>'))
               for name, mark in STATS.items()]]
    article = F.concat(F.lit('<article data-testid="tweet"><div>'), *[F.coalesce(p, F.lit("")) for p in parts], F.lit("</div></article>"))
    page = F.floor(F.col("ord") / span).cast("bigint")
    grouped = (posts.select("username", "ord", page.alias("page_no"), article.alias("_a"))
               .groupBy("username", "page_no").agg(F.sort_array(F.collect_list(F.struct("ord", "_a"))).alias("_as")))
    html = F.concat(F.lit('<!DOCTYPE html><html lang="te"><body><main>'), F.array_join(F.transform("_as", lambda x: x["_a"]), ""),
                    F.lit("</main></body></html>"))
    return grouped.select(F.col("page_no").alias("page_id"), F.concat(F.lit("https://x.example/"), "username").alias("url"), html.alias("html"))
