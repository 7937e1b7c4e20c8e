"""Main text of web pages by nearest-URL page differencing.

A page is cut into blocks of text with the structure they stand in.  Within each host the pages are ranked by
URL path (those with equal lines at one rank, the first of their paths), and each is paired with its neighbours
in that order.  The lines of a pair (blocks, in page
order) are aligned by their longest common subsequence; shared lines are the host's furniture and are deleted
from the candidates for the main text.  Structure decides where differencing cannot: what a page marks as its
article (``article``, ``main``) is the candidate if there is one, and lines inside it are never deleted only for
being shared (copies of an article on one host share them all); menus, headers, footers, asides, forms,
scripts, styles, notices, adverts and reader comments are no candidates wherever they stand.

The pairing works on 64-bit line hashes: ranks come from a distributed running count, so a host with a third of
all pages is no single group.  Nulls and empty pages give an empty text; repeated rows (same page_id) give the
same text each; a null or malformed url is a host of its own.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import exclusive_running_sum
from ..session import materialize
from .common import map_batches
from .decontam import common_subsequence
from .urlfilter import host_of, path_of

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*(?:>|(?=<)|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)", re.S)
QUOTE_OR_END = re.compile(r"[>\"']")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "object", "xmp"}
DROP = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head"} | RAW
MAIN = {"article", "main"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
          "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
          "var", "wbr", "nobr", "acronym", "picture", "source", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: a new block of this kind ends an open one of the same kind
ENDS_ITSELF = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"},
               "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
P_ENDS_AT = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4",
             "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", "figure"}
#: names of what is not main text, as words of a class or id; on their own, last in a compound (``cookie-notice``), or before a holder
FURNITURE = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist",
             "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation",
             "newsletter", "notice", "pagination", "popup", "promo", "related", "replies", "share", "sharing", "sidebar", "social", "sponsor",
             "sponsored", "subscribe", "toolbar", "widget"}
HOLDERS = {"area", "bar", "block", "body", "bottom", "box", "container", "content", "inner", "item", "items", "left", "links", "list", "main",
           "outer", "panel", "posts", "primary", "right", "row", "secondary", "section", "slot", "top", "unit", "widgets", "wrap", "wrapper"}
#: a compound with one of these tells a page's state (``no-sidebar``), not what the element is
STATES = {"disabled", "fixed", "has", "hidden", "is", "no", "not", "off", "on", "open", "sticky", "with", "without"}
#: elements that are never furniture by their class: they hold the main text
HOLD_ALL = {"html", "body", "main", "article"}
ATTRIBUTE = re.compile(r"(?<![^\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"}
NEAR = 0.8      # neighbours that share more of the candidate lines than this are copies and tell nothing


def _names_furniture(word: str) -> bool:
    parts = [x for x in re.split(r"[-_]+", word.lower()) if x]
    if not parts or STATES.intersection(parts):
        return False
    return parts[-1] in FURNITURE or (parts[0] in FURNITURE and all(x in HOLDERS or x in FURNITURE or x.isdigit() for x in parts[1:]))


def _furniture(attributes: str) -> bool:
    if "=" not in attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        words = (m[2] or m[3] or m[4] or "").split()
        if m[1].lower() == "role":
            if any(w.lower() in ROLES for w in words):
                return True
        elif any(_names_furniture(w) for w in words):
            return True
    return False


def tag_end(page: str, at: int, whole: bool) -> int:
    """Where a tag ends (the place of its ``>``), quoted values passed over; -1 if it doesn't.

    ``whole`` False: at the next ``>`` or before the next ``<``, whatever is quoted.  A page with a quote that is never closed is read
    that way from there on, so that no part of it is searched again and again.
    """
    if not whole:
        ends = [x for x in (page.find(">", at), page.find("<", at) - 1) if x >= at - 1 and x != -2]
        return min(ends, default=len(page))
    while m := QUOTE_OR_END.search(page, at):
        if m[0] == ">":
            return m.start()
        at = page.find(m[0], m.end()) + 1
        if not at:
            break
    return -1


def blocks_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, number of the marked article it lies in, may be main text) of each block with text, in page order.

    0: in none; 1: in ``main`` but in no ``article``; from 2: the outermost ``article`` elements of the page.
    """
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool, bool]] = []         # open elements: name, is article, is furniture
    buffer: list[str] = []
    at, n, article, furniture, inside, articles, whole = 0, len(page), 0, 0, 0, 1, True

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append((text, (articles if inside else 1) if article else 0, furniture == 0))

    def close(to: int) -> None:
        nonlocal article, furniture, inside
        flush()
        for name, a, f in stack[to:]:
            article -= a
            inside -= a and name == "article"
            furniture -= f
        del stack[to:]

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        end = tag_end(page, at, whole)
        if end < 0:
            whole, end = False, tag_end(page, at, False)
        attributes, at = page[at:end], end + 1
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            else:
                if name not in INLINE:
                    flush()
            continue
        if name in RAW:
            if name not in INLINE:
                flush()
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in INLINE:
            if name == "br":
                buffer.append(" ")
            elif name not in VOID and _furniture(attributes):
                flush()
                stack.append((name, False, True))
                furniture += 1
            continue
        flush()
        if name in VOID:
            continue
        ends = ENDS_ITSELF.get(name, set()) | ({"p"} if name in P_ENDS_AT else set())
        for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
            if stack[k][0] in ends:
                close(k)
                break
            if stack[k][0] in ("ul", "ol", "table", "article", "div"):
                break
        if attributes.endswith("/"):
            continue
        is_article = name in MAIN and not furniture
        is_furniture = name in DROP or name not in HOLD_ALL and _furniture(attributes)
        stack.append((name, is_article and not is_furniture, is_furniture))
        article += stack[-1][1]
        if is_article and name == "article":
            articles += not inside
            inside += 1
        furniture += is_furniture
    flush()
    return out


def line_hashes(blocks: list[tuple[str, int, bool]]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t, _, _ in blocks]


def shared_lines(own: list[int], candidate: list[bool], other: list[int]) -> set[int]:
    """Indices of ``own`` lines that align with ``other``; none if the candidates show that the pages are copies."""
    if not own or not other:
        return set()
    head = 0
    while head < min(len(own), len(other)) and own[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(own), len(other)) - head and own[-1 - tail] == other[-1 - tail]:
        tail += 1
    middle = common_subsequence(own[head:len(own) - tail], other[head:len(other) - tail])
    shared = set(range(head)) | {head + i for i in middle} | set(range(len(own) - tail, len(own)))
    main = [i for i, c in enumerate(candidate) if c]
    if main and sum(i in shared for i in main) > NEAR * len(main):
        return set()
    return shared


def main_text(blocks: list[tuple[str, int, bool]], shared: set[int]) -> str:
    """The candidate blocks that differencing leaves; inside a marked article all candidates.

    Of several articles beside each other those shorter than half the longest are teasers of other pages and stay out.
    """
    marked = [i for i, (_, a, ok) in enumerate(blocks) if a and ok]
    if marked:
        length: dict[int, int] = {}
        for i in marked:
            length[blocks[i][1]] = length.get(blocks[i][1], 0) + len(blocks[i][0])
        least = max((n for a, n in length.items() if a > 1), default=0) / 2
        return "\n".join(blocks[i][0] for i in marked if blocks[i][1] == 1 or length[blocks[i][1]] >= least)
    left = [t for i, (t, _, ok) in enumerate(blocks) if ok and i not in shared]
    return "\n".join(left)


def page_lines(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(page_id, host, path, lines, candidate): line hashes of each page whose main text differencing can change."""
    def run(batches):
        for pdf in batches:
            cut = [blocks_of(x) for x in pdf["_html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "host": pdf["host"], "path": pdf["path"],
                                "lines": [line_hashes(b) for b in cut],
                                "candidate": [[ok for _, _, ok in b] for b in cut],
                                "marked": [any(a and ok for _, a, ok in b) for b in cut]})

    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    kind = dict(pages.dtypes)["page_id"]
    return map_batches(rows, run, f"page_id {kind}, host string, path string, lines array<long>, "
                                  "candidate array<boolean>, marked boolean")


def shared_with_neighbours(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, shared): per page the indices of the lines that it shares with its neighbours by path."""
    lines = materialize(page_lines(pages, url_col, html_col).dropDuplicates(["page_id"])
                        .withColumn("content", F.xxhash64("lines")), "page_lines")
    # pages of a host with equal lines are one: its neighbours are other pages, not copies of it
    first = F.struct("path", "page_id")
    apart = (lines.groupBy("host", "content").agg(
        F.min(first).alias("first"), F.min_by(F.struct("lines", "candidate"), first).alias("page"))
        .select("host", "content", "first.path", F.col("first.page_id").alias("page_id"), "page.lines", "page.candidate"))
    ranked = exclusive_running_sum(apart.select("host", "content", "path", "page_id", F.lit(1).alias("_one")),
                                   ["host", "path", "page_id"], "_one", "rank").select("host", "content", "rank")
    placed = materialize(apart.join(ranked, ["host", "content"]).select("host", "content", "rank", "lines", "candidate"),
                         "page_ranks")
    pairs = None
    for step in (-1, 1):
        other = placed.select((F.col("rank") + step).alias("rank"), F.col("host").alias("_host"), F.col("lines").alias("_lines"))
        one = placed.join(other, "rank").where(F.col("host") == F.col("_host")).select("host", "content", "lines", "candidate", "_lines")
        pairs = one if pairs is None else pairs.unionByName(one)

    def run(batches):
        for pdf in batches:
            got = [sorted(shared_lines(list(a), list(c), list(b)))
                   for a, c, b in zip(pdf["lines"], pdf["candidate"], pdf["_lines"])]
            yield pd.DataFrame({"host": pdf["host"], "content": pdf["content"], "part": got})

    found = map_batches(pairs, run, "host string, content long, part array<int>")
    shared = (found.groupBy("host", "content")
              .agg(F.array_distinct(F.flatten(F.collect_list("part"))).alias("shared")))   # two at most
    return lines.select("page_id", "host", "content").join(shared, ["host", "content"]).select("page_id", "shared")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = shared_with_neighbours(pages, url_col, html_col).withColumnRenamed("page_id", "_id")
    rows = (pages.select("page_id", F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
            .join(shared, F.col("page_id").eqNullSafe(F.col("_id")), "left").drop("_id"))

    def run(batches):
        for pdf in batches:
            text = [main_text(blocks_of(h), set() if s is None else set(s)) for h, s in zip(pdf["_html"], pdf["shared"])]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text,
                                "n_chars": np.array([len(t) for t in text], dtype="int64")})

    kind = dict(pages.dtypes)["page_id"]
    return map_batches(rows, run, f"page_id {kind}, url string, text string, n_chars long")
