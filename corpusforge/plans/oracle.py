"""DuckDB oracle SQL, one statement per registered query.

Written independently of the Spark code: plain SQL over the driver tables,
with the derived views inlined as CTEs.  RE2 has no lookaround and an ASCII
``\\s``, so character classes are spelled out (same text as ``consts``).
Counts are cast to BIGINT on both sides.
"""

from __future__ import annotations

from ..functions import consts as K
from ..sources import payloads as PL
from . import params as P
from . import views as V

WS = K.WS_CLASS
NWS = "[^" + K.WS_CLASS[1:-1] + "]"
JSWS = K.JS_WS_CLASS
EMO = K.EMOJI_CLASS
BLK = K.TELUGU.char_class
ALPHA = "[A-Za-z\\x{0C00}-\\x{0C7F}]"


def trim(x: str, ws: str = WS) -> str:
    return f"regexp_replace({x}, '^{ws}+|{ws}+$', '', 'g')"


def strip(x: str) -> str:
    return trim(f"regexp_replace({x}, '{EMO}+', '', 'g')")


def words(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{NWS}+')) AS BIGINT)"


def native_n(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{BLK}')) AS BIGINT)"


def nonspace(x: str) -> str:
    return f"CAST(greatest(length(replace({x}, ' ', '')), 1) AS BIGINT)"


def hits(x: str, lex=K.LEXICON_COMMENTS) -> str:
    wl = ", ".join(f"'{w}'" for w in dict.fromkeys(lex))
    return (f"CAST(len(list_filter(string_split_regex(lower({x}), '{K.NON_WORD_CLASS}+'), "
            f"lambda w: w IN ({wl}))) AS BIGINT)")


def key(x: str) -> str:
    return f"regexp_replace(lower({x}), '{WS}+', ' ', 'g')"


def mixed_posts(x: str) -> str:
    return f"(regexp_matches({x}, '{BLK}') OR {hits(x, K.LEXICON_POSTS)} > 0)"


def pct1(x: str, n: str) -> str:
    return f"round(100.0 * ({x}) / greatest({n}, 1), 1)"


def refs(x: str) -> str:
    """Character references decoded: numeric ones, then the few names, ``&amp;`` last."""
    parts = f"string_split(regexp_replace({x}, '&#([0-9]{{1,7}}|[xX][0-9a-fA-F]{{1,6}});', chr(2) || '\\1' || chr(3), 'g'), chr(2))"
    code = "split_part(p, chr(3), 1)"
    char = f"chr(CASE WHEN {code}[1] IN ('x', 'X') THEN CAST('0x' || {code}[2:] AS INT) ELSE CAST({code} AS INT) END)"
    out = f"({parts}[1] || array_to_string(list_transform({parts}[2:], lambda p: {char} || split_part(p, chr(3), 2)), ''))"
    for name, c in PL.REFERENCES.items():
        out = f"replace({out}, '&{name};', chr({ord(c)}))"
    return f"replace({out}, '&amp;', '&')"


def with_views(body: str, *names: str) -> str:
    ctes = ",\n".join(f"{n} AS ({V.DERIVED_VIEWS[n]})" for n in names)
    return f"WITH {ctes}\n{body}" if names else body


def _label_name(code: str, names: dict) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items())
    return f"coalesce(CASE {code} {whens} END, '')"


# Rule chain over corpus_fx: ruled(..., t, st, reason, key) and final(..., final_reason).
RULED = f"""
r0 AS (SELECT *, {trim('text')} AS t FROM corpus_fx),
r1 AS (SELECT *, {strip('t')} AS st FROM r0),
r2 AS (SELECT *, CASE WHEN text IS NULL OR t = '' THEN 'empty_or_nan'
                      WHEN NOT regexp_matches(st, '{ALPHA}') THEN 'emoji_or_symbol_only'
                      WHEN {words('st')} < {K.MIN_WORDS} AND NOT regexp_matches(t, '{BLK}') THEN 'too_short_no_telugu'
                 END AS reason FROM r1),
ruled AS (SELECT *, CASE WHEN reason IS NULL THEN {key('st')} END AS dkey FROM r2),
firsts AS (SELECT dkey, min(ord) AS first_ord FROM ruled WHERE reason IS NULL GROUP BY dkey),
final AS (SELECT ruled.*, CASE WHEN reason IS NOT NULL THEN reason
                               WHEN ord > first_ord THEN 'exact_duplicate' END AS final_reason
          FROM ruled LEFT JOIN firsts USING (dkey)),
clean AS (SELECT comment_id, ord, source, lang, st AS text, t AS text_original FROM final
          WHERE final_reason IS NULL)
"""

LATEST = """
complete AS (SELECT * FROM label_events_fx
             WHERE sent BETWEEN 0 AND 2 AND tox BETWEEN 0 AND 2 AND sta BETWEEN 0 AND 2),
latest AS (SELECT annotator, item, sent, tox, sta, ts, event_id FROM (
             SELECT *, row_number() OVER (PARTITION BY annotator, item ORDER BY ts DESC, event_id DESC) AS rn
             FROM complete) WHERE rn = 1)
"""

ENRICHED = f"""
rc AS (SELECT thread_id, count(*) FILTER (WHERE turn > 0) AS total FROM comments_fx GROUP BY thread_id),
enriched AS (
  SELECT c.comment_id, c.parent_id, c.video_id, c.text, c.author, c.like_count, c.published_at,
         CAST(CASE WHEN c.turn = 0 THEN rc.total ELSE 0 END AS BIGINT) AS reply_count,
         ch.channel_name, ch.channel_id, v.video_title, v.published_at AS video_published_at,
         {native_n('c.text')} > 0 AS has_telugu_script,
         round({native_n('c.text')} / {nonspace('c.text')}, 4) AS script_mix_ratio,
         {hits('c.text')} AS roman_telugu_hits,
         ({native_n('c.text')} > 0 OR round({native_n('c.text')} / {nonspace('c.text')}, 4) >= {K.MIX_RATIO}
          OR {hits('c.text')} >= 1) AS is_tenglish
  FROM comments_fx c JOIN rc USING (thread_id) JOIN videos_fx v USING (video_id)
       JOIN channels_fx ch USING (channel_idx))
"""

STAMPED = f"""
stamped AS (
  SELECT ord, username,
         coalesce(substring_index_last, sha256(text)) AS tweet_id,
         username AS source_account, {trim('text')} AS text,
         coalesce(date, '') AS date, coalesce(nullif(likes, ''), '0') AS likes,
         coalesce(nullif(retweets, ''), '0') AS retweets, coalesce(nullif(replies, ''), '0') AS replies,
         {mixed_posts('text')} AS is_tenglish,
         '{P.SCRAPED_AT}' AS scraped_at
  FROM (SELECT *, split_part(list_last(string_split(href, '/status/')), '?', 1) AS substring_index_last
        FROM posts_fx))
"""

COLLECTED_POSTS = f"""
okp AS (SELECT * FROM posts_fx WHERE coalesce(length({trim('text')}) >= {K.MIN_POST_CHARS}, false)),
dp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY username, post_id ORDER BY ord) AS rn FROM okp)
       WHERE rn = 1),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY username ORDER BY ord) AS post_rank FROM dp)
           WHERE post_rank <= {P.POSTS_PER_ACCOUNT}),
acc AS (SELECT username, count(*) AS c FROM capped GROUP BY username),
accp AS (SELECT *, coalesce(sum(c) OVER (ORDER BY username
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM acc),
collected AS (SELECT capped.* FROM capped JOIN accp USING (username)
              WHERE post_rank <= least(c, greatest(0, {P.TOTAL_TARGET} - before)))
"""

# Collected posts, and all known posts, stamped: same projection as STAMPED over `collected` and `dp`.
KNOWN_STAMPED = STAMPED.replace("stamped AS", "kstamped AS").replace("FROM posts_fx", "FROM dp")
COLLECTED_STAMPED = STAMPED.replace("stamped AS", "cstamped AS").replace("FROM posts_fx", "FROM collected")


def _proj(cols: str) -> str:
    return _q(RULED, f"SELECT comment_id, {cols} FROM ruled", "corpus_fx")


def _q(body_ctes: str, select: str, *views: str) -> str:
    """Query with view CTEs followed by extra CTEs and a final SELECT."""
    ctes = ",\n".join([f"{n} AS ({V.DERIVED_VIEWS[n]})" for n in views] + [body_ctes.strip().rstrip(",")])
    return f"WITH {ctes}\n{select}"


def _distribution_sql(latest_rel: str) -> str:
    cells = []
    for task, code, names in K.TASKS:
        for k, name in names.items():
            cells.append(
                f"SELECT annotator, '{task}' AS task, CAST({k} AS INTEGER) AS code, '{name}' AS label, "
                f"CAST(count(*) FILTER (WHERE {code} = {k}) AS BIGINT) AS n, "
                f"CAST(count(*) AS BIGINT) AS done FROM {latest_rel} GROUP BY annotator")
    u = " UNION ALL ".join(cells)
    return (f"SELECT annotator, task, code, label, n, "
            f"CAST(CASE WHEN done > 0 THEN round(n / done * 100, 0) ELSE 0 END AS BIGINT) AS pct FROM ({u})")


def build() -> dict[str, str]:
    o: dict[str, str] = {}
    L = K.LEXICON_COMMENTS

    # ---- sources / sinks
    na = ", ".join(f"'{s}'" for s in K.NA_SENTINELS)
    o["read_corpus"] = with_views(
        f"SELECT CAST(comment_id AS VARCHAR) AS comment_id, "
        f"CASE WHEN text IN ({na}) THEN NULL ELSE text END AS text FROM corpus_fx", "corpus_fx")
    o["flatten_video_listing"] = with_views(
        "SELECT channel_id, CAST(video_id AS VARCHAR) AS video_id, video_title, published_at, channel_name "
        "FROM videos_fx JOIN channels_fx USING (channel_idx)", "videos_fx", "channels_fx")
    o["flatten_threads"] = _q(
        "rc AS (SELECT thread_id, count(*) FILTER (WHERE turn > 0) AS total FROM comments_fx GROUP BY thread_id)",
        f"SELECT c.comment_id, c.parent_id, CAST(c.video_id AS VARCHAR) AS video_id, "
        f"coalesce(c.parent_id, c.comment_id) AS thread_id, CAST(CASE WHEN c.turn = 0 THEN 0 ELSE row_number() OVER (PARTITION BY "
        f"c.thread_id, c.turn > 0, (c.turn - 1) // {K.PAGE_SIZE} ORDER BY c.turn) END AS INT) AS turn, c.text, c.author, "
        f"c.like_count, c.published_at, CAST(CASE WHEN c.turn = 0 THEN rc.total ELSE 0 END AS BIGINT) AS reply_count "
        "FROM comments_fx c JOIN rc USING (thread_id)", "comments_fx")
    seg = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    attr = lambda tag, name: (f"regexp_extract(regexp_extract(body, '<{tag}[^<>]*>', 0), "  # noqa: E731
                              f"'\\s{name}=\"([^\"]*)\"', 1)")
    stat = lambda mark: f"coalesce(nullif({refs(attr(f'[^<>]*\\sdata-testid=\"{mark}\"', 'aria-label'))}, ''), '0')"
    line = lambda x: (f"regexp_replace(regexp_replace(regexp_replace({x}, "  # noqa: E731
                      f"' ?</?(?:{PL.BLOCKS})(?:[\\s/][^<>]*)?> ?', chr(10), 'gi'), '<[^<>]*>', '', 'g'), ' *\\n[ \\n]*', chr(10), 'g')")
    hidden = "(?s)<!--.*?(?:-->|$)|<script\\b.*?(?:</script>|$)|<style\\b.*?(?:</style>|$)"
    flat = "regexp_replace(body, '[ \\t\\r\\n\\f]+', ' ', 'g')"
    # articles without a marked text element, as all of `pages` are; extract_timeline_posts has the others
    o["extract_posts"] = f"""
    WITH s AS (SELECT page_id, url, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang,
                      string_split(regexp_replace(html, '<article([\\s>])', chr(1) || '\\1', 'gi'), chr(1))[2:] AS arts FROM pages),
    a AS (SELECT page_id, url, lang, len(arts) AS n, unnest(range(1, len(arts) + 1)) AS position, unnest(arts) AS art FROM s),
    b AS (SELECT *, regexp_replace(string_split(substr(art, strpos(art, '>') + 1), '</article')[1], '{hidden}', '', 'g') AS body, {seg} AS path FROM a),
    c AS (SELECT *, {trim(refs(line(flat)))} AS text,
                 {refs("nullif(regexp_extract(body, 'href=\"([^\"]*/status/[^\"]*)\"', 1), '')")} AS href FROM b)
    SELECT page_id, CAST(position AS INT) AS position,
           coalesce(split_part(list_last(string_split(href, '/status/')), '?', 1),
                    CASE WHEN n = 1 THEN nullif(list_last(string_split(path, '/')), '') END, sha256(text)) AS post_id,
           coalesce(nullif(split_part(path, '/', 2), ''), regexp_extract(url, '://([^/?#]*)', 1)) AS username, href, text, lang,
           {refs(attr('time\\b', 'datetime'))} AS date, {stat('like')} AS likes, {stat('retweet')} AS retweets, {stat('reply')} AS replies,
           CAST(len(regexp_extract_all(body, '<p[ >]')) AS BIGINT) AS n_paragraphs
    FROM c WHERE text <> ''"""
    # what the pages were built from, not their markup
    o["extract_timeline_posts"] = with_views(f"""
    SELECT username, CAST(post_id AS VARCHAR) AS post_id, href, {trim('text')} AS text, 'te' AS lang, date,
           coalesce(nullif(likes, ''), '0') AS likes, coalesce(nullif(retweets, ''), '0') AS retweets,
           coalesce(nullif(replies, ''), '0') AS replies
    FROM posts_fx WHERE {trim("coalesce(text, '')")} <> ''""", "posts_fx")
    o["write_corpus"] = _q(RULED, "SELECT * FROM clean", "corpus_fx")
    jt = lambda c: f"coalesce({trim(c, JSWS)}, '') AS {c}"
    o["read_annotation_batch"] = with_views(
        f"SELECT {jt('comment_id')}, {jt('author')}, {jt('published_at')}, {jt('text')} FROM comments_fx",
        "comments_fx")
    exp_cols = []
    for task, code, names in K.TASKS:
        exp_cols.append(f"{_label_name('l.' + code, names)} AS {task}_label")
        exp_cols.append(f"coalesce(CAST(l.{code} AS VARCHAR), '') AS {task}_numeric")
    export = (f"SELECT d.doc_id AS item, d.source, d.lang, d.text, {', '.join(exp_cols)}, "
              f"CASE WHEN l.sent BETWEEN 0 AND 2 AND l.tox BETWEEN 0 AND 2 AND l.sta BETWEEN 0 AND 2 "
              f"THEN 'true' ELSE 'false' END AS annotated, '{P.ANNOTATOR_NAME}' AS annotated_by, "
              f"'{P.EXPORT_DATE}' AS annotation_date "
              f"FROM documents d LEFT JOIN (SELECT * FROM latest WHERE annotator = {P.ANNOTATOR}) l "
              f"ON d.doc_id = l.item")
    o["export_annotations"] = _q(LATEST, export, "label_events_fx")
    o["restore_labels"] = _q(LATEST, """
    SELECT l.annotator, l.item, l.sent, l.tox, l.sta, CAST(c.cur AS BIGINT) AS cur,
           (SELECT CAST(count(*) AS BIGINT) FROM documents) AS total
    FROM latest l JOIN (SELECT annotator, arg_max(item, struct_pack(ts := ts, event_id := event_id)) AS cur FROM complete
                        GROUP BY annotator) c ON l.annotator = c.annotator""", "label_events_fx")
    o["cleaning_report"] = _q(RULED + """,
    tot AS (SELECT count(*) AS original,
                   count(*) FILTER (WHERE final_reason IS NULL) AS kept,
                   count(*) FILTER (WHERE final_reason = 'empty_or_nan') AS e,
                   count(*) FILTER (WHERE final_reason = 'emoji_or_symbol_only') AS s,
                   count(*) FILTER (WHERE final_reason = 'too_short_no_telugu') AS h,
                   count(*) FILTER (WHERE final_reason = 'exact_duplicate') AS d FROM final)""", f"""
    SELECT 'original_count' AS metric, CAST(original AS DOUBLE) AS value FROM tot UNION ALL
    SELECT 'final_count', CAST(kept AS DOUBLE) FROM tot UNION ALL
    SELECT 'total_dropped', CAST(original - kept AS DOUBLE) FROM tot UNION ALL
    SELECT 'pct_dropped', {pct1('original - kept', 'original')} FROM tot UNION ALL
    SELECT 'empty_or_nan', CAST(e AS DOUBLE) FROM tot UNION ALL
    SELECT 'emoji_or_symbol_only', CAST(s AS DOUBLE) FROM tot UNION ALL
    SELECT 'too_short_no_telugu', CAST(h AS DOUBLE) FROM tot UNION ALL
    SELECT 'exact_duplicate', CAST(d AS DOUBLE) FROM tot""", "corpus_fx")

    # ---- projections
    o["unicode_trim"] = _proj("t AS text_trim")
    o["strip_emoji"] = _proj("st AS text_stripped")
    o["has_alpha_content"] = _proj(f"regexp_matches(st, '{ALPHA}') AS has_alpha")
    o["word_count"] = _proj(f"{words('st')} AS n_words")
    o["has_native_script"] = _proj(f"regexp_matches(text, '{BLK}') AS has_native")
    o["dedup_key"] = _proj(f"{key('st')} AS dedup_key")
    o["native_char_count"] = _proj(f"{native_n('text')} AS n_native")
    o["non_space_length"] = _proj(f"{nonspace('text')} AS n_non_space")
    o["lexicon_hits"] = _proj(f"{hits('text', L)} AS hits")
    x = "coalesce(text, '')"
    ratio = f"round({native_n(x)} / {nonspace(x)}, 4)"
    o["code_mix_score"] = with_views(
        f"SELECT comment_id, {native_n(x)} > 0 AS has_telugu_script, {ratio} AS script_mix_ratio, "
        f"{hits(x, L)} AS roman_telugu_hits, "
        f"({native_n(x)} > 0 OR {ratio} >= {K.MIX_RATIO} OR {hits(x, L)} >= 1) AS is_tenglish FROM corpus_fx",
        "corpus_fx")
    o["is_code_mixed"] = _proj(f"{mixed_posts('text')} AS is_mixed")
    pl = "split_part(list_last(string_split(href, '/status/')), '?', 1)"
    o["permalink_id"] = with_views(f"SELECT ord, {pl} AS post_key FROM posts_fx", "posts_fx")
    o["fallback_id"] = with_views(
        f"SELECT ord, coalesce(CASE WHEN likes IS NOT NULL THEN {pl} END, sha256(text)) AS post_key FROM posts_fx",
        "posts_fx")
    o["title_preview"] = with_views("SELECT video_id, substring(video_title, 1, 80) AS title FROM videos_fx",
                                    "videos_fx")
    u2 = _q(ENRICHED + "," + STAMPED + """,
    u2 AS (SELECT 'comment' AS kind, comment_id AS item_id, coalesce(nullif(channel_name, ''), '—') AS source,
                  substring(coalesce(nullif(published_at, ''), ''), 1, 10) AS date, text, is_tenglish AS flag
           FROM enriched
           UNION ALL
           SELECT 'post', tweet_id, coalesce(nullif(source_account, ''), '—'),
                  substring(coalesce(nullif(date, ''), ''), 1, 10), text, is_tenglish FROM stamped)""",
            "SELECT {cols} FROM u2", "comments_fx", "videos_fx", "channels_fx", "posts_fx")
    o["date_part"] = u2.replace("{cols}", "kind, item_id, date")
    o["coalesce_source"] = u2.replace("{cols}", "kind, item_id, source")
    o["union_comments_posts"] = u2.replace("{cols}", "*")
    enr = lambda sel: _q(ENRICHED, sel, "comments_fx", "videos_fx", "channels_fx")
    o["parse_flag"] = enr("SELECT comment_id, coalesce(CAST(is_tenglish AS VARCHAR) IN ('True', 'true', '1'), false)"
                          " AS flag FROM enriched")
    o["ratio_round"] = _proj(f"round({native_n('text')} / {nonspace('text')}, 4) AS script_mix_ratio")
    o["pct_one_dp"] = with_views(
        f"SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE m) AS BIGINT) AS mixed, "
        f"{pct1('count(*) FILTER (WHERE m)', 'count(*)')} AS pct_mixed "
        f"FROM (SELECT source, {mixed_posts(x)} AS m FROM corpus_fx) GROUP BY source", "corpus_fx")
    dist = _distribution_sql("latest")
    o["label_distribution"] = _q(LATEST, dist, "label_events_fx")
    o["pct_int"] = _q(LATEST, f"SELECT annotator, task, code, pct FROM ({dist})", "label_events_fx")
    o["decode_label"] = _q(LATEST, "SELECT annotator, item, " + ", ".join(
        f"{_label_name(code, names)} AS {task}_label" for task, code, names in K.TASKS) + " FROM latest",
        "label_events_fx")
    o["annotation_stamp"] = _q(LATEST, f"SELECT item, annotated, annotated_by, annotation_date FROM ({export})",
                               "label_events_fx")
    o["keep_original_text"] = _q(RULED, "SELECT comment_id, text_original, text FROM clean", "corpus_fx")
    o["backfill_columns"] = _q(ENRICHED + "," + STAMPED, """
    SELECT 'comment' AS kind, comment_id AS item_id, has_telugu_script, script_mix_ratio, roman_telugu_hits, is_tenglish
    FROM enriched UNION ALL
    SELECT 'post', tweet_id, false, 0.0, CAST(0 AS BIGINT), is_tenglish FROM stamped""",
                               "comments_fx", "videos_fx", "channels_fx", "posts_fx")
    o["stamp_source"] = _q(STAMPED, "SELECT tweet_id, source_account, scraped_at FROM stamped", "posts_fx")
    o["default_stat"] = with_views(
        "SELECT ord, coalesce(nullif(likes, ''), '0') AS likes, "
        "coalesce(CAST(nullif(replace(regexp_extract(likes, '([0-9][0-9,]*)', 1), ',', ''), '') AS BIGINT), 0) "
        "AS likes_n FROM posts_fx", "posts_fx")

    # ---- filters
    o["drop_empty"] = with_views(f"SELECT comment_id, (text IS NULL OR {trim('text')} = '') AS is_empty "
                                 f"FROM corpus_fx", "corpus_fx")
    o["drop_symbol_only"] = _proj(f"NOT regexp_matches(st, '{ALPHA}') AS symbol_only")
    o["drop_short_non_native"] = _proj(
        f"({words('st')} < {K.MIN_WORDS} AND NOT regexp_matches(t, '{BLK}')) AS short_non_native")
    o["drop_reason"] = _q(RULED, "SELECT comment_id, final_reason AS drop_reason FROM final", "corpus_fx")
    o["min_text_length"] = with_views(
        f"SELECT ord, coalesce(length({trim('text')}) >= {K.MIN_POST_CHARS}, false) AS long_enough FROM posts_fx",
        "posts_fx")
    o["complete_label"] = with_views(
        "SELECT event_id, coalesce(sent BETWEEN 0 AND 2 AND tox BETWEEN 0 AND 2 AND sta BETWEEN 0 AND 2, false) "
        "AS complete FROM label_events_fx", "label_events_fx")
    o["enabled_sources"] = with_views(
        "SELECT channel_idx, channel_name FROM channels_fx WHERE channel_idx IN (SELECT channel_idx FROM videos_fx)",
        "channels_fx", "videos_fx")

    # ---- joins
    o["enrich_comments"] = enr("SELECT * FROM enriched")
    o["attach_labels"] = _q(LATEST, f"SELECT d.doc_id AS item, l.sent, l.tox, l.sta FROM documents d LEFT JOIN "
                                    f"(SELECT * FROM latest WHERE annotator = {P.ANNOTATOR}) l ON d.doc_id = l.item",
                            "label_events_fx")
    o["unannotated_items"] = _q(LATEST, f"SELECT doc_id AS item FROM documents WHERE doc_id NOT IN "
                                        f"(SELECT item FROM latest WHERE annotator = {P.ANNOTATOR})",
                                "label_events_fx")
    o["reply_to_parent"] = with_views(
        "SELECT r.parent_id, r.comment_id AS reply_id, r.text AS reply_text, p.text AS parent_text, "
        "p.author AS parent_author FROM comments_fx r JOIN comments_fx p ON r.parent_id = p.comment_id",
        "comments_fx")
    pairs = LATEST + """,
    lg AS (SELECT annotator, item, 'sentiment' AS task, sent AS code FROM latest UNION ALL
           SELECT annotator, item, 'toxicity', tox FROM latest UNION ALL
           SELECT annotator, item, 'stance', sta FROM latest),
    pairs AS (SELECT a.item, a.task, CAST(a.code AS INTEGER) AS a, CAST(b.code AS INTEGER) AS b
              FROM lg a JOIN lg b ON a.item = b.item AND a.task = b.task AND a.annotator = 0 AND b.annotator = 1)"""
    o["paired_ratings"] = _q(pairs, "SELECT * FROM pairs", "label_events_fx")
    o["rehydrate"] = with_views(
        "SELECT c.comment_id, d.text, d.text IS NULL AS missing FROM corpus_fx c "
        "LEFT JOIN documents d ON c.comment_id = d.doc_id", "corpus_fx")

    # ---- aggregations
    o["drop_reason_counts"] = _q(RULED, """
    SELECT r.reason AS drop_reason, CAST(count(f.final_reason) AS BIGINT) AS n
    FROM (VALUES ('empty_or_nan'), ('emoji_or_symbol_only'), ('too_short_no_telugu'), ('exact_duplicate')) r(reason)
    LEFT JOIN final f ON f.final_reason = r.reason GROUP BY r.reason""", "corpus_fx")
    o["cleaning_summary"] = _q(RULED, f"""
    SELECT CAST(count(*) AS BIGINT) AS original,
           CAST(count(*) FILTER (WHERE final_reason IS NULL) AS BIGINT) AS final,
           CAST(count(*) FILTER (WHERE final_reason IS NOT NULL) AS BIGINT) AS dropped,
           {pct1('count(*) FILTER (WHERE final_reason IS NOT NULL)', 'count(*)')} AS pct_dropped
    FROM final""", "corpus_fx")
    per_video = ENRICHED + """,
    pv AS (SELECT ch.channel_name AS channel, v.video_id, substring(v.video_title, 1, 80) AS video_title,
                  CAST(count(e.comment_id) AS BIGINT) AS total_comments,
                  CAST(count(*) FILTER (WHERE e.is_tenglish) AS BIGINT) AS tenglish
           FROM videos_fx v JOIN channels_fx ch USING (channel_idx) LEFT JOIN enriched e ON e.video_id = v.video_id
           GROUP BY ch.channel_name, v.video_id, v.video_title)"""
    o["per_video_log"] = _q(per_video, "SELECT * FROM pv", "comments_fx", "videos_fx", "channels_fx")
    stats = """
    st AS (SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE is_tenglish) AS BIGINT) AS tenglish,
                  CAST(count(*) FILTER (WHERE has_telugu_script) AS BIGINT) AS has_script FROM enriched)"""
    o["corpus_stats"] = _q(ENRICHED + "," + stats,
                           f"SELECT total, tenglish, has_script, tenglish - has_script AS roman_only, "
                           f"{pct1('tenglish', 'total')} AS pct_tenglish FROM st",
                           "comments_fx", "videos_fx", "channels_fx")
    posts_ctes = COLLECTED_POSTS + "," + COLLECTED_STAMPED
    known_ctes = COLLECTED_POSTS + "," + KNOWN_STAMPED
    o["posts_per_account"] = _q(known_ctes, "SELECT source_account, CAST(count(*) AS BIGINT) AS n FROM kstamped "
                                            "GROUP BY source_account", "posts_fx")
    o["account_mixed_count"] = _q(known_ctes, f"""
    SELECT source_account, CAST(count(*) AS BIGINT) AS collected,
           CAST(count(*) FILTER (WHERE is_tenglish) AS BIGINT) AS tenglish,
           {pct1('count(*) FILTER (WHERE is_tenglish)', 'count(*)')} AS pct_tenglish
    FROM kstamped GROUP BY ROLLUP (source_account)""", "posts_fx")
    o["annotation_progress"] = _q(LATEST, """
    SELECT annotator, CAST(count(*) AS BIGINT) AS done, (SELECT CAST(count(*) AS BIGINT) FROM documents) AS total,
           (SELECT CAST(count(*) AS BIGINT) FROM documents) - CAST(count(*) AS BIGINT) AS remaining,
           round(100.0 * count(*) / greatest((SELECT count(*) FROM documents), 1), 1) AS pct_done
    FROM latest WHERE item IN (SELECT doc_id FROM documents) GROUP BY annotator""", "label_events_fx")
    kappa = lambda rel: f"""
    SELECT task, n, round(po, 6) AS p_o, round(pe, 6) AS p_e,
           round(CASE WHEN pe < 1.0 THEN (po - pe) / (1.0 - pe) END, 6) AS kappa,
           coalesce(round(CASE WHEN pe < 1.0 THEN (po - pe) / (1.0 - pe) END, 6) >= {K.KAPPA_TARGET}, false)
             AS meets_target
    FROM (SELECT t.task, t.n, t.agree / t.n AS po, coalesce(m.pp, 0.0) / (t.n * t.n) AS pe
          FROM (SELECT task, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE a = b) AS BIGINT) AS agree
                FROM {rel} GROUP BY task) t
          LEFT JOIN (SELECT x.task, CAST(sum(x.na * y.nb) AS DOUBLE) AS pp
                     FROM (SELECT task, a AS cls, count(*) AS na FROM {rel} GROUP BY task, a) x
                     JOIN (SELECT task, b AS cls, count(*) AS nb FROM {rel} GROUP BY task, b) y
                     ON x.task = y.task AND x.cls = y.cls GROUP BY x.task) m ON t.task = m.task)"""  # noqa: E731
    o["cohens_kappa"] = _q("rp AS (SELECT item, a, b, 'toxicity' AS task FROM raters_fx)", kappa("rp"),
                           "raters_fx")
    o["cohens_kappa_labels"] = _q(pairs, kappa("pairs"), "label_events_fx")
    o["agreement_matrix"] = with_views(
        "SELECT 'toxicity' AS task, a, CAST(count(*) FILTER (WHERE b = 0) AS BIGINT) AS b_0, "
        "CAST(count(*) FILTER (WHERE b = 1) AS BIGINT) AS b_1 FROM raters_fx GROUP BY a", "raters_fx")
    o["class_imbalance"] = _q(LATEST, f"""
    SELECT annotator, task, max(n) AS max_n, min(n) AS min_n,
           CASE WHEN min(n) > 0 THEN round(max(n) / min(n), 4) END AS imbalance
    FROM ({dist}) GROUP BY annotator, task""", "label_events_fx")
    def card_rows(comments: str, method: dict) -> str:
        """Rows of the card that no ledger row gives: run window, comment dates, method, detection rule."""
        fixed = [("collection", "window", "first_date", P.RUN_STARTED[:10]), ("collection", "window", "last_date", P.RUN_ENDED[:10]),
                 *[("collection", "method", k, v) for k, v in method.items()],
                 ("detection", "any_of", "native_script", "U+0C00-U+0C7F"), ("detection", "any_of", "script_mix_ratio", f">= {K.MIX_RATIO}"),
                 ("detection", "any_of", "vocabulary", f">= 1 of {len(set(L))} words")]
        values = ", ".join("('" + "', '".join(map(str, r)) + "')" for r in fixed)
        return (f"UNION ALL SELECT 'collection', 'comments', 'first_date', min(substring(published_at, 1, 10)) FROM {comments} "
                f"UNION ALL SELECT 'collection', 'comments', 'last_date', max(substring(published_at, 1, 10)) FROM {comments} "
                f"UNION ALL SELECT * FROM (VALUES {values})")

    o["dataset_card"] = _q(per_video + "," + stats, f"""
    SELECT 'sources' AS section, channel || ':' || CAST(video_id AS VARCHAR) AS item, 'comments' AS metric,
           CAST(total_comments AS VARCHAR) AS value FROM pv UNION ALL
    SELECT 'sources', channel || ':' || CAST(video_id AS VARCHAR), 'tenglish', CAST(tenglish AS VARCHAR) FROM pv
    UNION ALL SELECT 'statistics', 'corpus', 'total', CAST(total AS VARCHAR) FROM st
    UNION ALL SELECT 'statistics', 'corpus', 'tenglish', CAST(tenglish AS VARCHAR) FROM st
    UNION ALL SELECT 'statistics', 'corpus', 'telugu_script', CAST(has_script AS VARCHAR) FROM st
    UNION ALL SELECT 'statistics', 'corpus', 'roman_only', CAST(tenglish - has_script AS VARCHAR) FROM st
    UNION ALL SELECT 'statistics', 'corpus', 'pct_tenglish', CAST({pct1('tenglish', 'total')} AS VARCHAR) FROM st
    {card_rows('enriched', P.METHOD)}""",
                           "comments_fx", "videos_fx", "channels_fx")

    # ---- dedup / windows / limits
    o["dedup_normalized"] = _q(RULED, "SELECT comment_id, ord, text FROM clean", "corpus_fx")
    o["dedup_posts"] = _q(COLLECTED_POSTS, "SELECT username, post_id, ord FROM dp", "posts_fx")
    o["latest_label"] = _q(LATEST, "SELECT annotator, item, sent, tox, sta, event_id FROM latest",
                           "label_events_fx")
    w1 = f"""
    w1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_idx ORDER BY published_at DESC, video_id)
                                AS video_rank FROM videos_fx) WHERE video_rank <= {P.VIDEOS_PER_CHANNEL})"""
    o["recent_videos_per_channel"] = _q(w1, "SELECT channel_idx, video_id, CAST(video_rank AS BIGINT) AS video_rank "
                                            "FROM w1", "videos_fx")
    o["cap_posts_per_account"] = _q(COLLECTED_POSTS, "SELECT username, post_id, ord, CAST(post_rank AS BIGINT) "
                                                     "AS post_rank FROM capped", "posts_fx")
    o["budget_hard"] = _q(COLLECTED_POSTS, "SELECT username, post_id, ord, CAST(post_rank AS BIGINT) AS post_rank "
                                           "FROM collected", "posts_fx")
    o["collect_posts"] = _q(posts_ctes, "SELECT tweet_id, source_account, text, date, likes, "
                                        "retweets, replies, "
                                        "coalesce(CAST(nullif(replace(regexp_extract(likes, '([0-9][0-9,]*)', 1), "
                                        "',', ''), '') AS BIGINT), 0) AS likes_n, is_tenglish, scraped_at "
                                        "FROM cstamped", "posts_fx")
    o["collect_posts_from_pages"] = o["collect_posts"]      # the same run, with the posts read back from page text
    o["order_by_count"] = _q(known_ctes, f"SELECT source_account, CAST(count(*) AS BIGINT) AS n FROM kstamped "
                                         f"GROUP BY source_account ORDER BY n DESC, source_account", "posts_fx")
    o["next_unannotated"] = _q(LATEST + """,
    cur AS (SELECT annotator, item AS cur FROM (SELECT *, row_number() OVER (PARTITION BY annotator
            ORDER BY ts DESC, event_id DESC) AS rn FROM complete) WHERE rn = 1)""", """
    SELECT c.annotator, CAST(coalesce(
             (SELECT min(d.doc_id) FROM documents d WHERE d.doc_id > c.cur AND d.doc_id NOT IN
                (SELECT item FROM latest l WHERE l.annotator = c.annotator)),
             (SELECT min(d.doc_id) FROM documents d WHERE d.doc_id NOT IN
                (SELECT item FROM latest l WHERE l.annotator = c.annotator)), -1) AS BIGINT) AS next_item
    FROM cur c""", "label_events_fx")
    o["milestone_reached"] = _q(LATEST + f""",
    fl AS (SELECT annotator, item, ts, event_id FROM (
             SELECT *, row_number() OVER (PARTITION BY annotator, item ORDER BY ts, event_id) AS rn FROM complete)
           WHERE rn = 1),
    rk AS (SELECT *, row_number() OVER (PARTITION BY annotator ORDER BY ts, event_id, item) AS n_labeled FROM fl)""",
                                f"SELECT annotator, item, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, "
                                f"CAST(n_labeled AS BIGINT) AS n_labeled FROM rk WHERE n_labeled = {P.MILESTONE}",
                                "label_events_fx")
    threads_all = f"""
    th AS (SELECT video_id, thread_id, CAST(count(*) FILTER (WHERE turn > 0) AS BIGINT) AS reply_count,
                  max(CASE WHEN turn = 0 THEN like_count END) AS top_likes FROM {{src}} GROUP BY video_id, thread_id),
    th2 AS (SELECT *, CAST(1 + reply_count AS BIGINT) AS n_rows,
                   row_number() OVER (PARTITION BY video_id ORDER BY top_likes DESC NULLS LAST, thread_id) AS thread_rank
            FROM th),
    -- page recurrence per video, row by row in rank order
    rec AS (
      SELECT video_id, thread_id, thread_rank, n_rows,
             CAST(n_rows AS BIGINT) AS total, CAST(least({P.PAGE_SIZE}, {P.ROWS_PER_VIDEO}) - 1 AS BIGINT) AS lft,
             true AS kept
      FROM th2 WHERE thread_rank = 1
      UNION ALL
      SELECT t.video_id, t.thread_id, t.thread_rank, t.n_rows,
             CASE WHEN r.lft > 0 OR r.total < {P.ROWS_PER_VIDEO} THEN r.total + t.n_rows ELSE r.total END,
             CASE WHEN r.lft > 0 THEN r.lft - 1
                  WHEN r.total < {P.ROWS_PER_VIDEO} THEN least({P.PAGE_SIZE}, {P.ROWS_PER_VIDEO} - r.total) - 1
                  ELSE 0 END,
             r.lft > 0 OR r.total < {P.ROWS_PER_VIDEO}
      FROM rec r JOIN th2 t ON t.video_id = r.video_id AND t.thread_rank = r.thread_rank + 1
      WHERE r.kept),
    fetched AS (SELECT video_id, thread_id, thread_rank, n_rows FROM rec WHERE kept)"""
    o["paged_soft_cap"] = (_q(threads_all.replace("{src}", "comments_fx"),
                              "SELECT video_id, thread_id, CAST(thread_rank AS BIGINT) AS thread_rank, n_rows "
                              "FROM fetched", "comments_fx")
                           .replace("WITH ", "WITH RECURSIVE ", 1))
    soft = w1 + """,
    cw AS (SELECT * FROM comments_fx WHERE video_id IN (SELECT video_id FROM w1)),""" + \
        threads_all.replace("{src}", "cw") + """,
    pv AS (SELECT w1.video_id, w1.channel_idx, CAST(w1.video_rank AS BIGINT) AS video_rank,
                  CAST(coalesce(sum(f.n_rows), 0) AS BIGINT) AS n_rows
           FROM w1 LEFT JOIN fetched f ON f.video_id = w1.video_id
           GROUP BY w1.video_id, w1.channel_idx, w1.video_rank),
    pvb AS (SELECT *, CAST(coalesce(sum(n_rows) OVER (ORDER BY channel_idx, video_rank, video_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rows_before FROM pv)"""
    o["budget_soft"] = (_q(soft, f"SELECT * FROM pvb WHERE rows_before < {P.TOTAL_TARGET}", "videos_fx",
                           "comments_fx").replace("WITH ", "WITH RECURSIVE ", 1))
    o["collect_comments"] = (_q(soft + "," + ENRICHED, f"""
    SELECT e.comment_id, e.parent_id, e.video_id,
           CAST(CASE WHEN c.turn = 0 THEN e.reply_count ELSE 0 END AS BIGINT) AS reply_count,
           e.channel_name, e.is_tenglish
    FROM enriched e JOIN comments_fx c ON c.comment_id = e.comment_id
    JOIN fetched f ON f.video_id = c.video_id AND f.thread_id = c.thread_id
    WHERE c.video_id IN (SELECT video_id FROM pvb WHERE rows_before < {P.TOTAL_TARGET})""",
                                "videos_fx", "comments_fx", "channels_fx").replace("WITH ", "WITH RECURSIVE ", 1))

    o["collect_comments_from_payloads"] = o["collect_comments"]      # the same run, with its tables read back from payload text

    o["collection_log"] = (_q(soft + "," + ENRICHED, f"""
    SELECT ch.channel_name AS channel, v.video_id, substring(v.video_title, 1, 80) AS video_title,
           CAST(count(e.comment_id) AS BIGINT) AS total_comments,
           CAST(count(*) FILTER (WHERE e.is_tenglish) AS BIGINT) AS tenglish
    FROM videos_fx v JOIN channels_fx ch USING (channel_idx)
    LEFT JOIN (SELECT e.* FROM enriched e JOIN comments_fx c ON c.comment_id = e.comment_id
               JOIN fetched f ON f.video_id = c.video_id AND f.thread_id = c.thread_id) e ON e.video_id = v.video_id
    WHERE v.video_id IN (SELECT video_id FROM pvb WHERE rows_before < {P.TOTAL_TARGET})
    GROUP BY ch.channel_name, v.video_id, v.video_title""",
                                "videos_fx", "comments_fx", "channels_fx").replace("WITH ", "WITH RECURSIVE ", 1))

    coll = f"""
    coll AS (SELECT e.* FROM enriched e JOIN comments_fx c ON c.comment_id = e.comment_id
             JOIN fetched f ON f.video_id = c.video_id AND f.thread_id = c.thread_id
             WHERE c.video_id IN (SELECT video_id FROM pvb WHERE rows_before < {P.TOTAL_TARGET})),
    cpv AS (SELECT ch.channel_name AS channel, v.video_id, CAST(count(e.comment_id) AS BIGINT) AS total_comments,
                   CAST(count(*) FILTER (WHERE e.is_tenglish) AS BIGINT) AS tenglish
            FROM videos_fx v JOIN channels_fx ch USING (channel_idx) LEFT JOIN coll e ON e.video_id = v.video_id
            WHERE v.video_id IN (SELECT video_id FROM pvb WHERE rows_before < {P.TOTAL_TARGET})
            GROUP BY ch.channel_name, v.video_id),
    cst AS (SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE is_tenglish) AS BIGINT) AS tenglish,
                   CAST(count(*) FILTER (WHERE has_telugu_script) AS BIGINT) AS has_script FROM coll)"""
    o["collection_card"] = (_q(soft + "," + ENRICHED + "," + coll, f"""
    SELECT 'sources' AS section, channel || ':' || CAST(video_id AS VARCHAR) AS item, 'comments' AS metric,
           CAST(total_comments AS VARCHAR) AS value FROM cpv UNION ALL
    SELECT 'sources', channel || ':' || CAST(video_id AS VARCHAR), 'tenglish', CAST(tenglish AS VARCHAR) FROM cpv
    UNION ALL SELECT 'statistics', 'corpus', 'total', CAST(total AS VARCHAR) FROM cst
    UNION ALL SELECT 'statistics', 'corpus', 'tenglish', CAST(tenglish AS VARCHAR) FROM cst
    UNION ALL SELECT 'statistics', 'corpus', 'telugu_script', CAST(has_script AS VARCHAR) FROM cst
    UNION ALL SELECT 'statistics', 'corpus', 'roman_only', CAST(tenglish - has_script AS VARCHAR) FROM cst
    UNION ALL SELECT 'statistics', 'corpus', 'pct_tenglish', CAST({pct1('tenglish', 'total')} AS VARCHAR) FROM cst
    {card_rows('coll', {'comment_order': 'relevance', 'replies_collected': 'true', 'videos_per_channel': P.VIDEOS_PER_CHANNEL,
                        'rows_per_video': P.ROWS_PER_VIDEO, 'target': P.TOTAL_TARGET})}""",
                                 "videos_fx", "comments_fx", "channels_fx").replace("WITH ", "WITH RECURSIVE ", 1))

    # ---- set operations
    o["union_sources"] = _q(ENRICHED + "," + STAMPED, """
    SELECT comment_id, channel_name, text, is_tenglish, NULL AS tweet_id, NULL AS source_account FROM enriched
    UNION ALL SELECT NULL, NULL, text, is_tenglish, tweet_id, source_account FROM stamped""",
                            "comments_fx", "videos_fx", "channels_fx", "posts_fx")

    # ---- streaming (batch answers)
    o["stream_clean"] = _q(RULED, "SELECT comment_id, ord, text, text_original FROM clean", "corpus_fx")
    o["stream_label_distribution"] = o["label_distribution"]
    o["stream_rate"] = with_views(f"""
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
           strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
           annotator, CAST(count(*) AS BIGINT) AS n
    FROM label_events_fx
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM label_events_fx) - INTERVAL '{P.RATE_DELAY}'
    GROUP BY 1, 2, 3""", "label_events_fx")

    # ---- release (the fixture's key is shorter than a block)
    pad = lambda x: "'" + "".join(f"\\x{b ^ x:02X}" for b in P.FIXTURE_KEY.encode().ljust(64, b"\0")) + "'::BLOB"
    o["release_view"] = enr("SELECT comment_id, parent_id, video_id, channel_name, channel_id, published_at, "
                            "like_count, reply_count, has_telugu_script, script_mix_ratio, roman_telugu_hits, "
                            "is_tenglish FROM enriched")
    o["anonymize_author"] = with_views(
        f"SELECT comment_id, sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode(coalesce(author, ''))))) AS author_hash "
        "FROM comments_fx",
        "comments_fx")
    o["locked_snapshot"] = _q(RULED, """
    SELECT CAST(count(*) AS BIGINT) AS n_rows,
           CAST(sum(CAST(('0x' || substr(md5(concat_ws(chr(31), coalesce(CAST(comment_id AS VARCHAR), '\\N'),
                coalesce(text, '\\N'))), 1, 15)) AS BIGINT)) AS DECIMAL(38, 0)) AS digest_sum
    FROM clean""", "corpus_fx")
    return o


ORACLE = build()
