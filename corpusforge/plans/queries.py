"""Registered queries: one per operator ID of SURVEY §2, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables through the derived views in ``views``
(whole tables, whole texts) and calls the library operators; nothing here
re-implements an operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import consts as K
from ..functions import text as T
from ..operators import agreement as G
from ..operators import annotate as A
from ..operators import clean as C
from ..operators import collect as L
from ..operators import release as R
from ..operators import runs as RUN
from ..operators import stats as S
from ..session import scratch_path
from ..sources import files as IO
from ..sources import payloads as PL
from ..streaming import jobs as ST
from . import params as P
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def q(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return V.view(spark, sf, name)


# --- shared building blocks ---------------------------------------------------

def corpus(spark, sf):
    return _t(spark, sf, "corpus_fx")


def enriched(spark, sf):
    return L.enrich_comments(_t(spark, sf, "comments_fx"), _t(spark, sf, "videos_fx"),
                             _t(spark, sf, "channels_fx"))


def label_events(spark, sf):
    return _t(spark, sf, "label_events_fx")


def latest(spark, sf):
    return A.latest_labels(label_events(spark, sf))


def items(spark, sf):
    """Annotation batch: documents, item id = doc_id."""
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("item"), "source", "lang", "text")


def stamped_posts(spark, sf, posts=None):
    posts = posts if posts is not None else _t(spark, sf, "posts_fx")
    return L.stamp_posts(posts, F.lit(P.SCRAPED_AT))


def collected_posts(spark, sf, posts=None):
    """F5 -> D2 -> W2 -> W5 over the archived posts."""
    deduped = L.dedup_posts(posts if posts is not None else _t(spark, sf, "posts_fx"))
    capped = L.cap_posts_per_account(deduped, P.POSTS_PER_ACCOUNT)
    return L.budget_hard(capped, P.TOTAL_TARGET, ("username",))


def known_posts(spark, sf):
    """Every post of every account once (F5 -> D2), without caps: the input of the account statistics."""
    return stamped_posts(spark, sf, L.dedup_posts(_t(spark, sf, "posts_fx")))


def timeline_posts(spark, sf):
    """S4 over archived account pages in the collector's markup; ``ord``: page, then place on the page."""
    posts = PL.extract_posts(PL.build_timeline_pages(_t(spark, sf, "posts_fx")))
    return posts.withColumn("ord", F.struct("page_id", "position"))


def collected_comments(spark, sf):
    """(processed videos, collected and scored comment rows)."""
    return L.collect_comment_rows(_t(spark, sf, "videos_fx"), _t(spark, sf, "comments_fx"),
                                  _t(spark, sf, "channels_fx"), P.VIDEOS_PER_CHANNEL, P.ROWS_PER_VIDEO,
                                  P.PAGE_SIZE, P.TOTAL_TARGET, True)


def collection_run(spark, sf):
    """E2 as a recorded run; returns its folder."""
    path = scratch_path(spark, "run")
    RUN.collect_run(path, _t(spark, sf, "videos_fx"), _t(spark, sf, "comments_fx"), _t(spark, sf, "channels_fx"), P.VIDEOS_PER_CHANNEL,
                    P.ROWS_PER_VIDEO, P.PAGE_SIZE, P.TOTAL_TARGET, True, P.RUN_STARTED, P.RUN_ENDED)
    return path


def payload_tables(spark, sf):
    """(videos, comments) read back from payload text: S2 and S3 with the keys that the collection needs.

    The stand-in payloads carry numeric ids as text; they are cast back so that ties are ordered as in the tables.
    """
    channels = _t(spark, sf, "channels_fx")
    listing = PL.payload_text(PL.build_video_listing(_t(spark, sf, "videos_fx"), channels))
    videos = (PL.flatten_video_listing(PL.parse_payload(listing, "payload", PL.VIDEO_LISTING)).drop("channel_name")
              .join(channels.select("channel_id", "channel_idx"), "channel_id").withColumn("video_id", F.col("video_id").cast("bigint")))
    threads = PL.payload_text(PL.build_thread_pages(_t(spark, sf, "comments_fx")))
    comments = (PL.flatten_threads(PL.parse_payload(threads, "payload", PL.THREAD_PAGE)).drop("reply_count")
                .withColumns({"video_id": F.col("video_id").cast("bigint"),
                              "thread_id": F.split_part("thread_id", F.lit("-"), F.lit(1)).cast("bigint")}))
    return videos, comments


# --- 2.1 sources and sinks ------------------------------------------------------

@q("read_corpus")
def read_corpus(spark, sf):
    path = scratch_path(spark, "corpus_csv")
    IO.write_corpus_csv(corpus(spark, sf).select("comment_id", "text"), path)
    return IO.corpus_rows(IO.land_csv(spark, path, scratch_path(spark, "corpus_landing"))).drop(IO.LANDED)


@q("flatten_video_listing")
def flatten_video_listing(spark, sf):
    payload = PL.build_video_listing(_t(spark, sf, "videos_fx"), _t(spark, sf, "channels_fx"))
    text = PL.payload_text(payload)                        # responses as JSON text
    return PL.flatten_video_listing(PL.parse_payload(text, "payload", PL.VIDEO_LISTING))


@q("flatten_threads")
def flatten_threads(spark, sf):
    pages = PL.build_thread_pages(_t(spark, sf, "comments_fx"))
    text = PL.payload_text(pages)                          # responses as JSON text
    return PL.flatten_threads(PL.parse_payload(text, "payload", PL.THREAD_PAGE), collect_replies=True)


@q("extract_posts")
def extract_posts(spark, sf):
    return PL.extract_posts(_t(spark, sf, "pages"))


@q("extract_timeline_posts")
def extract_timeline_posts(spark, sf):
    return timeline_posts(spark, sf).select("username", "post_id", "href", "text", "lang", "date", *PL.STATS)


@q("write_corpus")
def write_corpus(spark, sf):
    path = scratch_path(spark, "clean_corpus")
    IO.write_corpus(C.clean_corpus(corpus(spark, sf)), path)
    return spark.read.parquet(path).select("comment_id", "ord", "source", "lang", "text", "text_original")


@q("read_annotation_batch")
def read_annotation_batch(spark, sf):
    cols = ["comment_id", "author", "published_at", "text"]
    path = scratch_path(spark, "annotation_batch")
    IO.write_corpus_csv(_t(spark, sf, "comments_fx").select(*cols), path)
    return IO.annotation_rows(IO.land_csv(spark, path, scratch_path(spark, "annotation_landing"))).drop(IO.LANDED)


@q("export_annotations")
def export_annotations(spark, sf):
    return A.export_annotations(items(spark, sf), latest(spark, sf), P.ANNOTATOR, P.ANNOTATOR_NAME,
                                export_date=P.EXPORT_DATE)


@q("restore_labels")
def restore_labels(spark, sf):
    path = scratch_path(spark, "label_snapshot")
    IO.snapshot_labels(latest(spark, sf), path, P.SCRAPED_AT, A.cursor(label_events(spark, sf)), items(spark, sf).count())
    return IO.restore_labels(spark, path)


@q("cleaning_report")
def cleaning_report(spark, sf):
    return C.cleaning_report(corpus(spark, sf))


# --- 2.2 projections --------------------------------------------------------------

def _corpus_proj(spark, sf, **cols) -> DataFrame:
    df = corpus(spark, sf)
    t = T.unicode_trim(F.col("text"))
    s = T.strip_emoji(t)
    env = {"t": t, "s": s, "x": F.col("text")}
    return df.select("comment_id", *[fn(env).alias(name) for name, fn in cols.items()])


@q("unicode_trim")
def unicode_trim(spark, sf):
    return _corpus_proj(spark, sf, text_trim=lambda e: e["t"])


@q("strip_emoji")
def strip_emoji(spark, sf):
    return _corpus_proj(spark, sf, text_stripped=lambda e: e["s"])


@q("has_alpha_content")
def has_alpha_content(spark, sf):
    return _corpus_proj(spark, sf, has_alpha=lambda e: T.has_alpha_content(e["s"]))


@q("word_count")
def word_count(spark, sf):
    return _corpus_proj(spark, sf, n_words=lambda e: T.word_count(e["s"]).cast("bigint"))


@q("has_native_script")
def has_native_script(spark, sf):
    return _corpus_proj(spark, sf, has_native=lambda e: T.has_native_script(e["x"]))


@q("dedup_key")
def dedup_key(spark, sf):
    return _corpus_proj(spark, sf, dedup_key=lambda e: T.dedup_key(e["s"]))


@q("native_char_count")
def native_char_count(spark, sf):
    return _corpus_proj(spark, sf, n_native=lambda e: T.native_char_count(e["x"]).cast("bigint"))


@q("non_space_length")
def non_space_length(spark, sf):
    return _corpus_proj(spark, sf, n_non_space=lambda e: T.non_space_length(e["x"]).cast("bigint"))


@q("lexicon_hits")
def lexicon_hits(spark, sf):
    return _corpus_proj(spark, sf, hits=lambda e: T.lexicon_hits(e["x"]).cast("bigint"))


@q("code_mix_score")
def code_mix_score(spark, sf):
    df = corpus(spark, sf)
    sc = T.code_mix_score(F.coalesce(F.col("text"), F.lit("")))
    return df.select("comment_id", sc["has_telugu_script"].alias("has_telugu_script"),
                     sc["script_mix_ratio"].alias("script_mix_ratio"),
                     sc["roman_telugu_hits"].cast("bigint").alias("roman_telugu_hits"),
                     sc["is_tenglish"].alias("is_tenglish"))


@q("is_code_mixed")
def is_code_mixed(spark, sf):
    return _corpus_proj(spark, sf, is_mixed=lambda e: T.is_code_mixed(e["x"]))


@q("permalink_id")
def permalink_id(spark, sf):
    return _t(spark, sf, "posts_fx").select("ord", T.permalink_id(F.col("href")).alias("post_key"))


@q("fallback_id")
def fallback_id(spark, sf):
    posts = _t(spark, sf, "posts_fx")
    link = F.when(F.col("likes").isNotNull(), T.permalink_id(F.col("href")))
    return posts.select("ord", T.fallback_id(link, F.col("text")).alias("post_key"))


@q("title_preview")
def title_preview(spark, sf):
    return _t(spark, sf, "videos_fx").select("video_id", T.title_preview(F.col("video_title")).alias("title"))


def _u2(spark, sf):
    return L.union_comments_posts(enriched(spark, sf), stamped_posts(spark, sf))


@q("date_part")
def date_part(spark, sf):
    return _u2(spark, sf).select("kind", "item_id", "date")


@q("coalesce_source")
def coalesce_source(spark, sf):
    return _u2(spark, sf).select("kind", "item_id", "source")


@q("parse_flag")
def parse_flag(spark, sf):
    e = enriched(spark, sf)
    return e.select("comment_id", T.parse_flag(F.col("is_tenglish").cast("string")).alias("flag"))


@q("ratio_round")
def ratio_round(spark, sf):
    return _corpus_proj(spark, sf, script_mix_ratio=lambda e: T.ratio_round(
        T.native_char_count(e["x"]), T.non_space_length(e["x"])))


@q("pct_one_dp")
def pct_one_dp(spark, sf):
    df = corpus(spark, sf).withColumn("m", T.is_code_mixed(F.coalesce(F.col("text"), F.lit(""))))
    g = df.groupBy("source").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                 F.count(F.when(F.col("m"), 1)).cast("bigint").alias("mixed"))
    return g.withColumn("pct_mixed", T.pct_one_dp(F.col("mixed"), F.col("n")))


@q("pct_int")
def pct_int(spark, sf):
    return A.label_distribution(latest(spark, sf)).select("annotator", "task", "code", "pct")


@q("decode_label")
def decode_label(spark, sf):
    lab = latest(spark, sf)
    return lab.select("annotator", "item",
                      *[T.decode_label(F.col(code), names).alias(f"{task}_label")
                        for task, code, names in K.TASKS])


@q("annotation_stamp")
def annotation_stamp(spark, sf):
    return export_annotations(spark, sf).select("item", "annotated", "annotated_by", "annotation_date")


@q("keep_original_text")
def keep_original_text(spark, sf):
    return C.clean_corpus(corpus(spark, sf)).select("comment_id", "text_original", "text")


@q("backfill_columns")
def backfill_columns(spark, sf):
    e = enriched(spark, sf).select(F.lit("comment").alias("kind"), F.col("comment_id").alias("item_id"),
                                   "has_telugu_script", "script_mix_ratio", "roman_telugu_hits",
                                   "is_tenglish")
    p = L.backfill_columns(stamped_posts(spark, sf).select(
        F.lit("post").alias("kind"), F.col("tweet_id").alias("item_id"), "is_tenglish"))
    return e.unionByName(p.select(*e.columns)).withColumn("roman_telugu_hits",
                                                          F.col("roman_telugu_hits").cast("bigint"))


@q("stamp_source")
def stamp_source(spark, sf):
    return stamped_posts(spark, sf).select("tweet_id", "source_account", "scraped_at")


@q("default_stat")
def default_stat(spark, sf):
    return _t(spark, sf, "posts_fx").select("ord", T.default_stat(F.col("likes")).alias("likes"),
                                           T.stat_number(F.col("likes")).alias("likes_n"))


# --- 2.3 filters --------------------------------------------------------------

@q("drop_empty")
def drop_empty(spark, sf):
    return corpus(spark, sf).select("comment_id", C.drop_empty(F.col("text")).alias("is_empty"))


@q("drop_symbol_only")
def drop_symbol_only(spark, sf):
    return _corpus_proj(spark, sf, symbol_only=lambda e: C.drop_symbol_only(e["s"]))


@q("drop_short_non_native")
def drop_short_non_native(spark, sf):
    return _corpus_proj(spark, sf, short_non_native=lambda e: C.drop_short_non_native(e["s"], e["t"]))


@q("drop_reason")
def drop_reason(spark, sf):
    return C.per_row_reason(corpus(spark, sf)).select("comment_id", "drop_reason")


@q("min_text_length")
def min_text_length(spark, sf):
    return _t(spark, sf, "posts_fx").select("ord", L.min_text_length(F.col("text")).alias("long_enough"))


@q("complete_label")
def complete_label(spark, sf):
    return label_events(spark, sf).select("event_id", A.complete_label().alias("complete"))


@q("enabled_sources")
def enabled_sources(spark, sf):
    return L.enabled_sources(_t(spark, sf, "channels_fx"), _t(spark, sf, "videos_fx")) \
        .select("channel_idx", "channel_name")


# --- 2.4 joins ------------------------------------------------------------------

@q("enrich_comments")
def enrich_comments(spark, sf):
    return enriched(spark, sf)


@q("attach_labels")
def attach_labels(spark, sf):
    return A.attach_labels(items(spark, sf).select("item"), latest(spark, sf), P.ANNOTATOR) \
        .select("item", "sent", "tox", "sta")


@q("unannotated_items")
def unannotated_items(spark, sf):
    return A.unannotated_items(items(spark, sf).select("item"), latest(spark, sf), P.ANNOTATOR)


@q("reply_to_parent")
def reply_to_parent(spark, sf):
    return L.reply_to_parent(_t(spark, sf, "comments_fx"))


@q("paired_ratings")
def paired_ratings(spark, sf):
    return G.paired_ratings(latest(spark, sf), 0, 1)


@q("rehydrate")
def rehydrate(spark, sf):
    ids = corpus(spark, sf).select("comment_id")
    fetched = _t(spark, sf, "documents").select(F.col("doc_id").alias("comment_id"), "text")
    return R.rehydrate(ids, fetched)


# --- 2.5 aggregations -------------------------------------------------------------

@q("drop_reason_counts")
def drop_reason_counts(spark, sf):
    return C.drop_reason_counts(corpus(spark, sf))


@q("cleaning_summary")
def cleaning_summary(spark, sf):
    return C.cleaning_summary(corpus(spark, sf))


@q("per_video_log")
def per_video_log(spark, sf):
    return S.per_video_log(_t(spark, sf, "videos_fx"), _t(spark, sf, "channels_fx"), enriched(spark, sf))


@q("corpus_stats")
def corpus_stats(spark, sf):
    return S.corpus_stats(enriched(spark, sf))


@q("posts_per_account")
def posts_per_account(spark, sf):
    return S.posts_per_account(known_posts(spark, sf))


@q("account_mixed_count")
def account_mixed_count(spark, sf):
    return S.account_mixed_count(known_posts(spark, sf))


@q("label_distribution")
def label_distribution(spark, sf):
    return A.label_distribution(latest(spark, sf))


@q("annotation_progress")
def annotation_progress(spark, sf):
    return A.annotation_progress(items(spark, sf), latest(spark, sf))


@q("cohens_kappa")
def cohens_kappa(spark, sf):
    pairs = _t(spark, sf, "raters_fx").withColumn("task", F.lit("toxicity"))
    return G.cohens_kappa(pairs)


@q("cohens_kappa_labels")
def cohens_kappa_labels(spark, sf):
    return G.cohens_kappa(G.paired_ratings(latest(spark, sf), 0, 1))


@q("agreement_matrix")
def agreement_matrix(spark, sf):
    pairs = _t(spark, sf, "raters_fx").withColumn("task", F.lit("toxicity"))
    return G.agreement_matrix(pairs, (0, 1))


@q("class_imbalance")
def class_imbalance(spark, sf):
    return A.class_imbalance(A.label_distribution(latest(spark, sf)))


@q("dataset_card")
def dataset_card(spark, sf):
    path = scratch_path(spark, "card_ledger")
    RUN.write_ledger(path, _t(spark, sf, "videos_fx"), _t(spark, sf, "channels_fx"), RUN.video_counts(enriched(spark, sf)),
                     P.RUN_STARTED, P.RUN_ENDED, P.METHOD)
    return RUN.run_card(spark, path)


# --- 2.6 dedup, windows, limits ----------------------------------------------------

@q("dedup_normalized")
def dedup_normalized(spark, sf):
    return C.clean_corpus(corpus(spark, sf)).select("comment_id", "ord", "text")


@q("dedup_posts")
def dedup_posts(spark, sf):
    return L.dedup_posts(_t(spark, sf, "posts_fx")).select("username", "post_id", "ord")


@q("latest_label")
def latest_label(spark, sf):
    return latest(spark, sf).select("annotator", "item", "sent", "tox", "sta", "event_id")


@q("recent_videos_per_channel")
def recent_videos_per_channel(spark, sf):
    return L.recent_videos_per_channel(_t(spark, sf, "videos_fx"), P.VIDEOS_PER_CHANNEL) \
        .select("channel_idx", "video_id", F.col("video_rank").cast("bigint").alias("video_rank"))


@q("cap_posts_per_account")
def cap_posts_per_account(spark, sf):
    capped = L.cap_posts_per_account(L.dedup_posts(_t(spark, sf, "posts_fx")), P.POSTS_PER_ACCOUNT)
    return capped.select("username", "post_id", "ord", F.col("post_rank").cast("bigint").alias("post_rank"))


@q("paged_soft_cap")
def paged_soft_cap(spark, sf):
    threads = L.thread_rows(_t(spark, sf, "comments_fx"), True)
    kept = L.paged_soft_cap(threads, P.ROWS_PER_VIDEO, P.PAGE_SIZE)
    return kept.select("video_id", "thread_id", F.col("thread_rank").cast("bigint").alias("thread_rank"),
                       "n_rows")


@q("budget_soft")
def budget_soft(spark, sf):
    pv, _ = collected_comments(spark, sf)
    return pv.select("video_id", "channel_idx", F.col("video_rank").cast("bigint").alias("video_rank"),
                     "n_rows", "rows_before")


@q("budget_hard")
def budget_hard(spark, sf):
    return collected_posts(spark, sf).select(
        "username", "post_id", "ord", F.col("post_rank").cast("bigint").alias("post_rank"))


@q("next_unannotated")
def next_unannotated(spark, sf):
    return A.next_unannotated(items(spark, sf), latest(spark, sf), label_events(spark, sf), P.ANNOTATORS)


@q("milestone_reached")
def milestone_reached(spark, sf):
    return A.milestone_reached(label_events(spark, sf), P.MILESTONE)


@q("order_by_count")
def order_by_count(spark, sf):
    return S.posts_per_account(known_posts(spark, sf))


@q("collect_posts")
def collect_posts(spark, sf):
    """E4 end to end: F5 -> D2 -> W2 -> W5, then the raw_tweets schema."""
    return stamped_posts(spark, sf, collected_posts(spark, sf))


@q("collect_posts_from_pages")
def collect_posts_from_pages(spark, sf):
    """E4 from page text: S4 -> F5 -> D2 -> W2 -> W5, then the raw_tweets schema."""
    return stamped_posts(spark, sf, collected_posts(spark, sf, timeline_posts(spark, sf)))


@q("collect_comments")
def collect_comments(spark, sf):
    """E2 end to end: listing cut, paged cap, soft budget, enrichment + score."""
    _, e = collected_comments(spark, sf)
    return e.select("comment_id", "parent_id", "video_id", "reply_count", "channel_name", "is_tenglish")


@q("collect_comments_from_payloads")
def collect_comments_from_payloads(spark, sf):
    """E2 from payload text: S2, S3 -> W1 -> W3 -> W4 -> J1 + P10."""
    videos, comments = payload_tables(spark, sf)
    _, e = L.collect_comment_rows(videos, comments, _t(spark, sf, "channels_fx"), P.VIDEOS_PER_CHANNEL, P.ROWS_PER_VIDEO,
                                  P.PAGE_SIZE, P.TOTAL_TARGET, True)
    return e.select("comment_id", "parent_id", "video_id", "reply_count", "channel_name", "is_tenglish")


@q("collection_log")
def collection_log(spark, sf):
    """A3 as the collection run records it: processed videos only, with their collected rows."""
    return RUN.run_log(spark, f"{collection_run(spark, sf)}/ledger")


@q("collection_card")
def collection_card(spark, sf):
    """A12 of the same run: window and method, log of processed videos, statistics of the collected rows, detection rule."""
    return RUN.run_card(spark, f"{collection_run(spark, sf)}/ledger")


# --- 2.7 set operations -----------------------------------------------------------

@q("union_sources")
def union_sources(spark, sf):
    e = enriched(spark, sf).select("comment_id", "channel_name", "text", "is_tenglish")
    p = stamped_posts(spark, sf).select("tweet_id", "source_account", "text", "is_tenglish")
    return L.union_sources([e, p])


@q("union_comments_posts")
def union_comments_posts(spark, sf):
    return _u2(spark, sf)


# --- 2.9 streaming ------------------------------------------------------------------

def _stream_view(spark, sf, table: str, view_sql: str) -> DataFrame:
    """A derived view over a file stream of ``table``, bound under a private name.

    The shared batch view names are never rebound, so queries built at the
    same time in the same session are unaffected.
    """
    stream = ST.file_stream(spark, sf, table, spread_key=V.SPREAD_KEYS[table])
    private = f"_stream_{table}"
    stream.createOrReplaceTempView(private)
    return spark.sql(view_sql.replace(f"FROM {table}", f"FROM {private}"))


def _stream_corpus(spark, sf):
    return _stream_view(spark, sf, "documents", V.CORPUS_FX)


@q("stream_clean")
def stream_clean(spark, sf):
    out, ck = ST.scratch_pair(spark, "stream_clean")
    ST.stream_clean(_stream_corpus(spark, sf), out, ck)
    return spark.read.parquet(out).select("comment_id", "ord", "text", "text_original")


def _stream_label_events(spark, sf):
    return _stream_view(spark, sf, "events", V.LABEL_EVENTS_FX)


@q("stream_label_distribution")
def stream_label_distribution(spark, sf):
    out, ck = ST.scratch_pair(spark, "stream_labels")
    ST.stream_latest_labels(_stream_label_events(spark, sf), out, ck)
    return A.label_distribution(ST.current_labels(spark, out))


@q("stream_rate")
def stream_rate(spark, sf):
    out, ck = ST.scratch_pair(spark, "stream_rate")
    ST.stream_rate(_stream_label_events(spark, sf), out, ck, P.RATE_WINDOW, P.RATE_DELAY)
    return spark.read.parquet(out)


# --- 2.10 release -------------------------------------------------------------------

@q("release_view")
def release_view(spark, sf):
    return R.release_view(enriched(spark, sf))


@q("anonymize_author")
def anonymize_author(spark, sf):
    e = _t(spark, sf, "comments_fx")
    return e.select("comment_id", R.anonymize_author(F.col("author"), P.FIXTURE_KEY).alias("author_hash"))


@q("locked_snapshot")
def locked_snapshot(spark, sf):
    path = scratch_path(spark, "snapshot")
    clean = C.clean_corpus(corpus(spark, sf)).select("comment_id", "text")
    return R.locked_snapshot(clean, path, ["comment_id", "text"])
