"""Command line: the pipeline entry points as Spark jobs.

    python -m corpusforge collect LISTINGS THREADS CHANNELS.csv OUT   # E2: payloads -> scored comments, run ledger, log, card
    python -m corpusforge collect-posts PAGES OUT    # E4: archived account pages -> posts + posts per account
    python -m corpusforge clean  IN.csv OUT_DIR      # E1: clean corpus CSV + cleaning report
    python -m corpusforge card   COMMENTS OUT_DIR    # A4/A12: statistics + dataset card of a raw comment table
    python -m corpusforge export CORPUS LABELS OUT_DIR --annotator 0 --name NAME   # E3: annotated CSV

Inputs ending in ``.csv`` are read as CSV (all columns as strings, NA
sentinels -> null; landed as Parquet once); anything else is read as
Parquet.  ``LISTINGS`` and ``THREADS`` are JSON-lines payloads; truncated
lines are passed over.  ``CHANNELS`` has channel_id and channel_name in the
order of collection.  ``PAGES`` has page_id, url and html.  ``CORPUS`` needs
an ``item`` id column; ``LABELS`` is the label event table (event_id, ts,
item, annotator, sent, tox, sta).  The master comes from ``spark-submit`` /
``SPARK_MASTER`` (default ``local[*]``).
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import consts as K
from .operators import annotate as A
from .operators import clean as C
from .operators import collect as L
from .operators import runs as RUN
from .operators import stats as S
from .session import build_session, scratch_path
from .sources import files as IO
from .sources import payloads as PL


def _read(spark: SparkSession, path: str, landing: str) -> DataFrame:
    """Rows of a CSV (landed under ``landing`` first) or of a Parquet table, with their order in ``IO.LANDED``."""
    if path.endswith(".csv"):
        return IO.corpus_rows(IO.land_csv(spark, path, landing))
    table = spark.read.parquet(path)
    return table if IO.LANDED in table.columns else table.withColumn(IO.LANDED, IO.file_order())


def cmd_clean(spark: SparkSession, src: str, out: str) -> None:
    """The file order decides which of equal rows comes first, and the clean CSV keeps it."""
    raw = _read(spark, src, f"{out}/landing")
    clean = C.clean_corpus(raw, order_col=IO.LANDED).orderBy(IO.LANDED).drop(IO.LANDED)
    IO.write_corpus_csv(clean, f"{out}/clean_csv")
    IO.write_report_text(C.cleaning_report(raw), f"{out}/cleaning_report")


def cmd_collect(spark: SparkSession, listings: str, threads: str, channels: str, out: str, videos_per_channel: int = K.VIDEOS_PER_CHANNEL,
                rows_per_video: int = K.ROWS_PER_VIDEO, page: int = K.PAGE_SIZE, target: int = K.TOTAL_TARGET, replies: bool = True) -> None:
    """Comments, ledger, log and card of a new run under ``out``; runs before it stay readable until it is whole."""
    config = _read(spark, channels, scratch_path(spark, "channels_landing")).select("channel_id", "channel_name", IO.LANDED)
    # the configured list of channels is short: its order is numbered in one window
    config = config.withColumn("channel_idx", F.row_number().over(Window.orderBy(IO.LANDED)).cast("int")).drop(IO.LANDED)
    listed = PL.flatten_video_listing(PL.valid_payloads(PL.read_payloads(spark, listings, PL.VIDEO_LISTING)))
    videos = listed.drop("channel_name").join(config.select("channel_id", "channel_idx"), "channel_id").drop("channel_id")
    comments = PL.flatten_threads(PL.valid_payloads(PL.read_payloads(spark, threads, PL.THREAD_PAGE)), replies).drop("reply_count")
    RUN.collect_run(out, videos, comments, config, videos_per_channel, rows_per_video, page, target, replies)
    RUN.run_log(spark, f"{out}/ledger").write.mode("overwrite").parquet(f"{out}/log")
    RUN.write_card_text(spark, f"{out}/ledger", f"{out}/card")


def cmd_collect_posts(spark: SparkSession, pages: str, out: str, per_account: int = K.POSTS_PER_ACCOUNT, target: int = K.TOTAL_TARGET) -> None:
    """Posts of archived pages (first per account and id), capped, scored; and the count per account."""
    posts = PL.extract_posts(_read(spark, pages, f"{out}/landing")).withColumn("ord", F.struct("page_id", "position"))
    kept = L.budget_hard(L.cap_posts_per_account(L.dedup_posts(posts), per_account), target, ("username",))
    L.stamp_posts(kept, F.lit(RUN.now())).write.mode("overwrite").parquet(f"{out}/posts")
    S.account_mixed_count(spark.read.parquet(f"{out}/posts")).write.mode("overwrite").parquet(f"{out}/accounts")


def cmd_card(spark: SparkSession, src: str, out: str, started: str | None = None, ended: str | None = None) -> None:
    """A4, and A12 if the comments name their channel and video: the card as rows and as text."""
    comments = _read(spark, src, f"{out}/landing")
    scored = comments.withColumns({c: F.col(c).cast("boolean") for c in ("is_tenglish", "has_telugu_script")})
    S.corpus_stats(scored).write.mode("overwrite").parquet(f"{out}/corpus_stats")
    if not {"channel_name", "video_id", "video_title", "published_at"} <= set(scored.columns):
        return
    videos = scored.groupBy("channel_name", "video_id").agg(F.max("video_title").alias("video_title"), F.max("published_at").alias("published_at"))
    videos = videos.withColumn("channel_idx", F.col("channel_name"))
    RUN.write_ledger(f"{out}/ledger", videos.drop("channel_name"), videos.select("channel_idx", "channel_name").distinct(),
                     RUN.video_counts(scored), started or RUN.now(), ended or RUN.now())
    RUN.run_card(spark, f"{out}/ledger").write.mode("overwrite").parquet(f"{out}/card_rows")
    RUN.write_card_text(spark, f"{out}/ledger", f"{out}/card")


def cmd_export(spark: SparkSession, corpus: str, labels: str, out: str, annotator: int, name: str,
               export_date: str | None = None) -> None:
    items = _read(spark, corpus, f"{out}/corpus_landing").drop(IO.LANDED)
    latest = A.latest_labels(_read(spark, labels, f"{out}/labels_landing").drop(IO.LANDED))
    IO.write_export_csv(A.export_annotations(items, latest, annotator, name, export_date=export_date),
                        f"{out}/annotated_csv")


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="corpusforge")
    sub = ap.add_subparsers(dest="cmd", required=True)
    c = sub.add_parser("clean")
    c.add_argument("src")
    c.add_argument("out")
    d = sub.add_parser("card")
    d.add_argument("src")
    d.add_argument("out")
    d.add_argument("--started", default=None, help="first day of the collection (default: today)")
    d.add_argument("--ended", default=None, help="last day of the collection (default: today)")
    g = sub.add_parser("collect")
    for name in ("listings", "threads", "channels", "out"):
        g.add_argument(name)
    g.add_argument("--videos-per-channel", type=int, default=K.VIDEOS_PER_CHANNEL)
    g.add_argument("--rows-per-video", type=int, default=K.ROWS_PER_VIDEO)
    g.add_argument("--page", type=int, default=K.PAGE_SIZE)
    g.add_argument("--target", type=int, default=K.TOTAL_TARGET)
    g.add_argument("--no-replies", action="store_true")
    h = sub.add_parser("collect-posts")
    h.add_argument("pages")
    h.add_argument("out")
    h.add_argument("--per-account", type=int, default=K.POSTS_PER_ACCOUNT)
    h.add_argument("--target", type=int, default=K.TOTAL_TARGET)
    e = sub.add_parser("export")
    e.add_argument("corpus")
    e.add_argument("labels")
    e.add_argument("out")
    e.add_argument("--annotator", type=int, default=0)
    e.add_argument("--name", default="annotator")
    e.add_argument("--date", default=None, help="export date stamped on every row (default: today)")
    args = ap.parse_args(argv)
    spark = build_session(master=os.environ.get("SPARK_MASTER"))
    if args.cmd == "clean":
        cmd_clean(spark, args.src, args.out)
    elif args.cmd == "card":
        cmd_card(spark, args.src, args.out, args.started, args.ended)
    elif args.cmd == "collect":
        cmd_collect(spark, args.listings, args.threads, args.channels, args.out, args.videos_per_channel, args.rows_per_video,
                    args.page, args.target, not args.no_replies)
    elif args.cmd == "collect-posts":
        cmd_collect_posts(spark, args.pages, args.out, args.per_account, args.target)
    else:
        cmd_export(spark, args.corpus, args.labels, args.out, args.annotator, args.name, args.date)


if __name__ == "__main__":
    main()
