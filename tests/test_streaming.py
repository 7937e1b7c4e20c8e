"""Streams drained with availableNow must give the batch answer."""

import datetime as dt
import os
import shutil

from pyspark.sql import functions as F

from corpusforge.operators import annotate as A
from corpusforge.operators import clean as C
from corpusforge.plans import queries as Q
from corpusforge.plans import views as V
from corpusforge.session import scratch_path
from corpusforge.sources import versions
from corpusforge.streaming import jobs as ST


def _clean(df):
    return sorted((r.comment_id, r.ord, r.text, r.text_original) for r in df.collect())


def test_stream_clean_equals_batch(spark, sf_dir):
    batch = _clean(C.clean_corpus(V.view(spark, sf_dir, "corpus_fx")))
    assert _clean(Q.REGISTRY["stream_clean"](spark, sf_dir)) == batch and batch


def _file_stream(spark, schema, parts, name):
    """A stream of one file per element of ``parts`` (its rows), in that order, one file a micro-batch."""
    base = scratch_path(spark, name)
    local = base[len("file:"):] if base.startswith("file:") else base
    os.makedirs(local)
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}-{i}")
        part = next(f for f in os.listdir(f"{local}-{i}") if f.startswith("part-"))
        shutil.copy(f"{local}-{i}/{part}", f"{local}/{i}.parquet")
        os.utime(f"{local}/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base)


COMMENTS = "comment_id long, text string, ord long"


def test_stream_clean_over_several_batches(spark):
    """Earlier batches win over smaller orders; a hot key passes the keyed state once a batch; a second run adds nothing twice."""
    hot = [(1000 + i, "Hot  spam comment" + " 👍" * (i % 3), i) for i in range(3000)]
    parts = [[(1, "first good comment 👍", 9), (2, "First  good comment", 5), (3, None, 1), *hot],
             [(4, "first good comment", 1), (5, " second good comment\t", 2), (6, "hi", 3), *hot],
             [(7, "third good comment", None), (8, "third good comment", 4), (9, "SECOND good comment", 1), *hot],
             [(10, "👍", 1)]]
    stream = _file_stream(spark, COMMENTS, parts, "t_clean_batches")
    out, ck = ST.scratch_pair(spark, "t_clean_out")
    staged = []
    real = C.first_rows

    def counted(*args, **kw):
        df = real(*args, **kw)
        staged.append(df.count())
        return df

    C.first_rows = counted
    try:
        ST.stream_clean(stream, out, ck)
    finally:
        C.first_rows = real
    got = _clean(spark.read.parquet(out))
    assert got == [(2, 5, "First  good comment", "First  good comment"), (5, 2, "second good comment", "second good comment"),
                   (8, 4, "third good comment", "third good comment"), (1000, 0, "Hot  spam comment", "Hot  spam comment")]
    assert staged == [2, 3, 3, 0]          # of 9,000 hot rows three reach the state
    ST.stream_clean(stream, out, ck)       # a restart on the same checkpoint finds nothing new
    assert _clean(spark.read.parquet(out)) == got


def test_stream_label_distribution_equals_batch(spark, sf_dir):
    streamed = {tuple(r) for r in Q.REGISTRY["stream_label_distribution"](spark, sf_dir).collect()}
    batch = {tuple(r) for r in A.label_distribution(A.latest_labels(V.view(spark, sf_dir, "label_events_fx"))).collect()}
    assert streamed == batch


def test_stream_rate_closed_windows(spark, sf_dir):
    out = Q.REGISTRY["stream_rate"](spark, sf_dir)
    ev = V.view(spark, sf_dir, "label_events_fx")
    last = ev.agg(F.max("ts")).first()[0].strftime("%Y-%m-%d %H:%M:%S")
    rows = out.collect()
    assert rows and all(r.window_end <= last for r in rows)
    per_day = ev.groupBy(F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd HH:mm:ss").alias("d"),
                         "annotator").count()
    expect = {(r.d, r.annotator): r["count"] for r in per_day.collect()}
    assert all(expect[(r.window_start, r.annotator)] == r.n for r in rows)


def test_stream_clean_with_watermark(spark, sf_dir):
    stream = Q._stream_corpus(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    out, ck = ST.scratch_pair(spark, "t_wm")
    ST.stream_clean(stream, out, ck, event_time="ts", delay="1 hour")
    assert _clean(spark.read.parquet(out)) == _clean(C.clean_corpus(V.view(spark, sf_dir, "corpus_fx")))


LABELS = "event_id long, ts timestamp, item long, annotator int, sent int, tox int, sta int"


def test_relabels_across_batches_and_compactions(spark):
    """Seven batches, a version every second one: re-labels replace older labels whichever batch or version holds them."""
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    parts = [[(10 * b + i, at(b if i != 2 else 20 - b), i % 4, i % 2, (b + i) % 3, b % 3, None if i == 3 and b % 2 else 1) for i in range(6)]
             for b in range(7)]
    out, ck = ST.scratch_pair(spark, "t_versions")
    stream = _file_stream(spark, LABELS, parts, "t_label_batches")
    ST.stream_latest_labels(stream, out, ck, compact_every=2)
    events = spark.createDataFrame([r for p in parts for r in p], LABELS)
    cols = ("annotator", "item", "sent", "tox", "sta", "event_id")
    want = sorted(tuple(r[c] for c in cols) for r in A.latest_labels(events).collect())
    assert sorted(tuple(r[c] for c in cols) for r in ST.current_labels(spark, out).collect()) == want
    assert versions.read_pointer(spark, f"{out}/compacted")["version"] == 5
    assert versions.numbered(spark, f"{out}/compacted", "version") == [3, 5]
    assert versions.numbered(spark, f"{out}/changes", "batch_id") == [4, 5, 6]


def test_published_version_is_current_and_old_ones_go(spark):
    path = scratch_path(spark, "t_publish")
    assert versions.read_current(spark, path) is None and versions.numbered(spark, path, "version") == []
    for v in (1, 2, 2, 5):
        versions.publish(spark.range(v), path, v, note=f"n{v}")
    assert versions.read_current(spark, path).count() == 5
    assert versions.read_pointer(spark, path) == {"version": 5, "note": "n5"}
    assert versions.numbered(spark, path, "version") == [2, 5]


def _folder_tables(spark, sf_dir, name, cuts):
    """The table ``name`` as a folder of files, later keys first, beside nothing else; returns the data folder."""
    base = scratch_path(spark, f"t_folder_{name}")
    key = V.SPREAD_KEYS[name]
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df.repartitionByRange(cuts, F.col(key).desc()).write.parquet(f"{base}/{name}.parquet")
    return base


def test_stream_of_a_table_in_several_files(spark, sf_dir):
    """A table that is a folder of files is read whole, and its cut into files changes nothing."""
    base = _folder_tables(spark, sf_dir, "documents", 3)
    assert len(spark.read.parquet(f"{base}/documents.parquet").inputFiles()) == 3
    whole = _clean(C.clean_corpus(V.view(spark, sf_dir, "corpus_fx")))
    assert _clean(Q.REGISTRY["stream_clean"](spark, base)) == whole and whole
    base = _folder_tables(spark, sf_dir, "events", 3)
    for name in ("stream_rate", "stream_label_distribution"):
        want = sorted(tuple(r) for r in Q.REGISTRY[name](spark, sf_dir).collect())
        assert sorted(tuple(r) for r in Q.REGISTRY[name](spark, base).collect()) == want and want
