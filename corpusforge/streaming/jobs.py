"""Structured Streaming jobs.

Each job reads a file stream, writes to a file sink with its own checkpoint
location under the shared checkpoint folder (restartable after executor or
driver loss), and can run as ``availableNow`` (drain what is there, stop) or
on a processing-time trigger.

* T1 cleans arriving comments, collapses repeats inside each micro-batch and
  drops keys seen before with keyed state on digests (RocksDB state store).
* T2 keeps the latest label per (annotator, item) as a streaming
  aggregation (``max_by`` by (ts, event_id)) in update mode; every batch's
  changed rows are written, idempotently per batch id, beside a versioned
  label table.  The live distribution is the A7 aggregate over the newest
  change per key, so a re-label replaces the old one (retraction without a
  custom operator).
* T3 counts labels per day and annotator with a watermark, append mode:
  a day is emitted once the watermark passes its end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import consts as K
from ..functions import text as T
from ..operators import annotate as A
from ..operators import clean as C
from ..session import scratch_path
from ..sources import versions


def _run(writer, available_now: bool = True, processing_time: str | None = None):
    if available_now:
        q = writer.trigger(availableNow=True).start()
    else:
        q = writer.trigger(processingTime=processing_time or "10 seconds").start()
    if available_now:
        q.awaitTermination()
    return q


def file_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int | None = None,
                spread_key: str | None = None) -> DataFrame:
    """One driver table, a file or a folder of files, as a file stream (schema taken from the table).

    Without ``max_files`` all files that lie there when the stream starts
    arrive together, as one micro-batch: which row comes first, and which
    one is late, then does not depend on how the table is cut into files.

    With ``spread_key``, each micro-batch is hash-repartitioned on that key
    when a batch scan of the same files yields fewer splits than cores (the
    same rule as ``views.spread``); files with many row groups are left as
    they are.
    """
    batch = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    # the braces make the path a pattern: a stream's plain path has to be a folder
    reader = spark.readStream.schema(batch.schema)
    reader = reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(f"{sf_dir}/{{{table}}}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread_key and batch.rdd.getNumPartitions() < cores:
        stream = stream.repartition(cores, spread_key)
    return stream


# --- T1 ----------------------------------------------------------------------

def stream_clean(comments: DataFrame, out_path: str, checkpoint: str,
                 block: K.ScriptBlock = K.TELUGU, min_words: int = K.MIN_WORDS,
                 available_now: bool = True, event_time: str | None = None, delay: str = "7 days",
                 order_col: str = "ord", id_col: str | None = None):
    """Rules 1–3 + emoji strip on arriving rows, first arrival per normalized key kept.

    Of one micro-batch the first row (in the cleaner's total order) of a key
    stands for all: a grouped aggregation with map-side combine, so a key
    that a third of the rows share reaches the keyed state once a batch.
    Those rows are written to a staging folder under the batch's id (a
    replayed batch replaces its own) and pass a second query, drained
    before the next batch starts, whose state holds the 128-bit digest of
    every key seen and no text.  So earlier batches win, and within a batch
    the earlier row.  Rows carry one text, the trimmed one, until the kept
    ones are written; staged files are removed once they are processed.

    Without ``event_time`` every digest ever seen is kept in state (exact
    answer; 16 bytes a key, partitioned by key).  With ``event_time`` the
    state is bounded by the watermark (``dropDuplicatesWithinWatermark``):
    repeats further apart than ``delay`` both pass, so the batch D1 stays
    the reference answer.
    """
    staging = f"{checkpoint}/staging"

    def collapse(batch: DataFrame, batch_id: int) -> None:
        firsts = C.first_rows(batch, "text", order_col, block, min_words, id_col)
        firsts.write.mode("overwrite").parquet(f"{staging}/batch_id={batch_id}")
        staged = (batch.sparkSession.readStream.schema(firsts.schema).option("cleanSource", "delete")
                  .parquet(staging).drop("batch_id"))
        if event_time:
            deduped = staged.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(C.DIGEST))
        else:
            deduped = staged.dropDuplicates(list(C.DIGEST))
        kept = deduped.drop(*C.DIGEST).withColumn("text", T.strip_emoji("text_original"))
        _run(kept.select(*batch.columns, "text_original").writeStream.format("parquet").option("path", out_path)
             .option("checkpointLocation", f"{checkpoint}/keys").outputMode("append"))

    return _run(comments.writeStream.option("checkpointLocation", f"{checkpoint}/batches").foreachBatch(collapse), available_now)


# --- T2 ----------------------------------------------------------------------

LABEL_COLS = ("sent", "tox", "sta", "ts", "event_id")


def _newest(df: DataFrame) -> DataFrame:
    """Newest label per (annotator, item) by (ts, event_id) — a partial-aggregating max_by."""
    last = df.groupBy("annotator", "item").agg(
        F.max_by(F.struct(*LABEL_COLS), F.struct("ts", "event_id")).alias("_l"))
    return last.select("annotator", "item", "_l.*")


def stream_latest_labels(events: DataFrame, table_path: str, checkpoint: str,
                         available_now: bool = True, compact_every: int = 20):
    """Latest complete label per (annotator, item); changed keys written per batch, compacted now and then.

    Every ``compact_every`` batches the label table up to that batch is
    published as a new version (see ``sources.versions``): newest per key
    over the version before and the changes since.  Changes that the
    version *before* already held are then removed, so a reader that still
    holds the older pointer finds its files, and there are never more than
    about ``2 * compact_every`` change folders and two versions.
    """
    latest = (events.where(A.complete_label())
              .groupBy("annotator", "item")
              .agg(F.max_by(F.struct(*LABEL_COLS), F.struct("ts", "event_id")).alias("_l")))

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Overwriting the batch's own folder makes a replayed batch idempotent.
        (batch.select("annotator", "item", "_l.*")
         .write.mode("overwrite").parquet(f"{table_path}/changes/batch_id={batch_id}"))
        if not compact_every or batch_id % compact_every != compact_every - 1:
            return
        before = versions.read_pointer(spark, f"{table_path}/compacted")
        if before is None or before["version"] < batch_id:   # else: a replay of a batch whose version is out already
            versions.publish(current_labels(spark, table_path), f"{table_path}/compacted", batch_id)
            for n in versions.numbered(spark, f"{table_path}/changes", "batch_id"):
                if before is not None and n <= before["version"]:
                    versions.remove(spark, f"{table_path}/changes/batch_id={n}")

    w = (latest.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(sink))
    return _run(w, available_now)


def current_labels(spark: SparkSession, table_path: str) -> DataFrame:
    """The label table as of the last completed batch: newest change per key.

    Reads the version that the pointer names and the change folders after
    it; older history is never scanned.
    """
    says = versions.read_pointer(spark, f"{table_path}/compacted")
    upto = -1 if says is None else says["version"]
    recent = [n for n in versions.numbered(spark, f"{table_path}/changes", "batch_id") if n > upto]
    parts = [spark.read.parquet(f"{table_path}/changes/batch_id={n}") for n in recent]
    if says is not None:
        parts.append(spark.read.parquet(f"{table_path}/compacted/version={upto}"))
    if not parts:
        raise ValueError(f"no label batches under {table_path}")
    cols = ["annotator", "item", *LABEL_COLS]
    return _newest(reduce(DataFrame.unionByName, [p.select(*cols) for p in parts]))


# --- T3 ----------------------------------------------------------------------

def stream_rate(events: DataFrame, out_path: str, checkpoint: str, window: str = "1 day",
                delay: str = "0 seconds", available_now: bool = True):
    """Labels per (day window, annotator), emitted when the window closes."""
    counts = (events.withWatermark("ts", delay)
              .groupBy(F.window("ts", window).alias("w"), "annotator")
              .agg(F.count(F.lit(1)).cast("bigint").alias("n")))
    out = counts.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                        F.date_format("w.end", "yyyy-MM-dd HH:mm:ss").alias("window_end"),
                        "annotator", "n")
    w = (out.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    return _run(w, available_now)


def scratch_pair(spark: SparkSession, name: str) -> tuple[str, str]:
    """(output path, checkpoint path) for a streaming job under the shared folder."""
    base = scratch_path(spark, name)
    return f"{base}/out", f"{base}/_checkpoint"
