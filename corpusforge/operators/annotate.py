"""Annotation as tables.

Labels are an append-only event table ``(event_id, ts, item, annotator,
sent, tox, sta)`` keyed by item id, not by row position.  "Re-submitting
overwrites" becomes a grouped ``max_by`` on ``(ts, event_id)``; the nine
distribution counters become one conditional aggregate per annotator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import consts as K
from ..functions import text as T
from ..session import materialize
from .prefix import exclusive_running_sum

CODES = ("sent", "tox", "sta")


def complete_label(sent: Column | None = None, tox: Column | None = None,
                   sta: Column | None = None) -> Column:
    """all three tasks set, each a valid code 0..2."""
    sent = F.col("sent") if sent is None else sent
    tox = F.col("tox") if tox is None else tox
    sta = F.col("sta") if sta is None else sta
    return F.coalesce(sent.between(0, 2) & tox.between(0, 2) & sta.between(0, 2), F.lit(False))


def latest_labels(events: DataFrame) -> DataFrame:
    """D3: the last complete submission per (annotator, item), by (ts, event_id)."""
    ok = events.where(complete_label())
    last = ok.groupBy("annotator", "item").agg(
        F.max_by(F.struct("sent", "tox", "sta", "ts", "event_id"),
                 F.struct("ts", "event_id")).alias("_l"))
    return last.select("annotator", "item", "_l.sent", "_l.tox", "_l.sta", "_l.ts", "_l.event_id")


def attach_labels(corpus: DataFrame, labels: DataFrame, annotator: int,
                  item_col: str = "item") -> DataFrame:
    """Every corpus row left-joined to one annotator's current label."""
    mine = labels.where(F.col("annotator") == annotator).drop("annotator")
    return corpus.join(mine, item_col, "left")


def unannotated_items(corpus: DataFrame, labels: DataFrame, annotator: int,
                      item_col: str = "item") -> DataFrame:
    """Corpus rows the annotator has not labeled."""
    mine = labels.where(F.col("annotator") == annotator).select(item_col)
    return corpus.join(mine, item_col, "left_anti")


def export_annotations(corpus: DataFrame, labels: DataFrame, annotator: int,
                       annotator_name: str, item_col: str = "item",
                       export_date: str | None = None) -> DataFrame:
    """S7 + P21 + P22: corpus rows with the nine export columns (label code 0 is kept as '0').

    ``annotated_by`` and ``annotation_date`` stamp every row, labeled or not,
    with the annotator and the export date (``export_date``, default today).
    """
    j = attach_labels(corpus, labels, annotator, item_col)
    extra = {}
    for task, code, names in K.TASKS:
        extra[f"{task}_label"] = T.decode_label(F.col(code), names)
        extra[f"{task}_numeric"] = F.coalesce(F.col(code).cast("string"), F.lit(""))
    done = complete_label()
    extra["annotated"] = F.when(done, F.lit("true")).otherwise(F.lit("false"))
    extra["annotated_by"] = F.lit(annotator_name)
    extra["annotation_date"] = (F.lit(export_date) if export_date
                                else F.date_format(F.current_date(), "yyyy-MM-dd"))
    return j.withColumns(extra).drop(*CODES, "ts", "event_id")


def label_distribution(labels: DataFrame) -> DataFrame:
    """A7 + P20: per annotator x task x class: count and integer % of annotated (zeros kept)."""
    aggs = [F.count(F.lit(1)).cast("bigint").alias("done")]
    cells = []
    for task, code, names in K.TASKS:
        for k, name in names.items():
            col = f"{code}_{k}"
            aggs.append(F.count(F.when(F.col(code) == k, 1)).cast("bigint").alias(col))
            cells.append((task, k, name, col))
    wide = labels.groupBy("annotator").agg(*aggs)
    stack = ", ".join(f"'{t}', {k}, '{n}', `{c}`" for t, k, n, c in cells)
    long = wide.selectExpr("annotator", "done",
                           f"stack({len(cells)}, {stack}) AS (task, code, label, n)")
    return long.select("annotator", "task", F.col("code").cast("int").alias("code"), "label",
                       F.col("n").cast("bigint").alias("n"),
                       T.pct_int(F.col("n"), F.col("done")).alias("pct"))


def annotation_progress(corpus: DataFrame, labels: DataFrame, item_col: str = "item") -> DataFrame:
    """Per annotator: done, total, remaining and % done; labels of items outside the corpus don't count.

    The corpus size is a scalar subquery, not a join.
    """
    labels = labels.join(corpus.select(F.col(item_col).alias("item")), "item", "left_semi")
    total = corpus.agg(F.count(F.lit(1)).cast("bigint")).scalar()
    per = labels.groupBy("annotator").agg(F.count(F.lit(1)).cast("bigint").alias("done"))
    return per.select("annotator", "done", total.alias("total"),
                      (total - F.col("done")).alias("remaining"),
                      T.pct_one_dp(F.col("done"), total).alias("pct_done"))


def class_imbalance(distribution: DataFrame) -> DataFrame:
    """Per annotator x task: largest / smallest class count (null when a class is empty)."""
    g = distribution.groupBy("annotator", "task").agg(F.max("n").alias("max_n"), F.min("n").alias("min_n"))
    return g.withColumn("imbalance", F.when(F.col("min_n") > 0,
                                            F.round(F.col("max_n") / F.col("min_n"), 4)))


def cursor(events: DataFrame) -> DataFrame:
    """Each annotator's cursor: the item of the latest accepted submission (a rejected one moves nothing)."""
    return events.where(complete_label()).groupBy("annotator").agg(
        F.max_by("item", F.struct("ts", "event_id")).alias("cur"))


def next_unannotated(corpus: DataFrame, labels: DataFrame, events: DataFrame,
                     annotators: Sequence[int] | None = None, item_col: str = "item") -> DataFrame:
    """Per annotator, the first unlabeled item after the cursor, else the first unlabeled, else -1.

    Fully distributed, no per-annotator loop: corpus items get their rank
    (distributed running count), each annotator's labeled ranks form runs,
    and a run *ends* at a labeled rank whose successor is unlabeled (an
    anti-join).  The first free rank at or after a start ``s`` is ``s`` when
    ``s`` is unlabeled, else the smallest run end >= ``s`` plus one — only
    equi-joins and aggregates, so a very active annotator is never one group.
    """
    cur = cursor(events)
    if annotators is not None:
        cur = cur.where(F.col("annotator").isin(list(annotators)))
    # One distributed running count over corpus items (weight 1) and cursors
    # (weight 0): an item's count gives its rank, a cursor's count gives the
    # number of items at or before it — also for a cursor outside the corpus.
    pts = (corpus.select(F.col(item_col).alias("_pos")).distinct()
           .select("_pos", F.lit(1).alias("_one"), F.lit(0).alias("_kind"),
                   F.lit(None).cast(cur.schema["annotator"].dataType).alias("annotator"))
           .unionByName(cur.select(F.col("cur").alias("_pos"), F.lit(0).alias("_one"), F.lit(1).alias("_kind"),
                                   "annotator")))
    # both tables below are read several times: each is written once and re-read
    counted = materialize(exclusive_running_sum(pts, ["_pos", "_kind", "annotator"], "_one", "_before"),
                          "ranks")
    ranked = counted.where(F.col("_kind") == 0).select(F.col("_pos").alias(item_col),
                                                       (F.col("_before") + 1).alias("_rank"))
    n_items = ranked.agg(F.count(F.lit(1))).scalar()
    lab = materialize(labels.select("annotator", item_col).join(ranked, item_col).select("annotator", "_rank"),
                      "labeled_ranks")
    successor_labeled = lab.select("annotator", (F.col("_rank") - 1).alias("_rank"))
    ends = lab.join(successor_labeled, ["annotator", "_rank"], "left_anti") \
        .select("annotator", F.col("_rank").alias("_end"))
    starts = counted.where(F.col("_kind") == 1).select(
        "annotator", (F.col("_before") + 1).cast("bigint").alias("_s1"), F.lit(1).cast("bigint").alias("_s0"))

    def first_free(df: DataFrame, s: str, out: str) -> DataFrame:
        taken = lab.select("annotator", F.col("_rank").alias(s), F.lit(True).alias("_taken"))
        x = df.join(taken, ["annotator", s], "left")
        run_end = (x.join(ends, "annotator")
                   .where(F.col("_end") >= F.col(s))
                   .groupBy("annotator").agg(F.min("_end").alias("_e")))
        y = x.join(run_end, "annotator", "left")
        free = F.when(F.col("_taken").isNull(), F.col(s)).otherwise(F.col("_e") + 1)
        return y.withColumn(out, F.when(free <= n_items, free)).drop("_taken", "_e")

    picked = first_free(first_free(starts, "_s1", "_r1"), "_s0", "_r0")
    chosen = picked.select("annotator", F.coalesce("_r1", "_r0").alias("_rank"))
    return (chosen.join(ranked, "_rank", "left")
            .select("annotator", F.coalesce(F.col(item_col).cast("bigint"), F.lit(-1).cast("bigint"))
                    .alias("next_item")))


def milestone_reached(events: DataFrame, milestone: int = K.MILESTONE) -> DataFrame:
    """Per annotator, the submission that made the ``milestone``-th distinct labeled item.

    The rank filter ``<= milestone`` lets Spark keep only a per-partition
    top-N before the shuffle, so a very active annotator is never one group.
    """
    firsts = events.where(complete_label()).groupBy("annotator", "item").agg(
        F.min_by(F.struct("ts", "event_id"), F.struct("ts", "event_id")).alias("_f"))
    w = Window.partitionBy("annotator").orderBy(F.col("_f.ts"), F.col("_f.event_id"), F.col("item"))
    ranked = firsts.withColumn("n_labeled", F.row_number().over(w)).where(F.col("n_labeled") <= milestone)
    return ranked.where(F.col("n_labeled") == milestone).select(
        "annotator", "item", F.col("_f.event_id").alias("event_id"),
        F.date_format("_f.ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.col("n_labeled").cast("bigint").alias("n_labeled"))
