"""Line dedup with levelled sorted runs of line hashes.

A line's key is the line stripped of white space and with A-Z lowered; keys of at least ``min_chars``
code points take part.  ``LineRuns`` keeps, in the shared folder, sorted runs of (digest, n_docs, last_doc):
the 128-bit digest of a key, the number of documents that hold it and the largest of their ids.  A new
batch of documents makes one run at level 0 and is merge-anti-joined with the runs that are there; as
soon as a level holds ``fanout`` runs they are compacted into one run of the next level.  The runs are
written in digest order (range partitioned and sorted), so joins and merges are sort-merge steps over
rows of a few bytes and texts never take part.

Nulls and empty texts are one empty line.  A document that is given twice under one id counts once for
a line; both rows lose the same lines.  A null id counts as a document of its own kind but never as the
one that keeps the line (unless all ids are null: then those rows keep it).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import SPACE, ascii_lower, text_of

MIN_CHARS, MIN_DOCS = 20, 3
BATCHES, FANOUT = 4, 2


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def digest(key: Column) -> Column:
    return F.unhex(F.md5(key.cast("binary")))


def line_digests(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, content, place, digest): every line whose key takes part, by its place in the row's text; ``content`` is a hash of it."""
    texts = docs.select("doc_id", F.xxhash64(text_of()).alias("content"), F.split(text_of(), "\n", -1).alias("lines"))   # once per text
    lines = texts.select("doc_id", "content", F.posexplode("lines").alias("place", "line"))
    return (lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
            .select("doc_id", "content", "place", digest(F.col("key")).alias("digest")))


@dataclass
class LineRuns:
    """Sorted runs by level.  Batches must not share documents."""

    fanout: int = FANOUT
    levels: dict[int, list[DataFrame]] = field(default_factory=dict)

    @property
    def runs(self) -> list[DataFrame]:
        return [r for level in sorted(self.levels) for r in self.levels[level]]

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch (doc_id, digest); returns its run rows whose digest no earlier run holds."""
        # distinct first: a hot line spreads over its documents, then adds up per task
        run = (lines.dropDuplicates(["digest", "doc_id"]).groupBy("digest")
               .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc")))
        new = self._write(run, "line_run")
        fresh = new
        for old in self.runs:
            fresh = fresh.join(old.select("digest"), "digest", "left_anti")
        self.levels.setdefault(0, []).append(new)
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            merged = self._write(_merge(self.levels.pop(level)), f"line_run_l{level + 1}")
            self.levels.setdefault(level + 1, []).append(merged)
            level += 1
        return fresh

    def totals(self) -> DataFrame:
        """(digest, n_docs, last_doc) over all runs."""
        runs = self.runs
        return runs[0] if len(runs) == 1 else _merge(runs)

    @staticmethod
    def _write(run: DataFrame, name: str) -> DataFrame:
        return materialize(run.sortWithinPartitions("digest"), name)


def _merge(runs: list[DataFrame]) -> DataFrame:
    """Merge runs pairwise on the digest: counts add up, the larger id stays."""
    out = runs[0]
    for r in runs[1:]:
        r = r.select("digest", F.col("n_docs").alias("_n"), F.col("last_doc").alias("_d"))
        out = out.join(r, "digest", "full_outer").select(
            "digest", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n_docs"),
            F.greatest("last_doc", "_d").alias("last_doc"))
    return out


def drop_lists(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES,
               fanout: int = FANOUT) -> DataFrame:
    """(doc_id, content, drop): the places of the lines that a document's text loses (only texts that lose some)."""
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    lines = materialize(line_digests(docs, min_chars).withColumn("batch", batch), "line_digests")
    runs = LineRuns(fanout)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b).select("doc_id", "digest"))
    repeated = runs.totals().where(F.col("n_docs") >= min_docs)
    # in repeated rows a few digests have many documents: the join splits hot keys (AQE), the sets are per text
    hit = lines.join(repeated, "digest").where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    return hit.groupBy("doc_id", "content").agg(F.collect_set("place").alias("drop"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES,
                fanout: int = FANOUT, counts: bool = True) -> DataFrame:
    """All columns of ``docs`` with ``text`` rewritten, and, if ``counts``, n_lines (before) and n_dropped in place of columns so called.

    A line whose key is held by at least ``min_docs`` documents stays only in the one with the largest id.  Work is linear in
    the lines of a document: the places that stay are a set difference, and their lines are looked up by place.
    """
    drops = drop_lists(docs.select("doc_id", "text"), min_chars, min_docs, batches, fanout)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_key"),
                       F.xxhash64(text_of()).alias("_content"))
    on = F.col("_key").eqNullSafe(F.col("doc_id")) & (F.col("_content") == F.col("content"))
    split = (rows.join(drops, on, "left").select("_row", "drop", F.coalesce("_row.text", F.lit("")).alias("_text"))
             .withColumn("_lines", F.split("_text", "\n", -1)))
    stays = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("drop"))
    placed = split.withColumn("_stays", F.when(F.col("drop").isNotNull(), stays))
    text = F.when(F.col("drop").isNull(), F.col("_text")).otherwise(
        F.array_join(F.transform("_stays", lambda i: F.col("_lines")[i]), "\n"))
    n_dropped = F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size("drop"))
    told = {"n_lines": F.size("_lines").cast("bigint"), "n_dropped": n_dropped.cast("bigint")} if counts else {}
    own = [text.alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in told]
    return placed.select(*own, *[x.alias(c) for c, x in told.items()])
