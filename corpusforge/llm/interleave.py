"""Proportional stratified interleaving of documents into shards (law ``rows``).

1. Rows are shuffled inside each source by a seeded hash of their id and ranked there.
2. Row ``r`` (from 0) of a source with ``n`` rows gets the fractional rank ``(2r + 1) / 2n``; sorted by it, every source runs
   evenly through the whole order.
3. The order is cut into shards of equal row counts (at most one apart), so each shard holds every source in its share of the
   whole, and reading a shard front to back meets the mixture at any place.

Both orders are range-partitioned sorts over narrow rows that are written once; a rank is the row's place in its written
partition plus the counts of the partitions before.  Only those counts (one row per partition, or per source and partition) are
gathered, so neither a source with a third of the rows nor any shard is ever one task's work.

Defined cases: a null source is a source of its own; a null or empty text has size 1; rows that are alike in all that orders them
(null or repeated ids, repeated rows) are ordered by their place in the input, so they still get slots of their own; an empty
table gives no rows; texts of any length count by their bytes and are not shuffled unless the caller keeps them.  Columns named
``shard`` or ``slot`` among those kept are replaced; all kept columns travel in one struct, so no other name can clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SHARDS = 16
SEED = "interleave-1"


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def text_crc32(text: str = "text") -> Column:
    """Unsigned crc32 of the text's UTF-8 bytes (null: of none)."""
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def shuffle_key(key: str, seed: str) -> Column:
    """60 bits of the seeded digest of a row's id: the same order for the same seed on any engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _placed(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` in a range-partitioned total order, written once, with partition ``_pid`` and place ``_at`` (dense within ``_pid``)."""
    tagged = rows.orderBy(*order).withColumns({"_pid": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    return materialize(tagged, name)


def interleave(docs: DataFrame, n_shards: int = SHARDS, source: str = "source", key: str = "doc_id", text: str = "text",
               seed: str = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns (default: ``key``) of every row, its ``size``, ``text_crc32``, ``shard`` and ``slot`` (from 0, gapless).

    Counts of shards differ by at most one.  Pass ``keep=docs.columns`` to carry the texts along, as :func:`write_shards` needs them.
    """
    own = ("size", "text_crc32", "shard", "slot")
    kept = [c for c in (keep or (key,)) if c not in own]
    narrow = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), text_size(text).alias("size"), text_crc32(text).alias("text_crc32"),
        F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source).cast("string"))).alias("_source"),
        shuffle_key(key, seed).alias("_key"), F.col(key).alias("_id"), F.monotonically_increasing_id().alias("_in"))
    rows = materialize(narrow, "interleave_rows")

    # rank within the source: place among the partition's rows of that source + rows of the source in the partitions before
    ranked = _placed(rows, ("_source", "_key", "_id", "text_crc32", "_in"), "interleave_ranked")
    parts = ranked.groupBy("_source", "_pid").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    of_source = Window.partitionBy("_source")
    before = of_source.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_source", "_pid", (F.col("_first") - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_zero"),
                          F.sum("_n").over(of_source).alias("_total"))
    rank = F.col("_at") - F.col("_zero")
    fraction = (2 * rank + 1).cast("double") / (2 * F.col("_total")).cast("double")
    shares = ranked.join(starts, ["_source", "_pid"]).select("_row", "size", "text_crc32", "_source", fraction.alias("_fraction"))

    # place in the whole order, then cut; equal fractions of different sources are ordered by source
    whole = _placed(shares, ("_fraction", "_source"), "interleave_order")
    counts = whole.groupBy("_pid").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ordered = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)     # one row per partition
    zero = counts.select("_pid", (F.col("_first") - F.coalesce(F.sum("_n").over(ordered), F.lit(0))).alias("_zero"),
                         F.sum("_n").over(Window.partitionBy()).alias("_total"))
    placed = (whole.join(F.broadcast(zero), "_pid").withColumn("_place", F.col("_at") - F.col("_zero"))
              .withColumn("shard", F.expr(f"cast(_place * {n_shards} div _total as int)")))
    first = F.expr(f"(shard * _total + {n_shards - 1}) div {n_shards}")             # least place of the shard
    return placed.select("_row.*", "size", "text_crc32", "shard", (F.col("_place") - first).cast("bigint").alias("slot"))


def write_shards(assigned: DataFrame, path: str, n_parts: int) -> None:
    """One folder ``shard=<k>`` each, its rows in slot order over the files' order; ``n_parts`` files or more in all."""
    (assigned.repartitionByRange(n_parts, "shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode("errorifexists").partitionBy("shard").parquet(path))
