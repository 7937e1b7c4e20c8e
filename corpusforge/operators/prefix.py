"""Distributed exclusive running sum over a total order.

Budgets (W4, W5) need "rows collected before this video/account" in a global
order.  An unpartitioned window would pull every row into one task, so the
sum is computed in three distributed steps instead:

1. a range-partitioned sort on the order key (balanced by sampling, a hot
   value cannot pile up because the full key is unique), each row tagged
   with its partition id; the result is written once as a table in the
   shared checkpoint folder, so partition ids survive executor loss and
   recompute (one pass, unlike ``DataFrame.checkpoint`` which computes its
   input twice);
2. a running sum inside each partition (window partitioned by that id);
3. per-partition totals -> offsets over at most ``numPartitions`` rows,
   broadcast back (its size is bounded by the partition count, not the data).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def exclusive_running_sum(df: DataFrame, order_cols: Sequence[Column | str], value_col: str,
                          out_col: str = "prefix_before") -> DataFrame:
    """Add ``out_col`` = sum of ``value_col`` over all rows strictly before, in ``order_cols`` order.

    ``order_cols`` must define a total order (end with a unique column).
    """
    spark = df.sparkSession
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    tagged = df.orderBy(*order).withColumn("_pid", F.spark_partition_id())
    path = scratch_path(spark, "prefix")
    tagged.write.mode("errorifexists").parquet(path)
    frozen = spark.read.parquet(path)
    local_w = (Window.partitionBy("_pid").orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, -1))
    local = frozen.withColumn("_local", F.coalesce(F.sum(value_col).over(local_w), F.lit(0)))
    totals = frozen.groupBy("_pid").agg(F.sum(value_col).alias("_ptot"))
    off_w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_ptot").over(off_w), F.lit(0)).alias("_off"))
    out = local.join(F.broadcast(offsets), "_pid")
    return (out.withColumn(out_col, (F.col("_local") + F.col("_off")).cast("bigint"))
            .drop("_pid", "_local", "_off"))
