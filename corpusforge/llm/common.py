"""Helpers shared by the training-data operators.

Every operator reads plain DataFrames with the columns of ``documents``
(``doc_id``, ``text``) or ``pages``; other columns are ignored or passed
through.  Null texts count as empty texts.
"""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: the white space of the contracts, ``[\x20\x09-\x0D]``
SPACE = " \t\n\x0b\f\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes of text that one grouped task works on
BLOCK_BYTES = 8 << 20
#: rows and bytes of an Arrow batch that a Python worker gets at once
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


_SHIPPED: set[str] = set()   # applications whose executors have the package


def write_shared(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a small file into the shared folder, whatever file system that is on; returns its address."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{name}")
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    for lo in range(0, len(data), 8 << 20):
        out.write(bytearray(data[lo:lo + (8 << 20)]))
    out.close()
    return target.toString()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (once per application).

    Texts may be long: Arrow batches are bounded by rows and bytes, so that a worker holds a few MB of them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(top)))
    spark.sparkContext.addPyFile(write_shared(spark, f"package-{uuid.uuid4().hex[:12]}.zip", buffer.getvalue()))
    _SHIPPED.add(app)


def release_memory() -> None:
    """Give freed memory back to the system: Python workers stay alive between tasks, and what they hold counts."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):      # not the GNU C library
        pass


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInPandas`` with the package at hand in the workers."""
    ship_package(df.sparkSession)
    return df.mapInPandas(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id: str, k: int) -> Column:
    """crc32 of the id as text, modulo ``k`` (a null id falls in no fold)."""
    return F.crc32(F.col(doc_id).cast("string")) % k


def ascii_lower(c: Column) -> Column:
    """A-Z lowered, every other character kept."""
    return F.translate(c, UPPER, LOWER)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


class Carried:
    """Columns that travel through a task under names of their own (``c0``, ``c1``, ...), so that no name of a table can clash with
    the names an operator uses; :meth:`back` gives them their names again."""

    def __init__(self, df: DataFrame, names: list[str] | tuple[str, ...]):
        kinds = dict(df.dtypes)
        self.names, self.own = list(names), [f"c{i}" for i in range(len(names))]
        self.columns = [F.col(f"`{n}`").alias(c) for n, c in zip(self.names, self.own)]
        self.schema = ", ".join(f"{c} {kinds[n]}" for n, c in zip(self.names, self.own))

    def back(self, without: tuple[str, ...] | list[str] = ()) -> list[Column]:
        return [F.col(c).alias(n) for n, c in zip(self.names, self.own) if n not in without]


def block_count(docs: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """Number of blocks so that one holds about ``block_bytes`` of text (one cheap scan)."""
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("b")).first()["b"] or 0
    return max(1, -(-int(total) // block_bytes))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int) -> DataFrame:
    """Rows to learn from: (doc_id, label), at most about ``bound`` of them, so they may be broadcast.

    Texts that several labelled rows share count once per label (the smallest id stands for them).
    Beyond ``bound`` labels a hash of the id picks the share that is used; this is the documented
    bound of the fitted sample, no other row is left out.
    """
    lab = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn)
           .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")))
    n = lab.count()
    if n > bound:
        lab = lab.where(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1_000_000)) < int(1e6 * bound / n))
    rows = docs.select("doc_id", F.md5(text_of().cast("binary")).alias("_d")).join(F.broadcast(lab), "doc_id")
    return rows.groupBy("_d", "label").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "label")


def fit_logistic(x: np.ndarray, y1: np.ndarray, y0: np.ndarray) -> tuple[float, float]:
    """Platt's calibration on binned scores: x, and the weights of label 1 and 0 in each bin."""
    n1, n0 = float(y1.sum()), float(y0.sum())
    t1, t0 = (n1 + 1) / (n1 + 2), 1 / (n0 + 2)
    a, b = float(np.log((n1 + 1) / (n0 + 1))), 0.0
    scale = max(1e-9, float(np.abs(x).max(initial=0)))
    z = x / scale
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * z, -35, 35)))
        w = (y1 + y0) * np.maximum(p * (1 - p), 1e-9)
        g = y1 * (t1 - p) + y0 * (t0 - p)
        ga, gb = g.sum(), (g * z).sum() - 1e-3 * b
        haa, hab, hbb = w.sum() + 1e-9, (w * z).sum(), (w * z * z).sum() + 1e-3
        det = haa * hbb - hab * hab
        if not np.isfinite(det) or det < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 4.0 / max(abs(da), abs(db), 1e-9))
        a, b = a + step * da, b + step * db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b / scale)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
