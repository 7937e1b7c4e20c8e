"""Versioned tables in a shared folder: whole versions beside each other and one small pointer file that names the current one.

A version is written under its own folder first; only then is the pointer replaced (written beside and renamed over the old one),
so a reader sees the version before or the version after, and a job that dies between leaves the old version current.  Writing the
same version again, as a replayed batch does, replaces its own folder.  Old versions are removed after the pointer has moved;
the last ``keep`` stay for readers that still hold them.  All access goes through the folder's own Hadoop file system.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers ``n`` of the folders ``name=<n>`` under ``path``, ascending (none if there is no such folder)."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(int(f.split("=", 1)[1]) for f in found if f.startswith(f"{name}=") and f.split("=", 1)[1].isdigit())


def read_pointer(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """What the pointer of a versioned table says (``version`` and what was published with it), or None."""
    fs, p = _fs(spark, f"{path}/{POINTER}")
    if not fs.exists(p):
        return None
    return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(p), "UTF-8"))


def write_pointer(spark: SparkSession, path: str, says: dict[str, Any]) -> None:
    """Replace the pointer in one step."""
    jvm = spark.sparkContext._jvm
    fs, old = _fs(spark, f"{path}/{POINTER}")
    new = jvm.org.apache.hadoop.fs.Path(f"{path}/_{POINTER}.new")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(says).encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(new, old, options)


def publish(df: DataFrame, path: str, version: int, keep: int = 2, fmt: str = "parquet", **says: Any) -> None:
    """Write ``df`` as ``version`` of the table at ``path``, make it current, remove all but the last ``keep`` versions."""
    spark = df.sparkSession
    df.write.mode("overwrite").format(fmt).save(f"{path}/version={version}")
    write_pointer(spark, path, {"version": version} | says)
    older = [v for v in numbered(spark, path, "version") if v < version]
    for v in older[:len(older) - keep + 1] if keep > 1 else older:
        remove(spark, f"{path}/version={v}")


def read_current(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame | None:
    """The current version of the table at ``path`` (None: nothing published yet)."""
    says = read_pointer(spark, path)
    if says is None:
        return None
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(f"{path}/version={says['version']}")
