"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: UTC (timestamps are ISO strings in UTC), AQE
# with skew-join splitting (hot dedup keys / hot threads), no UI server.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # ~128 MiB scan splits keep long-text partitions within executor memory.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "corpusforge", extra: dict | None = None) -> SparkSession:
    """Session with the settings the jobs rely on.

    ``master=None`` keeps the master given by ``spark-submit`` (falls back to
    ``local[*]`` when none is configured).  On a cluster pass a shuffle
    partition count sized to the data (AQE coalesces small partitions).
    """
    from pyspark import SparkConf
    if master is None and not SparkConf().contains("spark.master"):
        master = "local[*]"
    b = SparkSession.builder.appName(app_name)
    if master is not None:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is created only when the session has none (tests,
    local runs); on a cluster the configured shared folder is used as is.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d.rstrip("/")
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a shared folder "
                               "(jobs write lineage cuts and stream checkpoints there)")
        conf = tempfile.mkdtemp(prefix="corpusforge-ckpt-")  # local runs / tests only
    sc.setCheckpointDir(conf)
    return (sc.getCheckpointDir() or conf).rstrip("/")


def materialize(df, name: str):
    """Write ``df`` once as a table under the shared checkpoint folder and read it back.

    A lineage cut for an intermediate consumed more than once: the upstream
    runs once, and a lost executor re-reads the table instead of recomputing.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    if path.startswith("/"):
        os.makedirs(os.path.dirname(path), exist_ok=True)
    return path
