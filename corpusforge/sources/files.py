"""File sources and sinks.

CSV is read with an all-string schema, ``multiLine`` and ``""`` escaping
(comments contain newlines and quotes).  Quoted line breaks make a CSV file
one task's work, so it is read exactly once: :func:`land_csv` writes its
cells as Parquet with a persisted order column (file, split, row), and the
corpus (S1) and the annotation batch (S6) are views of that landing, which
splits and prunes like any Parquet table.  Large corpora come as many files,
which land in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import consts as K
from ..functions import text as T
from . import versions

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
               "encoding": "UTF-8"}


def null_sentinels(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Cells equal to a pandas NA sentinel ('NA', 'null', '', ...) become null."""
    cols = list(df.columns if cols is None else cols)
    return df.withColumns({c: F.when(F.col(f"`{c}`").isin(*K.NA_SENTINELS), F.lit(None).cast("string"))
                           .otherwise(F.col(f"`{c}`")) for c in cols})


#: the persisted order of landed rows: input file by name, split of the file, row of the split
LANDED = "_landed"


def file_order() -> Column:
    """Where a row of a file source stands: (file, start of its split, row); rows of one split come in file order."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                    F.monotonically_increasing_id().alias("row"))


def land_csv(spark: SparkSession, src: str, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Write the cells of a CSV file or folder, as they stand, to Parquet at ``path`` with their order; returns the landing.

    ``columns``: the header if it is known, else it is read from the first file.  The CSV itself is read by one job; a column of
    the data may have any name but ``_landed``.
    """
    names = list(columns) if columns is not None else spark.read.options(**CSV_OPTIONS).csv(src).columns
    schema = T_.StructType([T_.StructField(c, T_.StringType()) for c in names])
    cells = spark.read.schema(schema).options(**CSV_OPTIONS).csv(src)
    cells.withColumn(LANDED, file_order()).write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def corpus_rows(landing: DataFrame) -> DataFrame:
    """S1 as a view of a landing: every column as string, NA sentinels -> null, and the order column."""
    return null_sentinels(landing, [c for c in landing.columns if c != LANDED])


def annotation_rows(landing: DataFrame) -> DataFrame:
    """S6 as a view of a landing: header and cells trimmed (JS semantics), missing cell -> '', and the order column."""
    cells = [F.coalesce(T.js_trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip()) for c in landing.columns if c != LANDED]
    return landing.select(*cells, LANDED)


def read_corpus_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """S1 straight from the CSV: every column as string, NA sentinels -> null."""
    schema = T_.StructType([T_.StructField(c, T_.StringType()) for c in columns])
    df = spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)
    return null_sentinels(df)


def write_corpus_csv(df: DataFrame, path: str) -> None:
    """S5 (CSV form): header, quoted fields, UTF-8 (no byte-order mark)."""
    (df.write.mode("overwrite")
     .options(header="true", quote='"', escape='"', quoteAll="true",
              ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
     .csv(path))


def write_corpus(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """The primary sink is Parquet (optionally partitioned)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_annotation_batch(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Rows to annotate; header and cells trimmed (JS semantics), missing cell -> ''."""
    schema = T_.StructType([T_.StructField(c, T_.StringType()) for c in columns])
    df = spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)
    return df.select(*[F.coalesce(T.js_trim(F.col(c)), F.lit("")).alias(c.strip()) for c in columns])


def write_export_csv(df: DataFrame, path: str) -> None:
    """S7 sink: every field quoted, header first."""
    write_corpus_csv(df, path)


def write_report_text(report: DataFrame, path: str) -> None:
    """S9 text form: one ``metric: value`` line per report row.

    Reports are a handful of rows (one per metric), so a single output file
    is a bounded write.
    """
    line = F.concat_ws(": ", F.col("metric"), F.col("value").cast("string")).alias("value")
    report.select(line).coalesce(1).write.mode("overwrite").text(path)


# --- S8: label snapshots -----------------------------------------------------

LABEL_STRUCT = T_.StructType([T_.StructField("sent", T_.IntegerType()),
                              T_.StructField("tox", T_.IntegerType()),
                              T_.StructField("sta", T_.IntegerType())])

# A progress object: {annotator, labels: {item: {sent, tox, sta}}, cur, total, saved_at}.  The annotation tool writes one, without
# an annotator; a snapshot is a table of them, each with a bounded share of an annotator's labels.
PROGRESS_OBJECT = T_.StructType([
    T_.StructField("annotator", T_.IntegerType()),
    T_.StructField("labels", T_.MapType(T_.StringType(), LABEL_STRUCT)),
    T_.StructField("cur", T_.LongType()),
    T_.StructField("total", T_.LongType()),
    T_.StructField("saved_at", T_.StringType()),
])
LABELS_PER_OBJECT = 10_000


def snapshot_labels(labels: DataFrame, path: str, saved_at: str, cursors: DataFrame | None = None, total: int | None = None,
                    version: int | None = None) -> int:
    """S8 save: the current labels with every annotator's cursor and the corpus size, as a new version of the snapshot at ``path``.

    ``labels``: one row per (annotator, item); ``cursors``: (annotator, cur); annotators with a cursor and no label are saved too.
    The version before stays readable until the pointer has moved (``sources.versions``).  Returns the version.
    """
    spark = labels.sparkSession
    if version is None:
        says = versions.read_pointer(spark, path)
        version = 0 if says is None else says["version"] + 1
    objects = max(1, -(-labels.count() // LABELS_PER_OBJECT))
    entry = F.struct(F.col("item").cast("string").alias("k"), F.struct("sent", "tox", "sta").alias("v"))
    maps = (labels.groupBy(F.col("annotator").cast("int").alias("annotator"), F.pmod(F.xxhash64("item"), F.lit(objects)).alias("_o"))
            .agg(F.map_from_entries(F.collect_list(entry)).alias("labels")).drop("_o"))
    if cursors is not None:
        out = maps.join(cursors.select(F.col("annotator").cast("int"), F.col("cur").cast("long")), "annotator", "full")
    else:
        out = maps.withColumn("cur", F.lit(None).cast("long"))
    out = out.withColumns({"total": F.lit(total).cast("long"), "saved_at": F.lit(saved_at)})
    versions.publish(out.select(*PROGRESS_OBJECT.fieldNames()), path, version, fmt="json", saved_at=saved_at, total=total)
    return version


def _snapshot(spark: SparkSession, path: str) -> DataFrame:
    df = versions.read_current(spark, path, fmt="json", schema=PROGRESS_OBJECT)
    if df is None:
        raise ValueError(f"no label snapshot under {path}")
    return df


def restore_labels(spark: SparkSession, path: str) -> DataFrame:
    """S8 restore: (annotator, item, sent, tox, sta, cur, total) of the current snapshot; a missing cursor is 0."""
    return _label_rows(_snapshot(spark, path)).select(
        "annotator", F.col("key").cast("long").alias("item"), "sent", "tox", "sta", "cur", "total")


def restore_cursors(spark: SparkSession, path: str) -> DataFrame:
    """S8 restore: (annotator, cur, total, saved_at), one row per annotator of the current snapshot."""
    return _snapshot(spark, path).groupBy("annotator").agg(
        F.coalesce(F.max("cur"), F.lit(0)).alias("cur"), F.max("total").alias("total"), F.max("saved_at").alias("saved_at"))


def _label_rows(objects: DataFrame) -> DataFrame:
    return (objects.select("annotator", F.coalesce("cur", F.lit(0)).alias("cur"), "total", "saved_at", F.explode("labels").alias("key", "label"))
            .select("annotator", "cur", "total", "saved_at", "key", "label.sent", "label.tox", "label.sta"))


def restore_progress_object(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """S8 restore of progress objects: missing labels -> no rows, missing cur -> 0.

    ``path``: a file the annotation tool saved (one object over several lines), or, with ``multi_line=False``, the folder of a
    snapshot's version (one object a line).
    """
    return _label_rows(spark.read.schema(PROGRESS_OBJECT).option("multiLine", str(multi_line).lower()).json(path)).drop("annotator")
