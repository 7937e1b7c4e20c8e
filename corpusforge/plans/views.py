"""Driver tables and the derived views every query reads.

The driver's tables contain no native-script text, no emoji, no blank text
and no comment threads, so the pipeline reads *derived views*: each is a
row-for-row rewrite of a driver table (or a plain aggregate of one), keeps
every row and every full text, and is written once as SQL text that runs
unchanged on Spark and on DuckDB (the oracle).  Work therefore grows with
the tables.  Mapping (see FIXTURES.md):

* ``corpus_fx``   documents -> comments with every cleaning case, plus one
  re-cased copy of every document (normalized duplicates)
* ``videos_fx`` / ``channels_fx`` / ``comments_fx``  conversations -> channel,
  video and comment-thread tables (5 conversations = 1 video)
* ``posts_fx``    documents -> archived posts of 20 accounts
* ``label_events_fx``  events -> label submissions of two annotators
* ``raters_fx``   labels + documents -> two raters of the toxicity task
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")

# Tables this domain reads (the star-schema tables are not used); only these
# are listed and registered on the Spark side.
USED_TABLES = ("documents", "conversations", "labels", "events", "pages")

# Offset of the re-cased copy rows; far above any doc_id.
COPY_OFFSET = 1_000_000_000_000

CORPUS_FX = f"""
SELECT doc_id AS comment_id, doc_id AS ord, source, lang,
  CASE CAST(doc_id % 10 AS INT)
    WHEN 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', '')
    WHEN 1 THEN concat(text, ' 👍')
    WHEN 2 THEN concat('ఇది ', text)
    WHEN 3 THEN replace(replace(text, ' ', '_'), chr(10), '_')
    WHEN 4 THEN CAST(NULL AS STRING)
    WHEN 5 THEN concat('👏', replace(text, ' ', ' 👏 '), ' ❤️')
    WHEN 6 THEN concat('ledu bro ', text)
    WHEN 7 THEN replace(replace(translate(text, 'aeiou', 'అఇఉఎఒ'), ' ', ''), chr(10), '')
    WHEN 8 THEN concat(chr(9), replace(text, ' ', chr(12)), ' ', '\u3000')
    ELSE text END AS text
FROM documents
UNION ALL
SELECT doc_id + {COPY_OFFSET}, doc_id + {COPY_OFFSET}, source, lang,
  concat('  ', replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'),
                       ' ', '  '), ' 👍')
FROM documents
"""

VIDEOS_FX = """
WITH v AS (
  SELECT CAST(floor(conv_id / 5) AS BIGINT) AS video_id,
         max(CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN text END) AS video_title
  FROM conversations GROUP BY CAST(floor(conv_id / 5) AS BIGINT)),
allv AS (
  SELECT video_id, video_title FROM v
  UNION ALL SELECT max(video_id) + 1, 'no comments' FROM v
  UNION ALL SELECT max(video_id) + 2, 'no comments' FROM v)
SELECT video_id, CAST(video_id % 4 AS INT) AS channel_idx,
  concat('2024-01-', lpad(CAST(video_id % 28 + 1 AS STRING), 2, '0'), 'T00:00:00Z') AS published_at,
  video_title
FROM allv
"""

CHANNELS_FX = """
SELECT channel_idx, concat('channel_', CAST(channel_idx AS STRING)) AS channel_name,
  concat('UC', lpad(CAST(channel_idx AS STRING), 4, '0')) AS channel_id
FROM (SELECT DISTINCT CAST(conv_id % 5 AS INT) AS channel_idx FROM conversations) c
"""

COMMENTS_FX = """
SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS comment_id,
  CASE WHEN turn > 0 THEN concat(CAST(conv_id AS STRING), '-0') END AS parent_id,
  CAST(floor(conv_id / 5) AS BIGINT) AS video_id, conv_id AS thread_id, turn, text, role AS author,
  CAST(length(text) % 50 AS BIGINT) AS like_count,
  concat('2024-02-', lpad(CAST(conv_id % 28 + 1 AS STRING), 2, '0'), 'T',
         lpad(CAST(turn % 24 AS STRING), 2, '0'), ':00:00Z') AS published_at
FROM conversations
"""

# Of 60 documents in a row, the last 20 repeat the post ids of the 20 before (a later crawl of the same posts).
POSTS_FX = """
SELECT source AS username, ord, post_id,
  concat('https://x.example/', source, '/status/', CAST(post_id AS STRING), '?s=20') AS href,
  CASE WHEN ord % 4 = 0 THEN NULL ELSE concat(CAST(ord % 97 AS STRING), ' Likes') END AS likes,
  CASE WHEN ord % 3 = 0 THEN NULL ELSE concat('1,', lpad(CAST(ord % 1000 AS STRING), 3, '0'), ' Retweets') END AS retweets,
  CASE WHEN ord % 5 = 0 THEN '' ELSE concat(CAST(ord % 7 AS STRING), ' replies') END AS replies,
  concat('2024-03-', lpad(CAST(ord % 28 + 1 AS STRING), 2, '0'), 'T12:00:00Z') AS date,
  text
FROM (SELECT source, text, doc_id AS ord, CASE WHEN doc_id % 60 >= 40 THEN doc_id - 20 ELSE doc_id END AS post_id FROM documents) d
"""

LABEL_EVENTS_FX = """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id AS item, CAST(event_id % 2 AS INT) AS annotator,
  CAST(event_id % 3 AS INT) AS sent,
  CAST(CAST(floor(event_id / 3) AS BIGINT) % 3 AS INT) AS tox,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(CAST(floor(event_id / 9) AS BIGINT) % 3 AS INT) END AS sta
FROM events
"""

RATERS_FX = """
SELECT l.doc_id AS item, l.toxic AS a, CASE WHEN d.n_chars % 3 = 0 THEN 1 - l.toxic ELSE l.toxic END AS b
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""

# Registration order matters: later views read earlier ones.
DERIVED_VIEWS = {
    "corpus_fx": CORPUS_FX,
    "videos_fx": VIDEOS_FX,
    "channels_fx": CHANNELS_FX,
    "comments_fx": COMMENTS_FX,
    "posts_fx": POSTS_FX,
    "label_events_fx": LABEL_EVENTS_FX,
    "raters_fx": RATERS_FX,
}


# Text-heavy tables and a unique key to spread them by when a scan yields
# fewer splits than there are cores (a file with one row group is one task).
SPREAD_KEYS = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id",
               "events": "event_id"}


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-repartition ``df`` on a unique key if its scan has fewer partitions than cores.

    CPU-heavy text expressions then run on every core.  Large inputs (many
    files / row groups) already have more splits than cores and are left
    as they are: no extra shuffle at scale.  Hash partitioning on a key is
    deterministic, so a recomputed partition holds the same rows.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    # two partitions per core even out texts of very different lengths
    return df.repartition(2 * cores, key)


_REGISTERED: dict[int, str] = {}


def register(spark: SparkSession, sf_dir: str, force: bool = False) -> None:
    """Register driver tables and derived views as temp views on ``spark``.

    Registration is remembered per session and data folder; ``force``
    re-registers.
    """
    key = id(spark)
    if not force and _REGISTERED.get(key) == sf_dir and spark.catalog.tableExists("corpus_fx"):
        return
    _REGISTERED.pop(key, None)
    for t in USED_TABLES:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        if t in SPREAD_KEYS:
            df = spread(df, SPREAD_KEYS[t])
        df.createOrReplaceTempView(t)
    for name, sql in DERIVED_VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)
    _REGISTERED[key] = sf_dir


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.table(name)
