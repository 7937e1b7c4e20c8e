"""Cleaning pipeline: ordered drop rules, normalized dedup, reports.

SURVEY IDs: F1–F4, D1, A1, A2, P23, S9.

Plan shape at scale: one narrow projection computes trimmed text, stripped
text and the rule verdict (one regex pass per rule, no Python).  Equal
normalized keys are found by a 128-bit digest of the key (two 64-bit hashes
with independent seeds): grouping, shuffles and joins carry two longs, never
the key's text.  The first row of a key is elected by a *grouped* aggregation,
so map-side partial aggregation collapses a spam key that holds a third of
all rows before any shuffle.

"First" is a total order, the same for every operator here: ``ord`` (nulls
last), then the id column if one is given, then a hash of the row.  So the
rows kept (D1), the per-row verdicts (F4) and the counts (A1, A2, S9) agree
also when ``ord`` is null or repeated.  A table without the text column is
cleaned like one whose texts are all missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import consts as K
from ..functions import text as T
from ..session import materialize

REASON = "drop_reason"
KEY = "dedup_key"
DIGEST = ("_key_a", "_key_b")
TIE = "_tie"


def key_digest(key: Column) -> list[Column]:
    """The 128-bit digest of a normalized key as two longs (both null for a null key)."""
    hashes = (F.xxhash64(key), F.xxhash64(F.lit("second"), key))
    return [F.when(key.isNotNull(), h).alias(name) for h, name in zip(hashes, DIGEST)]


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row (maps, which have no hash, left out): the last resort of the total order."""
    return F.xxhash64(*[F.col(f.name) for f in df.schema.fields if not isinstance(f.dataType, T_.MapType)]).alias(TIE)


def total_order(order_col: str, id_col: str | None) -> Column:
    """``order_col`` (nulls last), the id (nulls last), the row's hash: equal only for rows that are alike."""
    by = [c for c in (order_col, id_col) if c]
    return F.struct(*[x.alias(f"_{i}_{j}") for i, c in enumerate(by) for j, x in enumerate((F.col(c).isNull(), F.col(c)))], F.col(TIE))


def drop_empty(text: Column) -> Column:
    """null or blank after Unicode trim."""
    return text.isNull() | (T.unicode_trim(text) == "")


def drop_symbol_only(stripped: Column, block: K.ScriptBlock = K.TELUGU) -> Column:
    """no ASCII or native letter left after emoji stripping."""
    return ~T.has_alpha_content(stripped, block)


def drop_short_non_native(stripped: Column, trimmed: Column, block: K.ScriptBlock = K.TELUGU,
                          min_words: int = K.MIN_WORDS) -> Column:
    """fewer than ``min_words`` words and no native character."""
    return ~T.has_min_words(stripped, min_words) & ~T.has_native_script(trimmed, block)


def with_rule_columns(df: DataFrame, text_col: str = "text", block: K.ScriptBlock = K.TELUGU,
                      min_words: int = K.MIN_WORDS) -> DataFrame:
    """F4 (rules 1–3) + P23: add ``text_original``, ``text_stripped``, ``drop_reason``, ``dedup_key``.

    ``drop_reason`` is null for survivors of rules 1–3; duplicates are
    decided afterwards (D1) because "first wins" needs the survivors only.
    Trim and strip are materialized as columns so each regex runs once per
    row (the optimizer does not collapse projections that would repeat them).
    """
    df = df if text_col in df.columns else df.withColumn(text_col, F.lit(None).cast("string"))
    raw = F.col(text_col)
    step1 = df.withColumn("text_original", T.unicode_trim(raw))
    step2 = step1.withColumn("text_stripped", T.strip_emoji(F.col("text_original")))
    t, s = F.col("text_original"), F.col("text_stripped")
    reason = (F.when(raw.isNull() | (t == ""), F.lit(K.DROP_REASONS[0]))
              .when(drop_symbol_only(s, block), F.lit(K.DROP_REASONS[1]))
              .when(drop_short_non_native(s, t, block, min_words), F.lit(K.DROP_REASONS[2])))
    step3 = step2.withColumn(REASON, reason)
    return step3.withColumn(KEY, F.when(F.col(REASON).isNull(), T.dedup_key(s)))


def clean_corpus(df: DataFrame, text_col: str = "text", order_col: str = "ord",
                 block: K.ScriptBlock = K.TELUGU, min_words: int = K.MIN_WORDS, id_col: str | None = None) -> DataFrame:
    """The cleaned corpus: survivors, first per key, ``text`` = stripped, ``text_original`` = trimmed.

    Only the trimmed text travels through the dedup shuffle (as payload,
    the key is its digest); the raw text is dropped before it and the
    emoji-stripped text is recomputed from the trimmed one for the kept
    rows only.
    """
    df = df if text_col in df.columns else df.withColumn(text_col, F.lit(None).cast("string"))
    kept = first_rows(df, text_col, order_col, block, min_words, id_col).drop(*DIGEST)
    out = kept.withColumn(text_col, T.strip_emoji(F.col("text_original")))
    return out.select(*[c for c in df.columns], "text_original")


def first_rows(df: DataFrame, text_col: str = "text", order_col: str = "ord", block: K.ScriptBlock = K.TELUGU,
               min_words: int = K.MIN_WORDS, id_col: str | None = None) -> DataFrame:
    """Per key of the rule survivors the first row (in :func:`total_order`), ``text_original`` for its text, and the key's digest.

    Rows are grouped by the key's digest; ``min_by`` over a struct of the
    row is a declarative aggregate, so Spark runs a partial aggregation per
    input partition before the shuffle: a hot key costs one row per
    partition on the wire, never a whole group.  Dropped rows share the
    null digest (one group, collapsed by the partial aggregation) and are
    removed *after* the aggregate: a filter on the rule verdict before it
    would be pushed into the scan and re-run the whole regex chain there.
    """
    ruled = with_rule_columns(df.withColumn(TIE, row_hash(df)), text_col, block, min_words)
    cols = [*[c for c in df.columns if c != text_col], "text_original", REASON]
    digested = ruled.select(*cols, TIE, *key_digest(F.col(KEY)))
    firsts = digested.groupBy(*DIGEST).agg(F.min_by(F.struct(*cols), total_order(order_col, id_col)).alias("_row"))
    return firsts.where(F.col(f"_row.{REASON}").isNull()).select("_row.*", *DIGEST).drop(REASON)


def verdicts(df: DataFrame, text_col: str = "text", block: K.ScriptBlock = K.TELUGU, min_words: int = K.MIN_WORDS) -> DataFrame:
    """The narrow table that F4 and the reports work on: every row without its texts, its hash, verdict of rules 1-3, digest of its key."""
    ruled = with_rule_columns(df.withColumn(TIE, row_hash(df)), text_col, block, min_words)
    return ruled.select(*[c for c in df.columns if c != text_col], TIE, REASON, *key_digest(F.col(KEY)))


def per_row_reason(df: DataFrame, text_col: str = "text", order_col: str = "ord",
                   block: K.ScriptBlock = K.TELUGU, min_words: int = K.MIN_WORDS, id_col: str | None = None) -> DataFrame:
    """F4 with rule 4: every row (its non-text columns) with its final ``drop_reason`` (null = kept).

    The rule chain runs once; the narrow :func:`verdicts` are written once
    under the shared checkpoint folder, each row with a number of its own,
    and read by both sides of the join.  Per digest the number of the first
    row is elected with a partial aggregation and joined back; exactly that
    row of a key is kept.  Rows dropped by rules 1-3 get their own number
    as join key, so they do not pile up in one join group.  AQE splits a
    skewed digest on the large side.
    """
    narrow = verdicts(df, text_col, block, min_words)
    keyed = materialize(narrow.withColumn("_n", F.monotonically_increasing_id()), "rule_verdicts")
    firsts = keyed.where(F.col(REASON).isNull()).groupBy(*DIGEST).agg(
        F.min_by("_n", total_order(order_col, id_col)).alias("_first"))
    # a dropped row's key (null, its number) meets no digest
    joined = keyed.withColumn(DIGEST[1], F.coalesce(DIGEST[1], "_n")).join(firsts, list(DIGEST), "left")
    final = F.when(F.col(REASON).isNotNull(), F.col(REASON)) \
        .when(F.col("_n") != F.col("_first"), F.lit(K.DROP_REASONS[3]))
    return joined.withColumn(REASON, final).drop("_first", "_n", TIE, *DIGEST)


def _reason_totals(narrow: DataFrame) -> DataFrame:
    """One row: original, per-reason counts (rules 1–3), survivors, distinct survivor keys.

    Two aggregation levels over :func:`verdicts`: (reason, digest) with
    map-side combine, then a one-row fold — duplicates = survivors −
    distinct keys, no join needed.
    """
    lvl1 = narrow.groupBy(REASON, *DIGEST).agg(F.count(F.lit(1)).alias("n"))
    r = F.col(REASON)
    return lvl1.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("original"),
        *[F.coalesce(F.sum(F.when(r == name, F.col("n"))), F.lit(0)).cast("bigint").alias(name)
          for name in K.DROP_REASONS[:3]],
        F.coalesce(F.sum(F.when(r.isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("survivors"),
        F.count(F.when(r.isNull(), F.lit(1))).cast("bigint").alias("kept"),
    ).withColumn(K.DROP_REASONS[3], F.col("survivors") - F.col("kept"))


def drop_reason_counts(df: DataFrame, text_col: str = "text", block: K.ScriptBlock = K.TELUGU,
                       min_words: int = K.MIN_WORDS) -> DataFrame:
    """A1: rows per drop reason, all four reasons present (zeros kept), in rule order."""
    tot = _reason_totals(verdicts(df, text_col, block, min_words))
    stack = ", ".join(f"'{name}', `{name}`" for name in K.DROP_REASONS)
    return tot.selectExpr(f"stack({len(K.DROP_REASONS)}, {stack}) AS (drop_reason, n)")


def cleaning_summary(df: DataFrame, text_col: str = "text", block: K.ScriptBlock = K.TELUGU,
                     min_words: int = K.MIN_WORDS) -> DataFrame:
    """A2: original, final, dropped and % dropped (one decimal), one row."""
    tot = _reason_totals(verdicts(df, text_col, block, min_words))
    return tot.select(
        F.col("original"),
        F.col("kept").alias("final"),
        (F.col("original") - F.col("kept")).alias("dropped"),
        T.pct_one_dp(F.col("original") - F.col("kept"), F.col("original")).alias("pct_dropped"),
    )


def cleaning_report(df: DataFrame, text_col: str = "text", block: K.ScriptBlock = K.TELUGU,
                    min_words: int = K.MIN_WORDS) -> DataFrame:
    """The cleaning report as long-form ``(metric, value)`` rows."""
    tot = _reason_totals(verdicts(df, text_col, block, min_words))
    pct = T.pct_one_dp(F.col("original") - F.col("kept"), F.col("original"))
    wide = tot.select(
        F.col("original").cast("double").alias("original_count"),
        F.col("kept").cast("double").alias("final_count"),
        (F.col("original") - F.col("kept")).cast("double").alias("total_dropped"),
        pct.alias("pct_dropped"),
        *[F.col(n).cast("double").alias(n) for n in K.DROP_REASONS],
    )
    names = [c for c in wide.columns]
    return wide.unpivot([], names, "metric", "value")
