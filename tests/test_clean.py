"""Cleaning rules F1–F4, dedup D1, reports A1/A2/S9: edge rows and invariants."""

from pyspark.sql import functions as F

from corpusforge.operators import clean as C

ROWS = [
    (1, None),                      # empty_or_nan
    (2, "   \t "),                  # empty_or_nan
    (3, "👍👍❤️"),                  # emoji_or_symbol_only
    (4, "१२ हिन्दी"),                # other script only -> symbol only
    (5, "good👍bad idea"),          # 2 words after strip -> too short
    (6, "fake news"),               # too short despite the doc claim
    (7, "చాలా"),                    # native rescues one word
    (8, "A  B c"),                  # kept
    (9, "a b C 👍"),                # duplicate of 8 after normalization
    (10, "👨‍👩‍👧 ok fine now"),      # kept, ZWJ stays
    (11, "👍 a b c"),               # duplicate of 8? no: key 'a b c' -> duplicate
]
EXPECT = {1: "empty_or_nan", 2: "empty_or_nan", 3: "emoji_or_symbol_only", 4: "emoji_or_symbol_only",
          5: "too_short_no_telugu", 6: "too_short_no_telugu", 7: None, 8: None,
          9: "exact_duplicate", 10: None, 11: "exact_duplicate"}


def corpus(spark):
    return spark.createDataFrame(ROWS, "comment_id long, text string").withColumn("ord", F.col("comment_id"))


def test_per_row_reason(spark):
    got = {r.comment_id: r.drop_reason for r in C.per_row_reason(corpus(spark)).collect()}
    assert got == EXPECT


def test_counts_summary_and_invariants(spark):
    counts = {r.drop_reason: r.n for r in C.drop_reason_counts(corpus(spark)).collect()}
    assert counts == {"empty_or_nan": 2, "emoji_or_symbol_only": 2, "too_short_no_telugu": 2,
                      "exact_duplicate": 2}
    s = C.cleaning_summary(corpus(spark)).first()
    assert (s.original, s.final, s.dropped) == (11, 3, 8)
    assert s.original == s.final + sum(counts.values())
    assert s.pct_dropped == round(100 * 8 / 11, 1)
    rep = {r.metric: r.value for r in C.cleaning_report(corpus(spark)).collect()}
    assert rep["total_dropped"] == rep["original_count"] - rep["final_count"]


def test_first_wins_and_text_columns(spark):
    kept = {r.comment_id: r for r in C.clean_corpus(corpus(spark)).collect()}
    assert set(kept) == {7, 8, 10}
    assert kept[8].text == "A  B c" and kept[8].text_original == "A  B c"
    reversed_order = corpus(spark).withColumn("ord", -F.col("comment_id"))
    kept2 = {r.comment_id for r in C.clean_corpus(reversed_order).collect()}
    assert 11 in kept2 and 8 not in kept2      # file order decides who is first


def test_all_dropped_keeps_schema(spark):
    df = spark.createDataFrame([(1, "👍", 1)], "comment_id long, text string, ord long")
    out = C.clean_corpus(df)
    assert out.count() == 0 and "text_original" in out.columns


def test_null_order_keeps_the_row(spark):
    """A comment without an order survives whole, after those that have one."""
    rows = spark.createDataFrame([(1, "one good comment here", None), (2, "two good comments here", None),
                                  (3, "Two good  comments here", 5)], "id int, text string, ord int")
    got = {(r["id"], r["text"]) for r in C.clean_corpus(rows).collect()}
    assert got == {(1, "one good comment here"), (3, "Two good  comments here")}


def test_rows_verdicts_and_counts_agree_on_ties(spark):
    """Null, equal and missing orders, equal ids, whole rows repeated: one row a key, the same one everywhere."""
    rows = [(1, "one good comment here", None), (2, "One good  comment here", None), (3, "two good comments here", 7),
            (4, "Two good comments here", 7), (5, "three good comments here", 1), (5, "three good comments here", 1), (5, "Three good comments here", 1),
            (None, "four good comments here", None), (None, "four good comments here", None), (6, None, 2), (None, "ok", None)]
    df = spark.createDataFrame(rows, "comment_id long, text string, ord long").repartition(3)
    for id_col in (None, "comment_id"):
        kept = C.clean_corpus(df, id_col=id_col).collect()
        marked = C.per_row_reason(df, id_col=id_col).collect()
        counts = {r.drop_reason: r.n for r in C.drop_reason_counts(df).collect()}
        assert len(kept) == 4 and sum(r.drop_reason is None for r in marked) == 4 and len(marked) == len(rows)
        assert counts == {"empty_or_nan": 1, "emoji_or_symbol_only": 0, "too_short_no_telugu": 1, "exact_duplicate": 5}
        assert sorted(str(r.comment_id) for r in kept) == sorted(str(r.comment_id) for r in marked if r.drop_reason is None)
        if id_col:
            assert sorted(str(r.comment_id) for r in kept) == ["1", "3", "5", "None"]
    summary = C.cleaning_summary(df).first()
    assert summary.original == len(rows) == summary.final + sum(counts.values())


def test_table_without_texts_counts_every_row_as_empty(spark):
    df = spark.createDataFrame([(1, 1), (2, 2)], "comment_id long, ord long")
    assert C.clean_corpus(df).collect() == []
    assert {r.drop_reason: r.n for r in C.drop_reason_counts(df).collect()}["empty_or_nan"] == 2
    assert [r.drop_reason for r in C.per_row_reason(df).collect()] == ["empty_or_nan"] * 2


def test_empty_table_has_a_report(spark):
    df = spark.createDataFrame([], "comment_id long, text string, ord long")
    assert C.cleaning_summary(df).first().asDict() == {"original": 0, "final": 0, "dropped": 0, "pct_dropped": 0.0}


def test_no_text_is_a_key_in_any_cleaning_plan(spark):
    """Exchanges, aggregates and joins go by the two longs of the digest."""
    import contextlib
    import io
    import re
    for make in (C.clean_corpus, C.per_row_reason, C.drop_reason_counts):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            make(corpus(spark)).explain()
        keys = re.findall(r"(?:hashpartitioning\(|Aggregate\(keys?=\[|Join \[)([^\])]*)", out.getvalue())
        assert keys and not any("text" in k or "dedup_key" in k for k in keys), keys
