"""Tables whose columns are called like an operator's own, and texts of very many lines."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusforge.llm import decontam, linededup, toxicity

CLASH = ["score", "predicted", "n_lines", "n_dropped", "_id", "_text", "_leaks", "_row", "_drop", "c0", "text2", "drop", "content", "place", "leaks"]


@pytest.fixture(scope="module")
def clashing(spark):
    shared = "a line that several of the documents hold"
    leak = "the quick brown fox jumps over the lazy dog near the old river bank while seven geese watch"
    rows = [(i, f"own words of document {i}\n{shared}", f"x{i}", i) for i in range(1, 5)] + [(None, None, None, None), (9, leak, "x9", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    return df.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("lang"), F.lit(""))) for c in CLASH})


def test_filters_keep_columns_of_any_name(spark, clashing):
    model = toxicity.ToxicModel({"nothing": 1.0}, 1.0, 0.1, -5.0, 1.0)
    kept = toxicity.without_toxic(clashing, model)
    assert kept.columns == clashing.columns and sorted(map(str, kept.collect())) == sorted(map(str, clashing.collect()))
    scored = toxicity.score(clashing, model, keep=tuple(clashing.columns))
    assert sorted(scored.columns) == sorted({*clashing.columns, *toxicity.RESULTS}) and dict(scored.dtypes)["score"] == "double"
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog near the old river bank while seven geese watch")],
                                  "item_id long, text string")
    clean = decontam.drop_leaks(clashing, bench)
    assert clean.columns == clashing.columns
    assert sorted(map(str, clean.collect())) == sorted(str(r) for r in clashing.collect() if r["doc_id"] != 9)


def test_line_dedup_keeps_columns_of_any_name(clashing):
    out = linededup.dedup_lines(clashing)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] == "own words of document 1" and got[4]["text"].endswith("documents hold")
    assert (got[1]["n_lines"], got[1]["n_dropped"]) == (2, 1) and got[1]["_row"] == "_row-x1"
    plain = linededup.dedup_lines(clashing, counts=False)
    assert plain.columns == clashing.columns and {r["doc_id"]: r["n_lines"] for r in plain.collect()}[1] == "n_lines-x1"


def test_pipeline_stage_leaves_other_columns_alone(spark, clashing):
    out = corpus_pipeline.drop_lines(spark, clashing, "")
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == clashing.columns and got[1]["n_chars"] == len("own words of document 1")
    assert got[2]["n_dropped"] == "n_dropped-x2" and got[None]["n_chars"] == 0
    corpus_pipeline.drop_lines(spark, clashing.drop("n_chars"), "").collect()


@pytest.mark.parametrize("n", [8_000, 80_000])
def test_documents_of_very_many_shared_lines(spark, n):
    """Three documents that share all their lines: two lose them, in time linear in the lines."""
    text = "\n".join(f"shared line number {i} of the long documents" for i in range(n))
    docs = spark.createDataFrame([(i, f"{text}\nown {i}") for i in range(3)], "doc_id long, text string").repartition(3)
    linededup.dedup_lines(docs.limit(0)).collect()
    start = time.time()
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    assert time.time() - start < 60
    assert got[0]["text"] == "own 0" and got[1]["n_dropped"] == n and got[2]["text"].count("\n") == n
