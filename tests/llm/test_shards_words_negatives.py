"""Interleaved shards, spelling variants and hard negatives against brute force, and their defined edge cases."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import hard_negatives, interleave, spelling
from corpusforge.llm.oracle import ORACLE
from corpusforge.llm.queries import QUERIES


# ---- interleaved shards ------------------------------------------------------------------------------------------

def shards_of(rows, n_shards):
    """Brute force: {(id, text, source)} in whole order, from the same seeded digests."""
    import hashlib
    key = lambda r: int(hashlib.md5(f"{interleave.SEED}:{r[0]}".encode()).hexdigest()[:15], 16)
    placed = []
    for source in {r[2] for r in rows}:
        own = sorted((r for r in rows if r[2] == source), key=key)
        placed += [((2 * i + 1) / (2 * len(own)), "-" if source is None else "+" + source, r) for i, r in enumerate(own)]
    placed.sort(key=lambda x: x[:2])
    out, n = {}, len(placed)
    for place, (_, _, r) in enumerate(placed):
        shard = place * n_shards // n
        out[r[0]] = (len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), shard, place - -(-shard * n // n_shards))
    return out


@pytest.mark.parametrize("n_shards", [1, 7, 16])
def test_shards_equal_brute_force(spark, n_shards):
    rng = random.Random(n_shards)
    rows = [(i, rng.choice([None, "", "é" * rng.randrange(9), "x"]), rng.choice(["hot"] * 8 + ["a", "b", None])) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = {r["doc_id"]: (r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in interleave.interleave(docs, n_shards).collect()}
    assert got == shards_of(rows, n_shards)


def test_every_shard_holds_the_mixture(spark):
    rows = [(i, "t", "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    out = interleave.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=("doc_id", "source"))
    total, per = collections.Counter(r[2] for r in rows), collections.Counter()
    sizes = collections.Counter()
    for r in out.collect():
        per[r["source"], r["shard"]] += 1
        sizes[r["shard"]] += 1
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 16
    assert all(abs(per[s, k] - total[s] / 16) <= 1.5 for s in total for k in range(16))


def test_shards_of_odd_rows(spark):
    """Null and repeated ids, repeated rows, names that clash: every row has a slot; an empty table has none."""
    rows = [(None, None, None, 1, "p", 5)] * 40 + [(7, "same", "a", 2, "q", None)] * 40 + [(i, "x" * 200_000, "b", 3, None, 0) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int, _row string, size int")
    out = interleave.interleave(docs, 4, keep=docs.columns)
    assert sorted(out.columns) == sorted({*docs.columns, "text_crc32", "shard"})
    got = out.collect()
    assert len(got) == 83 and len({(r["shard"], r["slot"]) for r in got}) == 83
    assert {r["size"] for r in got if r["doc_id"] is None} == {1}
    for k in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    assert interleave.interleave(docs.limit(0)).collect() == []


def test_written_shards_come_back_in_slot_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", f"s{i % 3}") for i in range(100)], "doc_id long, text string, source string")
    out = interleave.interleave(docs, 4, keep=docs.columns)
    interleave.write_shards(out, f"{tmp_path}/shards", 8)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in back.collect()} == {(r["doc_id"], r["shard"], r["slot"]) for r in out.collect()}
    slots = [r["slot"] for r in spark.read.parquet(f"{tmp_path}/shards/shard=2").collect()]
    assert len(slots) == 25 and sorted(slots) == list(range(25))


# ---- spelling variants ---------------------------------------------------------------------------------------------

def one_off(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def some_words(rng, n, letters="abcé", low=5, high=9):
    out = set()
    while len(out) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(low, high)))
        out.add(w)
        i = rng.randrange(len(w))
        out.add(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]]))
    return sorted(w for w in out if len(w) >= 2)


def _grams(word, frequent):
    _, codes, full = next(spelling.layouts([word]))
    q = spelling.decompose(codes, full, frequent)
    g = spelling.kept_grams(codes, q)[0]
    return {(int(g[p]), int(p), int(full[0] - p - q[0, p])) for p in np.flatnonzero(q[0])}, int(spelling.affected(q, full)[0])


def test_no_edit_touches_more_grams_than_the_bound():
    """For random dictionaries: near words share (grams - bound) of their grams or more, by place from the left or the right."""
    rng = random.Random(4)
    for _ in range(40):
        words = some_words(rng, 30, "abc", 2, 8)
        short = np.unique(np.concatenate([spelling.gram_codes(c, k)[0, :f[0] - k + 1] for w in words for _, c, f in spelling.layouts([w])
                                          for k in (2, 3)]))
        frequent = np.sort(np.array(rng.sample(short.tolist(), len(short) * rng.randrange(1, 4) // 4), np.uint32))
        for a in words:
            ga, bound = _grams(a, frequent)
            assert len(ga) - bound >= 1
            for b in words:
                if one_off(a, b):
                    gb, _ = _grams(b, frequent)
                    shared = sum(any(x[0] == y[0] and (x[1] == y[1] or x[2] == y[2]) for y in gb) for x in ga)
                    assert shared >= len(ga) - bound, (a, b)


@pytest.mark.parametrize("hot", [4096, 7])
def test_near_words_equal_brute_force(spark, monkeypatch, hot):
    """Also with lists that are split into cells, and with words longer than the compared matrix."""
    monkeypatch.setattr(spelling, "HOT", hot)
    monkeypatch.setattr(spelling, "FREQUENT", 20)
    monkeypatch.setattr(spelling, "BUCKET", 500)
    rng = random.Random(hot)
    long = "".join(rng.choice("abc") for _ in range(300))
    words = some_words(rng, 400) + ["prefix" + w for w in some_words(rng, 60, "abc")] + [long, long[:-1], long[:150] + "z" + long[151:]]
    words = sorted(set(words))
    table = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    got = {(r["word"], r["near"]): r["near_n"] for r in spelling.near_words(table).collect()}
    assert set(got) == {(a, b) for a in words for b in words if one_off(a, b)}
    assert all(n == len(b) for (_, b), n in got.items())
    assert spelling.near_words(table).count() == len(got)


def forms_of(texts):
    counts = collections.Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            counts[run[:k] + run[k + 1:] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out = {}
    for w, n in words.items():
        near = [v for v in words if one_off(w, v)]
        top = min(near, key=lambda v: (-words[v], v), default=None)
        form = top if top and words[top] >= 2 * n else None
        out[w] = [form, w, n, len(near), words[form] if form else None]
    for w in words:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {w: tuple(v) for w, v in out.items()}


def test_variants_equal_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["Kitten", "kittens", "kitte", "sitten", "GARDEN", "garden", "gardén", "Élan", "élans", "longword"] + some_words(rng, 30)
    texts = [(rng.choice([None, i]), rng.choice([None, "", " ".join(rng.choice(vocabulary) + rng.choice(["", "s", "!"]) for _ in range(80))]))
             for i in range(120)]
    texts += [(1000 + i, "qqqqq " * 40 + "qqqqy " * 19 + "qqqyy " * 8 + "qqyyy " * 3) for i in range(3)]      # a chain of forms
    texts += [(5, "word " * 3 + "z" * 5000 + " " + "z" * 5000 + " " + "z" * 5000)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], "doc_id long, text string, word string, n int")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(docs).collect()}
    want = forms_of(texts)
    assert got == want
    assert got["qqyyy"][:2] == ("qqqyy", "qqqqq") and max(map(len, got)) >= 4999


def test_no_words_no_rows_and_refused_words(spark):
    none = spark.createDataFrame([(1, None), (None, "a b c"), (2, "")], "doc_id long, text string")
    assert spelling.spelling_variants(none).collect() == []
    assert spelling.spelling_variants(none.limit(0)).collect() == []
    with pytest.raises(ValueError):
        spelling.near_words(spark.createDataFrame([("слово", 3)], "word string, n long"))


# ---- hard negatives -----------------------------------------------------------------------------------------------

def negatives_of(rows, anchors, positives=5, negatives=10, low=30, high=90):
    """Brute force in Python's integers over (id, label, vector) rows with distinct ids."""
    q = {i: (label, [math.floor(256 * x) for x in v]) for i, label, v in rows}
    out = []
    for a in sorted(i for i in q if anchors(i)):
        score = {i: sum(x * y for x, y in zip(q[a][1], q[i][1])) for i in q if i != a}
        best = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in best if q[i][0] == q[a][0]][:positives]:
            fit = [i for i in best if q[i][0] != q[a][0] and low * score[p] <= 100 * score[i] <= high * score[p]][:negatives]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(fit, 1)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("block_rows", [1 << 16, 23])
def test_negatives_equal_brute_force(spark, monkeypatch, block_rows):
    """One and many blocks; a hot label; ties, zero and negative scores; vectors of other lengths."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block_rows)
    rng = random.Random(2)
    vec = lambda: [rng.choice([-0.02, -0.004, 0.0, 0.01, 0.05, 0.2]) for _ in range(rng.choice([3, 4, 4, 4, 0]))]
    rows = [(i - 150, rng.choice([1, 1, 1, 2, 3]), vec()) for i in range(300)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0)
    want = negatives_of(rows, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300


def test_rows_that_take_no_part(spark):
    rng = random.Random(3)
    good = [(i, i % 3, [rng.random() for _ in range(8)]) for i in range(60)]
    nan, inf = float("nan"), float("inf")
    bad = [(100, None, [1.0] * 8), (101, 1, None), (102, 1, [1.0, None]), (103, 0, [nan] * 8), (104, 0, [inf] * 8), (105, 0, [1e307] * 8),
           (None, 1, [1.0] * 8)]
    df = spark.createDataFrame([(*r, 0, "x") for r in good + bad + good[:20] + [good[0]] * 30],
                               "vec_id long, label int, embedding array<double>, score int, block string")
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == negatives_of(good, lambda i: i % 10 == 0)
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives.mine(df, F.lit(None).cast("boolean")).collect() == []


def test_scores_beyond_doubles_are_exact():
    a = np.array([[2.0**40 + 1, 3.0]])
    m = np.array([[2.0**40 + 3, 1.0], [1.0, -2.0**41]])
    assert hard_negatives.scores(a, m).tolist() == [[(2**40 + 1) * (2**40 + 3) + 3, 2**40 + 1 - 3 * 2**41]]


def test_packed_keys_sort_by_anchor_score_kind_and_id():
    rng = random.Random(1)
    rows = [(rng.randrange(-3, 3), rng.randrange(-5, 5), rng.randrange(2), rng.randrange(-4, 4)) for _ in range(400)]
    rows += [(2**63 - 1, -2**63, 1, -2**63), (-2**63, 2**63 - 1, 0, 2**63 - 1)]
    assert sorted(rows, key=lambda r: hard_negatives.pack_key(*r)) == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))


# ---- the registered queries against their SQL -----------------------------------------------------------------------

@pytest.mark.parametrize("name", ["op11_interleaved_shards", "op12_variable_grams", "op13_secondary_sort_negatives"])
def test_query_equals_its_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)
