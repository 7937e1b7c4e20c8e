"""The training-data operators against brute force on small tables, and their defined edge cases."""

import collections
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import (decontam, fertility, htmldiff, linededup, lm_ctw, minhash_icws, packing, quality_qda, toxicity,
                             urlfilter)
from corpusforge.llm.common import crc_fold
from corpusforge.llm.oracle import ORACLE
from corpusforge.llm.queries import QUERIES, RULES

SCHEMA = "doc_id long, text string, lang string, label string, score double"


def words(rng, n, size=60):
    return " ".join(f"w{rng.randrange(size)}x{rng.randrange(9)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(3)
    long = words(rng, 30_000, 5000)
    rows = [(1, None, None, None, None), (2, "", "en", "x", 0.5), (3, "one", "en", None, 1.0), (3, "one", "en", None, 1.0),
            (4, long, "de", "y", None), (5, long, "de", "y", None), (None, "a b c d e f g", None, None, None),
            (6, "\n\n \x1c\n", "fr", "z", 0.0), (7, words(rng, 80), "en", "t", 0.1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 8)], "doc_id long, quality int, toxic int")


# ---- toxicity ------------------------------------------------------------------------------------------------

def test_maximal_segments_equal_brute_force():
    """Ruzzo-Tompa: repeatedly take the best segment (shortest of equals) left and right of those taken."""
    def brute(s, lo=0):
        best = max(((sum(s[i:j]), i - j, -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        v, _, _, i, j = best
        return brute(s[:i], lo) + [(lo + i, lo + j, v)] + brute(s[j:], lo + j)

    rng = random.Random(5)
    for _ in range(300):
        s = [rng.choice([-3, -2, -1, 1, 2, 5]) + rng.random() / 100 for _ in range(rng.randrange(1, 14))]
        got = toxicity.maximal_segments(np.array(s))
        want = brute(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([x for *_, x in got], [x for *_, x in want])


def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(1)
    rows, lab = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = words(rng, 60)
        if bad:
            text += f" scumbag you zorg{rng.randrange(200)}ish fool"
        rows.append((i, text))
        lab.append((i, int(bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, toxic int")
    model = toxicity.fit(docs, lab, crc_fold("doc_id", 5) != 0)
    out = toxicity.score(docs, model).join(lab, "doc_id").where(crc_fold("doc_id", 5) == 0).collect()
    assert out and np.mean([r["predicted"] == r["toxic"] for r in out]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_toxic_passage_counts_though_its_words_stood_before():
    rng = random.Random(7)
    bad = ["scumbag", "zorgish", "fool", "vermin"]
    of = toxicity._evidence(toxicity.ToxicModel(dict.fromkeys(bad, 4.0), 2.0, 0.05, -5.0, 1.0))
    clean = words(rng, 20_000, 5000).split()
    alone = of(" ".join(clean + bad))
    assert alone[1] == 1 and alone[2][0][:2] == (20_000, 20_004)
    for i, w in enumerate(bad):          # once each, far apart, before the passage
        clean[3000 * (i + 1)] = w
    assert of(" ".join(clean + bad)) == alone


def test_toxicity_edges(odd, empty, labels):
    model = toxicity.fit(odd, labels)
    out = toxicity.score(odd, model, keep=tuple(odd.columns[:3])).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


# ---- language model ----------------------------------------------------------------------------------------

def brute_ctw(train, text):
    """Sequential definition: counts at every node from the training texts, weighted bottom-up, then mixed."""
    counts = {}
    for t in train:
        for code in lm_ctw.grams(t.encode().lower()).tolist():
            byte, context = code & 255, code >> 8
            for d in range(lm_ctw.DEPTH + 1):
                c = context >> (8 * (lm_ctw.DEPTH - d))
                for j in range(8):
                    n = counts.setdefault((d, c, (1 << j) | (byte >> (8 - j))), [0, 0])
                    n[(byte >> (7 - j)) & 1] += 1
    children = {}
    for d, c, p in counts:
        if d:
            children.setdefault((d - 1, c >> 8, p), []).append((d, c, p))

    def kt(n):
        return float(lm_ctw.ln_kt(np.array([n[0]]), np.array([n[1]]))[0])

    memo = {}

    def weighted(node):
        if node not in memo:
            own = kt(counts[node])
            memo[node] = own if node[0] == lm_ctw.DEPTH else float(
                np.logaddexp(own, sum(weighted(x) for x in children.get(node, []))) - np.log(2))
        return memo[node]

    total = 0.0
    for code in lm_ctw.grams(text.encode().lower()).tolist():
        byte, context = code & 255, code >> 8
        for j in range(8):
            bit, path, p = (byte >> (7 - j)) & 1, (1 << j) | (byte >> (8 - j)), None
            for d in range(lm_ctw.DEPTH, -1, -1):
                node = (d, context >> (8 * (lm_ctw.DEPTH - d)), path)
                n = counts.get(node, [0, 0])
                k = (n[bit] + 0.5) / (sum(n) + 1)
                if p is None:
                    p = k
                else:
                    stop = np.exp(kt(n) - np.log(2) - weighted(node)) if node in counts else 0.5
                    p = stop * k + (1 - stop) * p
            total += np.log10(p)
    return total


def test_ctw_equals_brute_force(spark):
    rows = [(0, "the cat sat"), (1, "The cat on the mat"), (2, None), (3, "a dog, a cat"), (4, "the cat sat"), (5, "été")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_ctw.score(docs, F.col("doc_id") < 4, block_bytes=20).collect()}
    train = [t or "" for i, t in rows if i < 4]
    known = {}
    for t in train:
        for w in t.encode().lower().split() + [b" "]:
            known[w] = known.get(w, 0) + 1
    n, v = sum(known.values()), len(known)
    for i, t in rows:
        assert got[i]["score"] == pytest.approx(brute_ctw(train, t or ""), rel=1e-5)
        ws = (t or "").encode().lower().split() + [b" "]
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(ws), sum(w in known for w in ws), n)
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((known.get(w, 0) + 1) / (n + v + 1)) for w in ws))


def test_ctw_is_a_distribution(spark):
    """Over all next bytes and the end, probabilities in a context add up to one."""
    codes = np.array([(97 << 32 | 98 << 24 | 99 << 16 | 100 << 8 | 101) << 8 | b for b in range(256)], np.uint64)
    codes = codes[:256]
    counts = np.zeros(256, np.int64)
    counts[[97, 98, 255]] = [5, 2, 1]
    level = lm_ctw.subtrees(codes, counts)[2]
    keys, at = np.unique(level.parents(), return_inverse=True)
    top = lm_ctw.Top(keys.astype(int), np.bincount(at, level.n0), np.bincount(at, level.n1), np.bincount(at, level.weighted))
    assert (2.0 ** -lm_ctw.code_lengths(codes, counts, top)).sum() == pytest.approx(1.0)


def test_ctw_edges(odd, empty):
    out = lm_ctw.score(odd, F.col("doc_id") < 4).collect()
    assert len(out) == odd.count() and all(np.isfinite(r["score"]) for r in out)
    assert lm_ctw.score(empty, F.lit(True)).count() == 0
    assert all(np.isfinite(r["score"]) for r in lm_ctw.score(odd, F.lit(False)).collect())


# ---- url filter --------------------------------------------------------------------------------------------

def test_url_filter(spark):
    urls = ["http://a.com", "http://a.com/", "https://EXAMPLE.com/en/x?y", "http://www.example.com/en/1", "http://x.net/es/",
            "http://xnet/es/", "http://net/fr/#a", "noscheme/en/", None, "http://example.com/EN/", "a://b://c.com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, RULES).collect()}
    assert got[0] == ("a.com", "", None, "allow")
    assert got[1] == ("a.com", "/", "com/", "allow")
    assert got[2] == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[3] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[4][2:] == ("net/es/", "block") and got[5][2:] == (None, "allow") and got[6][2:] == ("net/fr/", "block")
    assert got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    assert got[9][2:] == ("com/", "allow") and got[10][0] == "b:"
    assert urlfilter.judge(pages, []).where("verdict = 'allow'").count() == len(urls)
    assert urlfilter.judge(pages.limit(0), RULES).count() == 0


def test_digest_collisions_are_confirmed(tmp_path):
    data = urlfilter.digest_array([("block", "a.com/"), ("allow", "b.com/x")])
    (tmp_path / "d").write_bytes(data)
    array = urlfilter.DigestArray(str(tmp_path / "d"))
    assert array.probe(array.keys.copy(), [b"other", b"strings"]).tolist() == [-1, -1]


# ---- line dedup --------------------------------------------------------------------------------------------

def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(held.get(key(x), ())) >= 3 and max(held[key(x)]) != d)]
        out[d] = ("\n".join(keep), len(lines), len(lines) - len(keep))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (4, 3)])
def test_line_runs(spark, batches, fanout):
    rng = random.Random(2)
    pool = [f"Line number {i} that is long enough" for i in range(12)] + ["short", " \tLINE number 3 that is long enough\x0b", ""]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 6))) or None) for i in range(40)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, digest string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in
           linededup.dedup_lines(docs, batches=batches, fanout=fanout).collect()}
    assert got == brute_lines(rows)


def test_line_runs_batches_and_edges(spark, odd, empty):
    lines = lambda xs: spark.createDataFrame([(d, bytearray(x.encode())) for d, x in xs], "doc_id long, digest binary")
    runs = linededup.LineRuns(fanout=2)
    assert runs.add(lines([(1, "a"), (2, "a"), (2, "b")])).count() == 2
    assert [bytes(r["digest"]) for r in runs.add(lines([(3, "a"), (3, "c")])).collect()] == [b"c"]
    assert set(runs.levels) == {1}
    got = {bytes(r["digest"]): (r["n_docs"], r["last_doc"]) for r in runs.totals().collect()}
    assert got == {b"a": (3, 3), b"b": (1, 2), b"c": (1, 3)}
    out = linededup.dedup_lines(odd)
    assert out.count() == odd.count() and out.columns[:5] == odd.columns
    assert linededup.dedup_lines(empty).count() == 0


# ---- html --------------------------------------------------------------------------------------------------

def test_html_blocks_and_differencing(spark):
    def page(body, extra=""):
        return (f"<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><div>Shared line of the host</div>{body}"
                f"<div>Second shared line</div><!-- x --><script>var a='<p>no</p>'</script>{extra}<footer>&copy; f</footer>")

    rows = [(1, "http://h.com/a/1", page("<article><h1>A &amp; B</h1><p>one<br>two\n  three<p>four<b>five</b>"
                                         "<div class='comments'><p>first!</p></div></article>")),
            (2, "http://h.com/a/2", page("<p>Only this is the text of two</p>")),
            (3, "http://h.com/a/3", page("<p>And this of three &lt;x&gt;</p>", "<form>f</form><div id=cookie-notice>c</div>")),
            (4, "http://other.com/", None), (5, None, ""), (6, "http://h.com/b", "<p>bare"), (6, "http://h.com/b", "<p>bare")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {}
    for r in htmldiff.extract(pages).collect():
        got.setdefault(r["page_id"], []).append((r["text"], r["n_chars"]))
    text = "A & B\none two three\nfourfive"
    assert got[1] == [(text, len(text))]
    assert got[2] == [("Only this is the text of two", 28)]
    assert got[3][0][0] == "And this of three <x>"
    assert got[4] == got[5] == [("", 0)] and got[6] == [("bare", 4)] * 2
    assert htmldiff.extract(pages.limit(0)).count() == 0


def test_html_copies_on_one_host_lose_the_furniture(spark):
    def page(own):
        return f"<html><body><div>Plain menu of the host</div><div>{own}</div><div>Plain notice of the host</div></body>"

    rows = [(1, "http://h.com/a", page("Text of one")), (7, "http://h.com/z", page("Text of seven"))]
    rows += [(i, f"http://h.com/m/{i}", page("Text that five pages share")) for i in range(2, 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in htmldiff.extract(pages).collect()}
    assert got == {1: "Text of one", 7: "Text of seven"} | dict.fromkeys(range(2, 7), "Text that five pages share")


def test_html_equals_articles_of_the_pages(spark, sf_dir):
    import html
    out = QUERIES["op5_page_differencing"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id").collect()
    for r in out:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert r["text"] == "\n".join(x for x in blocks if x)


def test_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(0, 12))] for _ in range(2))
        dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            dp[i + 1][j + 1] = dp[i][j] + 1 if a[i] == b[j] else max(dp[i][j + 1], dp[i + 1][j])
        at = decontam.common_subsequence(a, b)
        assert len(at) == dp[-1][-1] and at == sorted(set(at))
        it = iter(b)
        assert all(x in it for x in (a[i] for i in at))


# ---- near-duplicates -----------------------------------------------------------------------------------------

def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(6)
    rows, nid = [], 0
    for _ in range(25):
        base = words(rng, rng.randrange(60, 200), 400).split()
        for _ in range(rng.choice([1, 1, 2, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 30])):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            rows.append((nid, " ".join(copy)))
            nid += 1
    rows += [(nid, None), (nid + 1, ""), (nid + 2, "ab c"), (nid + 3, "ab  C"), (nid + 4, "!!")]
    got = {r["doc_id"]: r["class_id"] for r in
           minhash_icws.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=4000)[0].collect()}
    sets = {}
    for d, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        n = min(5, len(w))
        sets[d] = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, ta), (b, tb) in itertools.combinations(rows, 2):
        same = (ta or "") == (tb or "")
        if same or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {d: find(d) for d in sets}
    assert got == want


def test_hot_copies_and_edges(spark, odd, empty):
    rng = random.Random(8)
    base = words(rng, 100, 500).split()
    rows = [(i, " ".join(base)) for i in range(300)] + [(300 + i, " ".join(base[:50] + [f"z{i}"] + base[51:])) for i in range(300)]
    classes, links = minhash_icws.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert classes.where("class_id = 0").count() == 600
    assert links.count() < 301 * minhash_icws.BANDS / 2        # a few per text and band, not 45,150 pairs
    got = minhash_icws.near_duplicates(odd)[0]
    assert got.count() == odd.count()
    assert {r["class_id"] for r in got.where("doc_id in (4, 5)").collect()} == {4}
    kept = minhash_icws.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 4, 6, 7]
    assert minhash_icws.near_duplicates(empty)[0].count() == 0


def test_odd_sketches_never_overstate_the_difference():
    rng = np.random.default_rng(4)
    for n in (3, 50, 400, 5000):
        keys = np.unique(rng.integers(0, 1 << 48, n).astype(np.uint64))
        idf = 1 + rng.random(len(keys)) * 9
        one, two = rng.random(len(keys)) < 0.9, rng.random(len(keys)) < 0.9
        x = minhash_icws.odd_sketches(keys[one], idf[one]) ^ minhash_icws.odd_sketches(keys[two], idf[two])
        bits = np.bitwise_count(x.view(np.uint64)).reshape(len(minhash_icws.LEVELS), -1).sum(axis=1)
        assert bits[0] <= (one ^ two).sum()
        assert (bits * np.diff(minhash_icws.LEVELS, prepend=0)).sum() <= idf[one ^ two].sum() + 1e-9


def test_buckets_of_many_texts_around_the_threshold_lose_no_link(spark):
    rng = random.Random(12)
    base = words(rng, 120, 5000).split()
    rows = []
    for i in range(160):
        text = list(base)
        for at in rng.sample(range(len(text)), rng.choice([1, 2, 3, 4, 6, 9])):
            text[at] = f"v{i}x{at}"
        rows.append((i, " ".join(text)))
    classes, links = minhash_icws.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["class_id"] for r in classes.collect()}
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    df = collections.Counter(s for x in sets.values() for s in x)
    weight = {s: np.log((len(rows) + 1) / (n + 1)) + 1 for s, n in df.items()}
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both, any_ = sets[a] & sets[b], sets[a] | sets[b]
        if len(both) >= 0.8 * len(any_) or sum(map(weight.get, both)) >= 0.8 * sum(map(weight.get, any_)):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in range(len(rows))}
    assert len(set(got.values())) > 20          # many texts are below the threshold to all others


def test_icws_collision_rate_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 48, 400).astype(np.uint64))
    a, b = rng.random(len(keys)) + 0.2, rng.random(len(keys)) + 0.2
    want = (np.minimum(a, b).sum() / np.maximum(a, b).sum()) ** minhash_icws.ROWS
    hits = [np.mean(minhash_icws.icws_bands(k, a) == minhash_icws.icws_bands(k, b))
            for k in (np.unique(rng.integers(0, 1 << 48, 400).astype(np.uint64)) for _ in range(40)) if len(k) == len(a)]
    assert abs(np.mean(hits) - want) < 0.08


# ---- quality ---------------------------------------------------------------------------------------------

def test_quality_held_out(spark):
    rng = random.Random(9)
    rows, lab = [], []
    for i in range(500):
        good = i % 3 > 0
        text = words(rng, 80) + "." if good else rng.choice(["buy! " * 60, "| x | " * 40, words(rng, 3) + "%%% ###" * 20])
        rows.append((i, text))
        lab.append((i, int(good)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, quality int")
    vectors = quality_qda.with_statistics(docs)
    model = quality_qda.fit(vectors, docs, lab, learn=crc_fold("doc_id", 3) != 1)
    out = quality_qda.score(vectors, model).join(lab, "doc_id").where(crc_fold("doc_id", 3) == 1).collect()
    assert out and np.mean([r["predicted"] == r["quality"] for r in out]) >= 0.97


def test_quality_edges(odd, empty, labels):
    vectors = quality_qda.with_statistics(odd)
    out = quality_qda.score(vectors, quality_qda.fit(vectors, odd, labels)).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    none = quality_qda.with_statistics(empty)
    assert quality_qda.score(none, quality_qda.fit(none, empty, labels)).count() == 0


# ---- fertility ---------------------------------------------------------------------------------------------

def test_fertility_base_counts(spark):
    texts = ["a b c a b c", "x # $ x\nx # $ x\n\n", None, "", "a\x0bb\tc", "aaa\naaa\n aaa\n" * 3, "p q r s p q r t"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in fertility.judge(docs).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(ws[k:k + 3]) for k in range(len(ws) - 2)]
        hit = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] and not got[i]["kept"]


def test_fertility_bands(spark, odd, empty):
    rng = random.Random(10)
    rows = [(i, words(rng, 90), "en") for i in range(200)] + [(200, " ".join(chr(0x13000 + rng.randrange(900)) * 3 for _ in range(90)), "en")]
    got = {r["doc_id"]: r for r in fertility.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["kept"] for i in range(200)) and not got[200]["kept"] and got[200]["fallback_share"] > 0.5
    assert fertility.judge(odd).count() == odd.count() == fertility.judge(odd, group=None).count()
    clash = odd.withColumns({c: F.col("score") for c in ("n_words", "entropy", "of", "c0", "low", "_text", "kept")})
    assert fertility.judge(clash, keep=("doc_id", "label", "of", "c0")).columns[:4] == ["doc_id", "label", "of", "c0"]
    assert fertility.judge(clash, keep=("doc_id", "of")).count() == odd.count()
    with pytest.raises(ValueError):
        fertility.judge(clash, keep=("doc_id", "kept"))
    assert fertility.judge(empty).count() == 0


def test_fertility_verdicts_equal_brute_force(spark):
    """Measures, bands of length classes and verdicts again, from the definitions, token by token."""
    import base64

    import public_tokenizers as P
    import sentencepiece
    import tiktoken
    rng = random.Random(21)
    junk = lambda n: " ".join(f"w{rng.randrange(60)}x###" for _ in range(n))
    rows = [(i, words(rng, rng.choice([50, 55, 63, 64, 90, 127, 128, 200])), rng.choice(["en", "fr", None])) for i in range(400)]
    rows += [(400 + i, junk(80) if i % 2 else words(rng, 80), "en") for i in range(20)] + [(500 + i, rows[3][1], "en") for i in range(90)]
    rows += [(600, words(rng, 20_000, 4000), "en"), (601, "x y " * 100, "en")]
    got = {r["doc_id"]: r for r in fertility.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    piece = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    multi = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    seen, measured = {}, {}
    for i, t, lang in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        for w in set(ws) - set(seen):
            seen[w] = piece.encode(w), multi.encode_ordinary(w)
        tokens = [x for w in ws for x in seen[w][0]]
        counts = np.array(list(collections.Counter(tokens).values()))
        share = counts / counts.sum()
        chars = sum(map(len, ws))
        measured[i] = (chars / len(tokens), chars / sum(len(seen[w][1]) for w in ws), sum(piece.is_byte(x) for x in tokens) / len(tokens),
                       float(-(share * np.log2(share)).sum() / np.log2(len(tokens) + 2)))
        r = got[i]
        assert np.allclose([r[m] for m in fertility.MEASURES], measured[i])
        assert r["base_failed"] == (len(ws) < 50 or 100 * r["n_repeat_words"] > 50 * len(ws))

    def limits(ids, reach, least, chance):
        distinct = {(got[i]["n_words"], got[i]["word_chars"], *(got[i][m] for m in fertility.MEASURES)) for i in ids}
        out = []
        for k, m in enumerate(fertility.MEASURES):
            x = sorted(d[2 + k] for d in distinct)
            q1, q3 = x[-(-len(x) // 4) - 1], x[-(-3 * len(x) // 4) - 1]
            span = max(reach * (q3 - q1), least[m] + chance[m] / min(d[0] for d in distinct) ** 0.5)
            out.append((q1 - span, q3 + span))
        return len(distinct), out

    small = 0
    for i, t, lang in rows:
        if got[i]["base_failed"]:
            assert not got[i]["kept"]
            continue
        group = [j for j, _, other in rows if other == lang and not got[j]["base_failed"]]
        n, band = limits([j for j in group if int(got[j]["n_words"]).bit_length() == int(got[i]["n_words"]).bit_length()],
                         fertility.CLASS_REACH, fertility.CLASS_LEAST, fertility.CLASS_CHANCE)
        if n < fertility.CLASS_TEXTS:
            small += 1
            _, band = limits(group, fertility.REACH, fertility.LEAST, dict.fromkeys(fertility.MEASURES, 0.0))
        assert got[i]["kept"] == all(lo <= got[i][m] <= hi for m, (lo, hi) in zip(fertility.MEASURES, band)), i
    assert small and not any(got[401 + i]["kept"] for i in range(0, 20, 2)) and sum(r["kept"] for r in got.values()) > 400


# ---- packing -----------------------------------------------------------------------------------------------

def check_packing(out, docs, size):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, t in docs.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        parts = sorted(by_doc[d], key=lambda r: r["start"])
        assert [r["start"] for r in parts] == list(np.cumsum([0] + [r["length"] for r in parts])[:-1])
        assert sum(r["length"] for r in parts) == len(ids) == parts[0]["doc_tokens"]
        for r in parts:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes())
    for places in by_seq.values():
        places.sort()
        assert [o for o, _ in places] == list(np.cumsum([0] + [n for _, n in places])[:-1]) and sum(n for _, n in places) <= size
    assert sorted(by_seq) == list(range(len(by_seq)))
    return len(by_seq)


def test_packing_round_trip(spark):
    rng = random.Random(12)
    docs = {i: words(rng, rng.randrange(0, 300)) for i in range(60)} | {60: None, 61: "", 62: words(rng, 9000, 5000),
                                                                       63: "a\x1cb c\u2003d É <|endoftext|> x"}
    out = packing.pack(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    n = check_packing(out, docs, packing.SIZE)
    assert n <= -(-sum(r["length"] for r in out) // packing.SIZE) + 2


def test_shortest_pack_first_places_everything():
    rng = random.Random(13)
    for _ in range(100):
        size = rng.choice([16, 64])
        hist = {rng.randrange(1, size + 1): rng.randrange(1, 40) for _ in range(8)}
        placed = {}
        for pattern, count in packing.shortest_pack_first(hist, size):
            assert sum(pattern) <= size and count > 0
            for x in pattern:
                placed[x] = placed.get(x, 0) + count
        assert placed == hist


def test_packing_edges(odd, empty):
    out = packing.pack(odd)
    assert out.where("start = 0").count() == odd.count() and out.select("doc_id", "start", "offset").count() >= odd.count()
    assert packing.pack(empty).count() == 0


# ---- decontamination ---------------------------------------------------------------------------------------

def test_decontamination(spark, odd, empty):
    rng = random.Random(14)
    items = [(i, words(rng, rng.randrange(15, 60), 3000)) for i in range(30)] + [(30, words(rng, 200, 3000)), (31, None), (32, "")]
    docs, want = [], set()
    for i in range(150):
        text = words(rng, rng.randrange(0, 400), 3000).split()
        if i % 5 == 0:
            item = rng.randrange(31)
            leak = items[item][1].split()
            if i % 10 == 0:                        # paraphrase: some words go, the last ones stay
                for _ in range(len(leak) // 8):
                    leak.pop(rng.randrange(len(leak) - 8))
            at = rng.randrange(len(text) + 1)
            text[at:at] = leak
            want.add((i, item))
        docs.append((i, " ".join(text), "x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    got = {(r["doc_id"], r[1]) for r in decontam.find_leaks(frame, bench).collect()}
    assert got == want
    left = decontam.drop_leaks(frame, bench)
    assert left.columns == frame.columns and {r["doc_id"] for r in left.collect()} == {d for d, *_ in docs} - {d for d, _ in want}
    assert decontam.find_leaks(empty, bench).count() == 0
    assert decontam.find_leaks(odd, bench.limit(0)).count() == 0
    assert decontam.drop_leaks(odd, bench).count() == odd.count()


def test_latent_space_comes_from_all_documents(spark, monkeypatch):
    """Its singular vectors are those of the passages and every document's whole text, however many documents there are."""
    rng = random.Random(31)
    monkeypatch.setattr(decontam, "RANK", 4)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n, weights=None: " ".join(rng.choices(vocabulary, weights, k=n))
    items = [(i, text(12)) for i in range(5)]
    docs = [(i, text(rng.randrange(300), [1 + 9 * (i % 4 == k % 4) for k in range(40)]) + " other") for i in range(2500)] + [(None, None)]
    p, = decontam.prepare(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))

    def counts(t):
        return np.bincount([p.vocabulary[w] for w in t.split() if w in p.vocabulary], minlength=len(p.vocabulary)).astype(float)

    own, rest = (np.stack([counts(t or "") for _, t in rows]) for rows in (items, docs))
    idf = np.log((len(docs) + 1) / ((rest > 0).sum(axis=0) + 0.5)).clip(min=0.05)
    assert np.allclose(p.idf, idf)
    own, rest = (m * idf / np.maximum(np.linalg.norm(m * idf, axis=1, keepdims=True), 1e-9) for m in (own, rest))
    vectors = np.linalg.eigh(own.T @ own + rest.T @ rest * decontam.CORPUS_ROWS / len(docs))[1][:, -4:]
    basis = p.basis / idf[:, None]
    assert np.abs(basis @ basis.T - vectors @ vectors.T).max() < 1e-3


def test_excerpts_of_long_items_are_found_wherever_they_start(spark):
    rng = random.Random(21)
    items = [(i, words(rng, n, 3000)) for i, n in enumerate((128, 200, 300))]
    docs, want = [(i, words(rng, 200, 3000)) for i in range(60)], set()
    for item, text in items:
        own = text.split()
        for size in (30, 50):
            for at in range(0, len(own) - size + 1, 5):
                rest = words(rng, 100, 3000).split()
                want.add((len(docs), item))
                docs.append((len(docs), " ".join(rest[:60] + own[at:at + size] + rest[60:])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(frame, bench).collect()} == want


# ---- queries against their SQL, and the pipeline -------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLE[name]).fetchdf()
    got = QUERIES[name](spark, sf_dir).toPandas()[list(want.columns)]
    by = list(want.columns)
    a, b = (x.astype(object).where(x.notna(), None).sort_values(by, key=lambda c: c.astype(str)).to_numpy().tolist() for x in (got, want))
    assert a == b


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        n = docs.count()
        from corpusforge.session import materialize
        docs = materialize(stage(spark, docs, sf_dir), f"test_{name}")
        assert docs.columns == columns and docs.count() <= n
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.select("doc_id").distinct().count() == docs.count()
