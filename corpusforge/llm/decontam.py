"""Benchmark decontamination by latent semantic retrieval.

Benchmark items of at most ``PASSAGE`` words are one passage; longer ones are cut into overlapping passages of
``PART_WORDS`` words every ``PART_STEP``, so that a verbatim excerpt of ``COVER * PART_WORDS`` words covers enough of
one of them wherever it starts.  Document frequencies of their words come from all documents.  A distributed randomised SVD (Gaussian range finder with power iterations; Spark sums the
partial products) of the TF-IDF matrix of the passages and of all documents, each with its whole text, gives the
latent space; the documents' rows are scaled so that together they weigh no more than ``CORPUS_ROWS`` rows.  A document whose words, wherever they stand, weigh too little for any passage is
passed over (this loses nothing); every other one is cut into overlapping windows, long enough that any passage lies whole in
one of them.  Windows whose words weigh too little for a passage are passed over in the same way; each other one is projected,
and every passage whose cosine reaches ``COSINE`` is a candidate, and besides every passage that the window could hold whole by
its words' weight, so a low cosine loses no verbatim passage.  A candidate counts if the longest common subsequence of words covers enough of the passage, plainly and by IDF;
passages covered in part (paraphrases) must also show the words of the item's last sentence, its answer.

The benchmark is worked off in blocks of ``ITEMS_PER_BLOCK`` passages, so what is broadcast has a fixed bound;
every block sees all documents.  Nulls and empty texts have no windows and no leak; items without words match
nothing; repeated documents are reported alike.  An empty benchmark or table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import Carried, map_batches, release_memory, text_of

TOKEN = re.compile(r"[^\W_]+")
PASSAGE, WINDOW, STRIDE = 64, 112, 48
PART_WORDS, PART_STEP = 40, 16
ITEMS_PER_BLOCK = 2000
RANK, EXTRA, POWER = 224, 16, 1
CORPUS_ROWS = 2000          # what all documents weigh together in the SVD, in rows of a passage's weight
COSINE = 0.15
COVER, WEIGHTED = 0.6, 0.6                  # share of the passage's words, and of their IDF, in order
PART, PART_WEIGHTED, ANSWER = 0.45, 0.5, 0.75   # for paraphrases
CHUNK = 8192                # words projected at a time


def words_of(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def _latin_table() -> bytes:
    """Each code point up to U+00FF lowered, or a blank where it belongs to no word."""
    return b"".join(chr(c).lower().encode("latin-1") if TOKEN.fullmatch(chr(c)) else b" " for c in range(256))


LATIN = _latin_table()


class Vocabulary:
    """Numbers of known words in texts; texts within Latin-1 are cut into words bytewise, which gives the same words faster."""

    def __init__(self, numbers: dict[str, int]):
        self.numbers, self.latin = numbers, {}
        for w, i in numbers.items():
            try:
                self.latin[w.encode("latin-1")] = i
            except UnicodeEncodeError:
                pass

    def _words(self, text: str) -> tuple[list, dict]:
        try:
            return text.encode("latin-1").translate(LATIN).split(), self.latin
        except UnicodeEncodeError:
            return words_of(text), self.numbers

    def numbers_of(self, text: str) -> np.ndarray:
        """The number of every word in order, -1 for unknown ones."""
        words, known = self._words(text)
        return np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the known words in the text, and how often each occurs."""
        words, known = self._words(text)
        found = Counter(words)
        both = known.keys() & found.keys()
        return np.fromiter(map(known.get, both), np.int32, len(both)), np.fromiter(map(found.get, both), np.int32, len(both))


@dataclass
class Passages:
    """One block of benchmark passages with what the search needs."""

    keys: list[tuple[int, int]]          # item_id, number of the passage
    ids: list[np.ndarray]                # words of each passage
    answers: list[np.ndarray]            # distinct words of the item's last sentence that lie in the passage
    vocabulary: dict[str, int]
    idf: np.ndarray | None = None
    basis: np.ndarray | None = None      # words x rank, rows scaled by IDF
    latent: np.ndarray | None = None     # passages x rank, unit rows


def passage_starts(n: int) -> list[int]:
    """Where the passages of an item of ``n`` words begin; the last one ends with the item."""
    if n <= PASSAGE:
        return [0]
    return [*range(0, n - PART_WORDS, PART_STEP), n - PART_WORDS]


def cut_items(rows: list[tuple[int, str]]) -> Passages:
    vocabulary: dict[str, int] = {}
    out = Passages([], [], [], vocabulary)
    for item, text in rows:
        words = words_of(text or "")
        if not words:
            continue
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words])
        sentences = [s for s in re.split(r"[.?!\n]+", text) if words_of(s)]
        answer = np.unique([vocabulary[w] for w in words_of(sentences[-1])])
        for k, at in enumerate(passage_starts(len(ids))):
            part = ids[at:at + (PASSAGE if len(ids) <= PASSAGE else PART_WORDS)]
            out.keys.append((item, k))
            out.ids.append(part)
            out.answers.append(np.intersect1d(answer, part))
    return out


def _tf_idf(terms: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = n * idf[terms]
    return v / (np.linalg.norm(v) or 1.0)


def term_rows(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """A row per document: the words of the vocabulary in its whole text (``terms``) and how often each occurs (``n``)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = Vocabulary(shared.value)
        for pdf in batches:
            yield pd.DataFrame([known.counts(text) for text in pdf["_text"]], columns=["terms", "n"])
        release_memory()

    return map_batches(docs.select(text_of().alias("_text")), run, "terms array<int>, n array<int>")


def document_frequencies(rows: DataFrame, d: int) -> tuple[np.ndarray, int]:
    """In how many of the documents behind :func:`term_rows` each of the ``d`` words occurs, and how many documents there are."""
    df = np.zeros(d)
    for r in rows.select(F.explode("terms").alias("id")).groupBy("id").count().collect():      # one row per word of the block
        df[r["id"]] = r["count"]
    return df, rows.count()


def latent_basis(rows: DataFrame, p: Passages, n_docs: int) -> np.ndarray:
    """Randomised SVD of the TF-IDF rows of the passages and of all documents; returns the right singular vectors (words x rank)."""
    spark, d = rows.sparkSession, len(p.vocabulary)
    width = min(RANK + EXTRA, d, len(p.ids) + n_docs)
    idf = spark.sparkContext.broadcast(p.idf)
    scale = float(np.sqrt(min(1.0, CORPUS_ROWS / max(n_docs, 1))))
    own = [(*(x.tolist() for x in np.unique(ids, return_counts=True)), 1.0) for ids in p.ids]
    rows = rows.where(F.size("terms") > 0).withColumn("scale", F.lit(scale)).unionByName(
        spark.createDataFrame(own, "terms array<int>, n array<int>, scale double"))
    # every task yields a matrix of its own, so their number follows the cores and not the input
    rows = rows.coalesce(2 * spark.sparkContext.defaultParallelism)

    def gram_times(q: np.ndarray) -> np.ndarray:
        """A^T A q, summed over the tasks slab by slab."""
        shared = spark.sparkContext.broadcast(q.astype(np.float32))

        def run(batches):
            m = shared.value
            out = np.zeros(m.shape, np.float32)
            for pdf in batches:
                for t, n, s in zip(pdf["terms"], pdf["n"], pdf["scale"]):
                    x = (s * _tf_idf(t, n, idf.value)).astype(np.float32)
                    out[t] += np.outer(x, x @ m[t])
            for lo in range(0, len(out), 1024):
                yield pd.DataFrame({"slab": [lo], "z": [out[lo:lo + 1024].tobytes()]})
            release_memory()

        def add(pdf):
            z = sum(np.frombuffer(b, np.float32) for b in pdf["z"])
            return pd.DataFrame({"slab": pdf["slab"][:1], "z": [z.tobytes()]})

        z = np.zeros(q.shape, np.float32)
        for r in (map_batches(rows, run, "slab int, z binary").groupBy("slab")
                  .applyInPandas(add, "slab int, z binary").toLocalIterator()):
            part = np.frombuffer(r["z"], np.float32).reshape(-1, q.shape[1])
            z[r["slab"]:r["slab"] + len(part)] = part
        return z

    q = np.linalg.qr(np.random.default_rng(7).standard_normal((d, width)))[0]
    for _ in range(POWER + 1):
        z = gram_times(q)
        q = np.linalg.qr(z.astype(float))[0]
    small = q.T @ gram_times(q)                 # Q^T A^T A Q
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(values)[::-1][:min(RANK, width)]
    return (q @ vectors[:, best]).astype(np.float32)


def prepare(docs: DataFrame, benchmark: DataFrame) -> list[Passages]:
    """The benchmark's blocks, ready for the search."""
    spark = docs.sparkSession
    words = F.regexp_count(text_of(), F.lit(r"(?U)[^\W_]+"))
    passages = F.when(words <= PASSAGE, F.lit(1)).otherwise(F.ceil((words - PART_WORDS) / float(PART_STEP)) + 1)
    n = benchmark.agg(F.sum(passages).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(n) // ITEMS_PER_BLOCK))
    items = benchmark.select("item_id", text_of().alias("text")).where("item_id IS NOT NULL").dropDuplicates()
    out = []
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        p = cut_items([(r["item_id"], r["text"]) for r in own])
        if not p.keys:
            continue
        rows = materialize(term_rows(docs, p.vocabulary), "lsi_rows")
        df, n_docs = document_frequencies(rows, len(p.vocabulary))
        p.idf = np.log((n_docs + 1.0) / (df + 0.5)).clip(min=0.05)
        basis = latent_basis(rows, p, n_docs)
        p.basis = basis * p.idf[:, None].astype(np.float32)
        latent = np.stack([p.basis[ids].sum(axis=0) for ids in p.ids])
        p.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        out.append(p)
    return out


def common_subsequence(a: list[int], b: list[int]) -> list[int]:
    """Positions of ``a`` in one longest common subsequence with ``b`` (bit-parallel rows, then traced back)."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v, rows = full, [full]
    for x in b:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, i, j = [], len(a) - 1, len(b)
    while i >= 0 and j > 0:
        if not (rows[j] >> i) & 1:                       # length grows at a[i] within b[:j]
            if (rows[j - 1] >> i) & 1:                   # and not within b[:j-1]: b[j-1] matches here
                out.append(i)
                i -= 1
                j -= 1
            else:
                j -= 1
        else:
            i -= 1
    return out[::-1]


class Search:
    """Leaks of one block's passages in texts."""

    def __init__(self, p: Passages):
        self.p = p
        self.lists = [ids.tolist() for ids in p.ids]
        self.weight = [p.idf[ids] for ids in p.ids]
        # postings: per word the passages that hold it and the IDF that it adds there
        word = np.concatenate(p.ids)
        owner = np.repeat(np.arange(len(p.ids)), [len(x) for x in p.ids])
        order = np.argsort(word, kind="stable")
        self.owner, self.mass = owner[order], p.idf[word[order]]
        self.first = np.searchsorted(word[order], np.arange(len(p.vocabulary) + 1))
        total = np.array([w.sum() for w in self.weight])
        self.need, self.need_whole = PART_WEIGHTED * total - 1e-6, WEIGHTED * total - 1e-6
        self.vocabulary = Vocabulary(p.vocabulary)
        self.lookup = np.zeros(len(p.vocabulary) + 1)     # per word (last: unknown) what it weighs in one passage

    def possible(self, ids: np.ndarray) -> np.ndarray:
        """Passages whose words in the text weigh enough for a leak, wherever they stand (loses none)."""
        words = np.unique(ids)
        words = words[np.searchsorted(words, 0):]
        lo, n = self.first[words], self.first[words + 1] - self.first[words]
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(words) else words
        return np.flatnonzero(np.bincount(self.owner[at], self.mass[at], len(self.need)) >= self.need)

    def leaks(self, text: str) -> list[tuple[int, float, float, float, int]]:
        """(item_id, cosine, covered share, answer share, first word of the window), the best window per item."""
        ids = self.vocabulary.numbers_of(text)
        best: dict[int, tuple] = {}
        few = self.possible(ids)
        if not len(few):
            return []
        for lo in range(0, max(1, len(ids)), CHUNK):
            own = ids[lo:lo + CHUNK + WINDOW]
            if lo and len(own) <= WINDOW - STRIDE:
                break
            self._windows(own, lo, few, best)
        return [(item, *x) for item, x in sorted(best.items())]

    def _heavy(self, ids: np.ndarray, starts: np.ndarray, few: np.ndarray) -> list[tuple[int, int, float]]:
        """(window, passage, mass) where the window's words weigh enough for the passage; repeats count, so nothing is lost."""
        found, sums = [], np.zeros(len(ids) + 1)
        stops = np.minimum(starts + WINDOW, len(ids))
        for k in few.tolist():
            np.add.at(self.lookup, self.p.ids[k], self.weight[k])
            np.cumsum(self.lookup[ids], out=sums[1:])
            self.lookup[self.p.ids[k]] = 0
            mass = sums[stops] - sums[starts] + 1e-6
            found += [(w, k, float(mass[w])) for w in np.flatnonzero(mass >= self.need[k]).tolist()]
        return sorted(found)

    def _windows(self, ids: np.ndarray, base: int, few: np.ndarray, best: dict) -> None:
        p = self.p
        starts = np.arange(0, max(1, len(ids) - WINDOW + STRIDE), STRIDE)
        last, z = -1, None
        for w, k, mass in self._heavy(ids, starts, few):
            if w != last:                                  # project the window once for all its passages
                own = ids[starts[w]:starts[w] + WINDOW]
                z, last = p.basis[own[own >= 0]].sum(axis=0), w
                z = z / max(float(np.linalg.norm(z)), 1e-6)
            cosine = float(z @ p.latent[k])
            # below the cosine only windows that could hold the passage whole are compared
            if cosine < COSINE and mass < self.need_whole[k]:
                continue
            window = ids[starts[w]:starts[w] + WINDOW]
            a = self.lists[k]
            if np.isin(p.ids[k], window).sum() < PART * len(a):
                continue
            at = common_subsequence(a, window.tolist())
            cover = len(at) / len(a)
            weighted = float(self.weight[k][at].sum() / self.weight[k].sum())
            if cover < PART or weighted < PART_WEIGHTED:
                continue
            answer = p.answers[k]
            said = float(np.isin(answer, window).mean()) if len(answer) else 1.0
            if not (cover >= COVER and weighted >= WEIGHTED) and said < ANSWER:
                continue
            item = p.keys[k][0]
            got = (cosine, cover, said, int(base + starts[w]))
            if item not in best or got[1] > best[item][1]:
                best[item] = got


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document and benchmark item that it holds: key, item_id, cosine, covered, answered, first_word."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, item_id {dict(benchmark.dtypes)['item_id']}, cosine double, covered double, " \
        "answered double, first_word long"
    out = spark.createDataFrame([], schema)
    for p in prepare(docs, benchmark):
        shared = spark.sparkContext.broadcast(p)

        def run(batches, shared=shared):
            search = Search(shared.value)
            for pdf in batches:
                rows = [(k, *x) for k, text in zip(pdf[key], pdf["_text"]) for x in search.leaks(text)]
                yield pd.DataFrame(rows, columns=[key, "item_id", "cosine", "covered", "answered", "first_word"])
            release_memory()

        out = out.unionByName(map_batches(docs.select(key, text_of().alias("_text")), run, schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, unchanged, whatever their columns are called."""
    spark, carried = docs.sparkSession, Carried(docs, docs.columns)
    rows = docs.select(*carried.columns, text_of().alias("text"))
    for p in prepare(docs, benchmark):
        shared = spark.sparkContext.broadcast(p)

        def run(batches, shared=shared):
            search = Search(shared.value)
            for pdf in batches:
                yield pdf[[not search.leaks(t) for t in pdf["text"]]]
            release_memory()

        rows = map_batches(rows, run, f"{carried.schema}, text string")
    return rows.select(*carried.back())
