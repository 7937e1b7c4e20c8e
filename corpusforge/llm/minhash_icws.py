"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Equal texts are one class from the start; one text of each class goes on.  Its shingles (five words) are hashed
to 48 bits; document frequencies over all classes come from block dictionaries (see blocks.py), and a shingle
weighs tf * idf.  A pair that is similar enough shares most of its weight, so a class whose shared shingles
(document frequency of two or more) hold less than the threshold of its weight and of its number has no partner
and is done.  The others get ``BANDS * ROWS`` consistent weighted samples, banded.  Classes that meet in a band
are compared with the band's center by their exact weighted Jaccard similarity (the plain one counts too, which
a large group of copies would otherwise push under the threshold by its own document frequencies).  Links make
components.  After each of the first rounds the bands that still hold different components get other centers,
twice as many as before; bands of few members are compared whole.  The last round takes every band that still holds
different components: its members outside the band's largest component meet all others.  Of these pairs those go
on to the exact comparison whose odd sketches (parities of hashed shingles, which can only understate the
difference of two texts) leave the threshold within reach.

No bucket is capped and no link between texts that share a band is lost: a pair is compared, or lies in one component,
or its sketches or sizes prove it to be below the threshold.
Texts of fewer than five words have one shingle of all their words; texts without words are near-duplicates
only of equal texts.  Nulls are empty texts.  Rows with a null id get a class but never name one unless the
whole class has no id.  Repeated rows are copies.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .blocks import mix, pack_numbers, pack_sorted, unpack_numbers, unpack_sorted
from .common import BLOCK_BYTES, block_count, map_batches, ship_package, text_of

TOKEN = re.compile(r"\w+")
SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 3
CENTER_ROUNDS = 2            # rounds that compare with few centers, before the one that compares the rest
SMALL_BUCKET = 16            # buckets of so few members are compared whole after the first round
KEY_BITS = 48
MAX_PARTS = 4096
TABLE = 1 << 14              # rows of random variates; a shingle's row is a hash of its key
SKETCH_WORDS = 8             # 64-bit words of an odd sketch
LEVELS = (1.0, 4.0, 7.0)     # a sketch for the keys whose idf reaches each; every idf is 1 or more


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(text: str, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 48-bit keys of a text's shingles and how often each occurs."""
    words = TOKEN.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    n = len(h) - width + 1
    key = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            key = mix(key * np.uint64(0x100000001B3) + h[k:k + n])
    return np.unique(key >> np.uint64(64 - KEY_BITS), return_counts=True)


def _variates() -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(11)
    k = BANDS * ROWS
    r = rng.gamma(2.0, 1.0, (TABLE, k)).clip(1e-3)
    c = rng.gamma(2.0, 1.0, (TABLE, k)).clip(1e-9)
    return tuple(x.astype(np.float32) for x in (1 / r, r, rng.random((TABLE, k)), np.log(c) - r))


_V: list = []


def icws_bands(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One 64-bit id per band: the samples (key, level) of its rows."""
    if not _V:
        _V.extend(_variates())
    inv_r, r, beta, base = _V
    best = np.full(BANDS * ROWS, np.inf, np.float32)
    chosen = np.zeros(BANDS * ROWS, np.uint64)
    level = np.zeros(BANDS * ROWS, np.float32)
    rows = (mix(keys) >> np.uint64(20)).astype(np.int64) & (TABLE - 1)
    log_w = np.log(weights).astype(np.float32)[:, None]
    each = np.arange(BANDS * ROWS)
    for lo in range(0, len(keys), 1024):
        at = rows[lo:lo + 1024]
        t = np.floor(log_w[lo:lo + 1024] * inv_r[at] + beta[at])
        a = base[at] - r[at] * (t - beta[at])
        i = a.argmin(axis=0)
        v = a[i, each]
        better = v < best
        best[better] = v[better]
        chosen[better] = keys[lo:lo + 1024][i[better]]
        level[better] = t[i, each][better]
    sample = mix(chosen ^ mix(level.astype(np.int64).astype(np.uint64)))
    out = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            out = mix(out * np.uint64(0x100000001B3) + sample.reshape(BANDS, ROWS)[:, k])
    return out.astype(np.int64)


def odd_sketches(keys: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """For each level the parities of the numbers of keys in each of 64 * SKETCH_WORDS bins."""
    size = 64 * SKETCH_WORDS
    at = (mix(keys) >> np.uint64(40)).astype(np.int64) % size
    odd = [np.bincount(at[idf >= low], minlength=size).astype(np.uint8) & 1 for low in LEVELS]
    return np.packbits(np.concatenate(odd)).view(np.int64)


def within_reach(threshold: float) -> Column:
    """Whether sizes and sketches leave the plain or the weighted similarity of a row's pair (columns n, weight,
    sketch and c_n, c_weight, c_sketch) room to reach the threshold.

    A key that only one text has flips one bit, so differing bits are at most as many as such keys.  Each of
    them weighs its idf or more, which is the sum of the steps between the levels that it reaches."""
    differ = []
    for level in range(len(LEVELS)):
        bits = [F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("c_sketch")[i]))
                for i in range(level * SKETCH_WORDS, (level + 1) * SKETCH_WORDS)]
        differ.append(sum(bits[1:], bits[0]))
    steps = np.diff(LEVELS, prepend=0.0).tolist()
    least = {"n": differ[0], "weight": sum((x * step for x, step in zip(differ[1:], steps[1:])), differ[0] * steps[0])}

    def room(c: str) -> Column:
        both = F.col(c) + F.col(f"c_{c}")
        return _near(c, threshold) & (both - least[c] >= (threshold - 1e-5) * (both + least[c]))

    return room("n") | room("weight")


def _near(c: str, threshold: float) -> Column:
    return F.least(c, f"c_{c}") >= (threshold - 1e-5) * F.greatest(c, f"c_{c}")


def _first_texts(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, digest, text): each text once per task, so that a hot text is not shuffled by its copies."""
    def run(batches):
        seen: set[bytes] = set()
        for pdf in batches:
            fresh = []
            for d in pdf["digest"]:
                fresh.append(d not in seen)
                if len(seen) < 2_000_000:
                    seen.add(d)
            yield pdf[fresh]

    rows = docs.select("digest", "text").withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(blocks)).cast("int"))
    return map_batches(rows.select("block", "digest", "text"), run, "block int, digest binary, text string")


def _texts(pdf: pd.DataFrame):
    """A block's distinct texts in digest order, with their shingles."""
    cache = WordHashes()
    own = dict(zip(pdf["digest"], pdf["text"]))
    for d in sorted(own):
        yield d, *shingles(own[d], cache)


def _block_keys(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)


def _part_edges(parts: int) -> np.ndarray:
    return (np.arange(1, parts, dtype=object) * (1 << KEY_BITS) // parts).astype(np.uint64)


def document_frequencies(texts: DataFrame, parts: int) -> DataFrame:
    """(block, part, df): for each block the frequencies of its keys in key order, part by part."""
    edges = _part_edges(parts)

    def cut(pdf):
        keys, n = _block_keys([k for _, k, _ in _texts(pdf)])
        at = np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))
        rows = [(int(pdf["block"].iloc[0]), p, pack_sorted(keys[a:b]), pack_numbers(n[a:b].astype("<u4")))
                for p, (a, b) in enumerate(zip(at, at[1:])) if b > a]
        return pd.DataFrame(rows, columns=["block", "part", "keys", "n"])

    def add(pdf):
        lists = [unpack_sorted(x) for x in pdf["keys"]]
        keys, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([unpack_numbers(x, "<u4") for x in pdf["n"]])).astype("<u4")
        ends = np.cumsum([len(x) for x in lists])
        answers = np.split(total[inverse], ends[:-1])
        return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "df": [pack_numbers(x) for x in answers]})

    ship_package(texts.sparkSession)
    return (texts.groupBy("block").applyInPandas(cut, "block int, part int, keys binary, n binary")
            .groupBy("part").applyInPandas(add, "block int, part int, df binary"))


def signatures(texts: DataFrame, frequencies: DataFrame, n_texts: int, threshold: float) -> DataFrame:
    """(digest, bands, sketch, keys, weights, weight, n) of the classes that can have a partner; keys and weights
    are those of the shared shingles, the rest counts all."""
    def sign(docs, answers):
        if not len(docs):
            return pd.DataFrame(columns=["digest", "bands", "sketch", "keys", "weights", "weight", "n"])
        own = list(_texts(docs))
        keys, _ = _block_keys([k for _, k, _ in own])
        answers = answers.sort_values("part")
        df = np.concatenate([np.zeros(0, "<u4"), *(unpack_numbers(x, "<u4") for x in answers["df"])]).astype(float)
        idf = np.log((n_texts + 1) / (df + 1)) + 1
        rows = []
        for digest, k, tf in own:
            if not len(k):
                continue
            at = np.searchsorted(keys, k)
            w = tf * idf[at]
            shared = df[at] >= 2
            if shared.sum() < (threshold - 1e-9) * len(k) and w[shared].sum() < (threshold - 1e-9) * w.sum():
                continue
            rows.append((digest, icws_bands(k, w).tolist(), odd_sketches(k, idf[at]).tolist(), pack_sorted(k[shared]),
                         w[shared].astype("<f4").tobytes(), float(w.sum()), len(k)))
        return pd.DataFrame(rows, columns=["digest", "bands", "sketch", "keys", "weights", "weight", "n"])

    return (texts.groupBy("block").cogroup(frequencies.groupBy("block")).applyInPandas(
        sign, "digest binary, bands array<long>, sketch array<long>, keys binary, weights binary, weight double, n long"))


def _verified(pairs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted or plain Jaccard similarity reaches the threshold, with both."""
    side = ["keys", "weights", "weight", "n"]
    one = signed.select(F.col("digest").alias("b"), *[F.col(c).alias(f"b_{c}") for c in side])
    two = signed.select(F.col("digest").alias("a"), *[F.col(c).alias(f"a_{c}") for c in side])

    def run(batches):
        for pdf in batches:
            got = []
            for ak, aw, at, an, bk, bw, bt, bn in zip(*(pdf[f"{s}_{c}"] for s in "ab" for c in side)):
                _, i, j = np.intersect1d(unpack_sorted(ak), unpack_sorted(bk), assume_unique=True, return_indices=True)
                least = np.minimum(np.frombuffer(aw, "<f4")[i], np.frombuffer(bw, "<f4")[j]).sum(dtype=float)
                got.append((least / max(at + bt - least, 1e-12), len(i) / max(an + bn - len(i), 1)))
            sim = np.array(got).reshape(-1, 2)
            keep = (sim >= threshold - 1e-6).any(axis=1)
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "weighted": sim[:, 0], "plain": sim[:, 1]})[keep]

    return map_batches(pairs.join(one, "b").join(two, "a"), run, "a binary, b binary, weighted double, plain double")


def components(links: DataFrame) -> DataFrame:
    """(digest, root) of all ends of links: the smallest digest that links lead to.

    Each round a node takes the least root among its own and its neighbours', then the root's root."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .distinct(), "nd_links")
    roots = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("digest"), F.least("a", "m").alias("root")), "nd_roots")
    while True:
        near = (both.join(roots.select(F.col("digest").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m")))
        step = roots.join(near, roots["digest"] == near["a"]).select("digest", "root", F.least("root", "m").alias("to"))
        jump = roots.select(F.col("digest").alias("to"), F.col("root").alias("far"))
        new = materialize(step.join(jump, "to", "left").select(
            "digest", F.least("to", F.coalesce("far", "to")).alias("root"), F.col("root").alias("was")), "nd_roots")
        if new.where("root <> was").isEmpty():
            return new.select("digest", "root")
        roots = new.select("digest", "root")


def _named(live: DataFrame, roots: DataFrame | None) -> DataFrame:
    root = F.col("digest").alias("root") if roots is None else F.coalesce("root", "digest").alias("root")
    named = live if roots is None else live.join(roots, "digest", "left")
    return named.select("digest", "weight", "n", "bucket", root)


def _meetings(live: DataFrame, roots: DataFrame | None, k: int) -> DataFrame:
    """The members of the buckets that still hold different components, and which of them are centers of round k.

    Round 0 takes the least digest, so that a group of copies has one center in all its buckets; later rounds
    take others in every bucket, twice as many each round.  Small buckets end at once."""
    named = _named(live, roots)
    mixed = (named.groupBy("bucket").agg(F.min("digest").alias("first"), F.count(F.lit(1)).alias("members"),
                                         F.min("root").alias("lo"), F.max("root").alias("hi"))
             .where("lo <> hi").drop("lo", "hi"))
    center = F.col("digest") == F.col("first")
    if k:
        drawn = F.pmod(F.xxhash64("digest", "bucket", F.lit(k)), F.col("members")) < 2 ** (k - 1)
        center = center | (F.col("members") <= SMALL_BUCKET) | drawn
    return materialize(named.join(mixed, "bucket").select("digest", "weight", "n", "bucket", "root",
                                                          center.alias("center")), "nd_members")


def _rest(live: DataFrame, roots: DataFrame | None) -> DataFrame:
    """As _meetings, with all members outside a bucket's largest component as centers: of two members of different
    components one at least is a center."""
    named = _named(live, roots)
    largest = (named.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("members"))
               .groupBy("bucket").agg(F.max(F.struct("members", "root"))["root"].alias("largest"),
                                      F.count(F.lit(1)).alias("roots"))
               .where("roots > 1").drop("roots"))
    return materialize(named.join(largest, "bucket").select("digest", "weight", "n", "bucket", "root",
                                                            (F.col("root") != F.col("largest")).alias("center")), "nd_members")


def _candidates(member: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """(a, b): centers with the members of other components, unless sizes or sketches rule out the threshold."""
    member = member.join(signed.select("digest", "sketch"), "digest")
    center = member.where("center").select(
        "bucket", *[F.col(c).alias(f"c_{c}") for c in ("digest", "root", "weight", "n", "sketch")])
    return (member.join(center, "bucket")
            .where((F.col("root") != F.col("c_root")) & (~F.col("center") | (F.col("c_digest") < F.col("digest")))
                   & within_reach(threshold))
            .select(F.least("digest", "c_digest").alias("a"), F.greatest("digest", "c_digest").alias("b")).distinct())


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id",
                    block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(key, class_id, n_copies) of every row, and the verified links between texts.

    class_id is the smallest id in the row's component, n_copies the number of rows with the same text."""
    rows = docs.select(F.col(key), F.md5(text_of().cast("binary")).alias("_d"), text_of().alias("text")).select(
        key, F.unhex("_d").alias("digest"), "text")
    ids = materialize(rows.select(key, "digest"), "nd_ids")
    classes = materialize(ids.groupBy("digest").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n_copies")), "nd_classes")
    blocks = block_count(docs, block_bytes=block_bytes)
    texts = _first_texts(rows, blocks)
    signed = materialize(signatures(texts, document_frequencies(texts, min(max(blocks, 2), MAX_PARTS)), classes.count(),
                                    threshold), "nd_signed")
    live = materialize(signed.select("digest", "weight", "n", F.explode("bands").alias("bucket")), "nd_buckets")
    links = signed.sparkSession.createDataFrame([], "a binary, b binary, weighted double, plain double")
    tried, roots = None, None
    for k in range(CENTER_ROUNDS + 1):
        member = _meetings(live, roots, k) if k < CENTER_ROUNDS else _rest(live, roots)
        if member.isEmpty():
            break
        live = member.where(~F.col("center")).select("digest", "weight", "n", "bucket")
        pairs = _candidates(member, signed, threshold)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "nd_pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = materialize(_verified(pairs, signed, threshold), "nd_found")
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = components(links)
    if roots is None:
        return (ids.join(classes, "digest").select(key, F.col("least").alias("class_id"), "n_copies"), links)
    rooted = classes.join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    named = rooted.join(least, "root").select("digest", "class_id", "n_copies")
    return ids.join(named, "digest").select(key, "class_id", "n_copies"), links


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` of which one document of each group stays (the one with the smallest id).

    Rows without an id can't be named and stay; of repeated rows with one id one stays."""
    classes, _ = near_duplicates(docs, threshold)
    keep = classes.where("doc_id = class_id").select("doc_id").distinct()
    named = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))
