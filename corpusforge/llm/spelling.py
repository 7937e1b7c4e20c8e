"""Spelling variants by a variable-length gram index: which words differ by exactly one inserted, deleted or replaced code point.

1. Gram dictionary: grams of 2 and 3 code points are counted over all words; those in more than ``FREQUENT`` places are extended
   by a code point, up to ``LONGEST``; the others are kept as they are (nothing longer is held for them).
2. Decomposition: at each place of the padded word the gram is the longest that the dictionary allows; a gram inside an earlier
   one is left out.
3. Affected-gram bound: for every possible edit of the word, count the grams that hold the place or that a gram changed by the
   edit could swallow; the maximum is the word's bound ``a``.  With ``g`` grams, a near word shares ``g - a`` of them or more, at
   equal places from the left (before the edit) or from the right (after it).  ``LONGEST - 1`` pads a side make ``g - a`` at least 1.
4. List merging: so two near words meet in the list of one of the ``a + 1`` rarest grams of both (same order of grams for all
   words).  Lists are keyed by gram, side and place, dealt into buckets, sorted by length, and merged with numpy: length, parity
   of code points, and at last common prefix and suffix lengths.
5. Lists of over ``HOT`` words are split into parts; every two parts meet in a cell of their own, in different tasks.

The frequent grams (2 or 3 of 222 code points at most, in fact those over the threshold) and the ``RANKS`` counters that order
grams are the only broadcasts; the first is bounded by the alphabet, the second is fixed.

Defined cases: a null text has no words; a null id counts as an empty one; texts and words of any length take part; a table
without words gives no rows; ties in counts go to the smaller word in code-point order; repeated rows count each time.  Other
columns are not read.  Words to compare have 2 code points or more, all of U+0003 to U+00FF; others are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .blocks import mix
from .common import ascii_lower, map_batches, ship_package, text_of

#: fixed values of the contract: what a run is, when a code point of it is dropped, which words count
RUN = "[A-Za-zÀ-ÿ]+"
DROP_ONE_IN, LEAST_LENGTH, LEAST_COUNT = 97, 5, 3

SHORTEST, LONGEST = 2, 4
PAD = LONGEST - 1
FRONT, BACK = 1, 2
#: a gram in more places than this is extended
FREQUENT = 128
#: counters that order grams by how common they are
RANKS = 1 << 17
#: words of one list that are compared in one place; postings of one bucket; code points laid out at once
HOT, BUCKET, CELLS = 4096, 100_000, 1 << 20
#: words up to this length are compared as rows of a matrix, longer ones singly
WIDE = 48


# ---- words -----------------------------------------------------------------------------------------------------

def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the distinct words that count, after the contract's deletions."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(ascii_lower(text_of(text_col)), F.lit(f"({RUN})"))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    rest = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    words = runs.select(F.when(h % DROP_ONE_IN == 0, rest).otherwise(F.col("run")).alias("word"))
    return (words.where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= LEAST_COUNT))


# ---- variable-length grams -----------------------------------------------------------------------------------------

def layouts(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Padded words as rows of code points, in groups of like length: (their places in ``words``, codes, padded lengths)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * (int(size[order[hi]]) + 2 * PAD) <= CELLS:
            hi += 1
        pick = order[lo:hi]
        width = int(size[pick[-1]])
        flat = np.frombuffer(b"".join(words[i].encode("latin-1").ljust(width, b"\0") for i in pick), np.uint8).reshape(len(pick), width)
        codes = np.zeros((len(pick), width + 2 * PAD), np.uint32)
        codes[:, :PAD] = FRONT
        codes[:, PAD:PAD + width] = flat
        full = size[pick] + 2 * PAD
        at = np.arange(codes.shape[1])
        codes[(at >= (full - PAD)[:, None]) & (at < full[:, None])] = BACK
        yield pick, codes, full
        lo = hi


def gram_codes(codes: np.ndarray, q: int) -> np.ndarray:
    """The gram of ``q`` code points at every place as one number (zero bytes for what is shorter or past the end)."""
    out = np.zeros(codes.shape, np.uint32)
    for k in range(q):
        part = np.zeros(codes.shape, np.uint32)
        part[:, :codes.shape[1] - k] = codes[:, k:]
        out |= part << np.uint32(8 * (3 - k))
    return out


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(values.shape, bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def decompose(codes: np.ndarray, full: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Length of the gram kept at every place of every word (0: none)."""
    n, width = codes.shape
    q = np.full((n, width), SHORTEST, np.int64)
    longer = np.ones((n, width), bool)
    place = np.arange(width)
    for k in range(SHORTEST, LONGEST):
        longer &= member(gram_codes(codes, k), frequent) & (place + k < full[:, None])
        q += longer
    q[place + SHORTEST > full[:, None]] = 0
    end = np.zeros(n, np.int64)
    for p in range(width):
        stop = np.where(q[:, p] > 0, p + q[:, p], 0)
        q[stop <= end, p] = 0
        end = np.maximum(end, stop)
    return q


def affected(q: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Per word the most grams that one edit can touch.

    Replacing or deleting the code point at ``i`` touches grams that hold it, and grams behind it that end by ``i + LONGEST``: a gram
    starting at ``i`` or before may now swallow them.  Inserting before ``i`` touches grams on both sides of the gap, and those
    behind it that end by ``i + LONGEST - 1``.
    """
    n, width = q.shape
    wide = np.zeros((n, width + 2 * LONGEST), np.int64)
    wide[:, LONGEST:LONGEST + width] = q
    at = lambda d: wide[:, LONGEST + d:LONGEST + d + width]
    change, insert = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
    for d in range(1 - LONGEST, LONGEST):
        g = at(d)
        change += g > -d if d <= 0 else (g > 0) & (g + d <= LONGEST)
        insert += g > -d if d < 0 else (g > 0) & (g + d <= LONGEST - 1)
    place, inside = np.arange(width), full[:, None] - PAD
    change[(place < PAD) | (place >= inside)] = 0
    insert[(place < PAD) | (place > inside)] = 0
    return np.maximum(change.max(axis=1), insert.max(axis=1))


def kept_grams(codes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The number of the gram kept at every place (0 where none is)."""
    out = np.zeros(codes.shape, np.uint32)
    for k in range(SHORTEST, LONGEST + 1):
        out = np.where(q == k, gram_codes(codes, k), out)
    return out


def rank_slot(grams: np.ndarray) -> np.ndarray:
    return (mix(grams.astype(np.uint64)) % np.uint64(RANKS)).astype(np.int64)


def prefix_keys(codes: np.ndarray, full: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word's place, list key) of the ``a + 1`` rarest grams of each word and all equal to the last of them, left and right."""
    q = decompose(codes, full, frequent)
    a = affected(q, full)
    word, p = np.nonzero(q)
    grams, size = kept_grams(codes, q)[word, p], q[word, p]
    order = np.lexsort((grams, ranks[rank_slot(grams)], word))
    word, p, grams, size = word[order], p[order], grams[order], size[order]
    first = np.searchsorted(word, np.arange(len(full)))
    count = np.bincount(word, minlength=len(full))
    last = first + np.minimum(a, count - 1)                    # place of the last gram that is needed
    need = (np.arange(len(word)) <= last[word]) | (grams == grams[last[word]])
    word, p, grams, size = word[need], p[need], grams[need], size[need]
    left = (grams.astype(np.uint64) << np.uint64(32)) | p.astype(np.uint64)
    right = (grams.astype(np.uint64) << np.uint64(32)) | np.uint64(1 << 31) | (full[word] - p - size).astype(np.uint64)
    return np.concatenate([word, word]), np.concatenate([left, right]).view(np.int64)


# ---- index -----------------------------------------------------------------------------------------------------------

def _count_short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often grams of 2 and 3 code points occur in a partition's words."""
    total = pd.Series(dtype="int64")
    for batch in batches:
        for _, codes, full in layouts(batch["word"].tolist()):
            place = np.arange(codes.shape[1])
            for k in range(SHORTEST, LONGEST):
                g, c = np.unique(gram_codes(codes, k)[place + k <= full[:, None]], return_counts=True)
                total = total.add(pd.Series(c, index=g.astype("int64")), fill_value=0)
    yield pd.DataFrame({"gram": total.index.astype("int64"), "c": total.to_numpy("int64")})


def _count_kept(batches: Iterator[pd.DataFrame], frequent) -> Iterator[pd.DataFrame]:
    total = np.zeros(RANKS, np.int64)
    for batch in batches:
        for _, codes, full in layouts(batch["word"].tolist()):
            q = decompose(codes, full, frequent.value)
            total += np.bincount(rank_slot(kept_grams(codes, q)[q > 0]), minlength=RANKS)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"slot": at, "c": total[at]})


def _post(batches: Iterator[pd.DataFrame], frequent, ranks) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words, n = batch["word"].tolist(), batch["n"].to_numpy()
        for pick, codes, full in layouts(words):
            at, key = prefix_keys(codes, full, frequent.value, ranks.value)
            own = pick[at]
            yield pd.DataFrame({"key": key, "word": [words[i] for i in own], "n": n[own]})


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def near_in_lists(run: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of near words in the same run (``run``: the list each posting belongs to); a pair may come more than once."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.lexsort((size, run))
    run, size = run[order], size[order]
    raw = [words[i].encode("latin-1") for i in order]
    width = min(int(size.max(initial=1)), WIDE)
    left = np.array(raw, f"S{width}").view(np.uint8).reshape(-1, width)
    right = np.array([w[::-1] for w in raw], f"S{width}").view(np.uint8).reshape(-1, width)
    # numpy cuts longer words to the width: these are compared whole, one by one
    marks = np.where(left > 0, np.uint64(1) << (left & np.uint8(63)).astype(np.uint64), np.uint64(0))
    parity = np.bitwise_xor.reduce(marks, axis=1)
    parity[size > WIDE] = 0
    found_i, found_j = [], []
    i = np.arange(len(run))
    for d in range(1, len(run)):
        i = i[i + d < len(run)]
        j = i + d
        i = i[(run[i] == run[j]) & (size[j] - size[i] <= 1)]
        if not len(i):
            break
        j = i + d
        long = size[j] > WIDE
        like = i[(np.bitwise_count(parity[i] ^ parity[j]) <= 2) | long]
        found_i.append(like)
        found_j.append(like + d)
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    ok = np.zeros(len(i), bool)
    for lo in range(0, len(i), 1 << 18):
        a, b = i[lo:lo + (1 << 18)], j[lo:lo + (1 << 18)]
        front, back = left[a] != left[b], right[a] != right[b]
        lcp = np.where(front.any(axis=1), front.argmax(axis=1), size[a])
        lcs = np.where(back.any(axis=1), back.argmax(axis=1), size[a])
        alike = front.sum(axis=1) == 1
        ok[lo:lo + (1 << 18)] = np.where(size[a] == size[b], alike, lcp + lcs >= size[a])
    for k in np.flatnonzero(size[j] > WIDE):
        ok[k] = one_edit(words[order[i[k]]], words[order[j[k]]])
    return order[i[ok]], order[j[ok]]


def _near(bucket: pd.DataFrame) -> pd.DataFrame:
    words, n = bucket["word"].tolist(), bucket["n"].to_numpy()
    run = bucket.groupby(["key", "cell"], sort=False).ngroup().to_numpy()
    i, j = near_in_lists(run, words)
    i, j = np.concatenate([i, j]), np.concatenate([j, i])
    out = pd.DataFrame({"word": [words[k] for k in i], "near": [words[k] for k in j], "near_n": n[j]})
    return out.drop_duplicates(["word", "near"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n), once for each ordered pair of near words of ``words`` (word, n; distinct words)."""
    spark = words.sparkSession
    if words.where((F.char_length("word") < 2) | F.col("word").rlike("[^\u0003-ÿ]")).limit(1).count():
        raise ValueError("words must have two or more code points, all of U+0003 to U+00FF")
    ship_package(spark)
    sc = spark.sparkContext
    short = map_batches(words.select("word"), _count_short, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    frequent = sc.broadcast(np.sort(short.where(F.col("c") > FREQUENT).select("gram").toPandas()["gram"].to_numpy("uint32")))
    kept = map_batches(words.select("word"), lambda b: _count_kept(b, frequent), "slot long, c long")
    counts = kept.groupBy("slot").agg(F.sum("c").alias("c")).toPandas()
    table = np.zeros(RANKS, np.int64)
    table[counts["slot"].to_numpy("int64")] = counts["c"].to_numpy("int64")
    ranks = sc.broadcast(table)
    posted = materialize(map_batches(words, lambda b: _post(b, frequent, ranks), "key long, word string, n long"), "gram_postings")

    hot = posted.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT)
    parts = hot.select("key", F.ceil(F.col("c") / HOT).cast("int").alias("parts"))
    split = posted.join(parts, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    cells = (split.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .withColumn("cell", F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other")))
    buckets = max(1, -(-posted.count() // BUCKET))
    dealt = cells.select("key", "cell", "word", "n", F.pmod(F.xxhash64("key", "cell"), F.lit(buckets)).cast("int").alias("bucket"))
    pairs = dealt.groupBy("bucket").applyInPandas(_near, "word string, near string, near_n long")
    return pairs.repartition("word").dropDuplicates(["word", "near"])


def variants(words: DataFrame) -> DataFrame:
    """Per word (word, n): ``form`` (its near word of largest n, if that is 2n or more), ``root`` (the end of its forms), ``n``,
    ``n_near`` and ``form_n``."""
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("word")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    fits = -F.col("best.minus") >= 2 * F.col("n")
    told = materialize(words.join(near, "word", "left").select(
        "word", F.when(fits, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, -F.col("best.minus")).alias("form_n")), "word_forms")
    # every step at least doubles n, so chains are short, and each round doubles the reach
    ends = told.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = materialize(ends.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                F.col("further").isNotNull().alias("moved")), "word_roots")
        if not ends.where("moved").limit(1).count():
            break
        ends = ends.select("word", "root")
    return (told.join(ends.select("word", "root"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """:func:`variants` of the words of ``docs``."""
    return variants(materialize(word_counts(docs), "word_counts"))
