"""Quality rules by tokeniser fertility.

Public vocabularies measure each text: characters per token under a vocabulary with byte fallback and under a
byte-level one for many languages, the share of byte-fallback tokens, and the entropy of the tokens (bits, over the
log of their number).  How far a measure of good texts strays depends on the language and on the length, so bands
belong to a group (language if given, else the text's main script) and a length class (words up to the next power of
two).  A band reaches from the quartiles by a multiple of their distance, at least by what chance does to a text of
that length.  Classes of fewer than ``CLASS_TEXTS`` texts take the wider band of their whole group.  A text
outside a band in any measure is rejected.  The plain base rules (word count, repeated three-word windows) come first.

Words are ``[^\\x20\\x09-\\x0D]+`` and are tokenized one by one; every text is measured whole, however long.  Nulls and
empty texts have no words and fail the base rules.  Texts of equal measures (copies) count once in the quartiles and
are judged alike, a tie with a limit is inside.  A null language is a group of its own, an empty table gives no rows.
Texts that fail the base rules don't take part in the bands.  Columns of the input beyond those asked for are ignored, and
those asked for travel under names of their own, so that no name clashes inside; a column asked for that is named like
a result column is refused.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import SPACE, WORD_PATTERN, Carried, map_batches, text_of

WORD = re.compile(WORD_PATTERN)
SYMBOL = re.compile(r"[#*$%&|<>]")
FALLBACK_VOCABULARY = "piece_bpe_32k.model"
BYTE_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE_WORDS = 200_000
CHUNK_CHARS = 1 << 19
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: texts of different measures from which on a length class has bands of its own
CLASS_TEXTS = 30
#: a class's band reaches so many interquartile ranges beyond the quartiles, and at least so far; the ratios of
#: characters to tokens are means over the words, so chance moves them by the inverse root of the number of words
CLASS_REACH = 2.75
CLASS_LEAST = {"chars_per_token": 0.02, "chars_per_token_bytes": 0.02, "fallback_share": 0.05, "entropy": 0.06}
CLASS_CHANCE = {"chars_per_token": 2.0, "chars_per_token_bytes": 2.0, "fallback_share": 0.0, "entropy": 0.0}
#: the same for a whole group, whose texts differ in length
REACH = 6.0
LEAST = {"chars_per_token": 0.4, "chars_per_token_bytes": 0.4, "fallback_share": 0.05, "entropy": 0.12}
MEASURES = tuple(LEAST)
BASE_SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
               "chars_per_token double, chars_per_token_bytes double, fallback_share double, entropy double, script string")
RESULTS = tuple(x.split()[0] for x in BASE_SCHEMA.split(", "))


class PieceCounter:
    """Token ids of words under a vocabulary with byte fallback and token numbers under a byte-level one, remembered up to a bound."""

    def __init__(self, pieces: str, ranks: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        n = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) or self.model.is_unknown(i) for i in range(n)])
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bytewise = tiktoken.Encoding(os.path.basename(ranks), pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.ids: dict[str, bytes] = {}     # 32-bit ids, end to end
        self.sizes: dict[str, int] = {}

    def learn(self, words: Iterable[str]) -> None:
        if len(self.ids) > CACHE_WORDS:
            self.ids.clear()
            self.sizes.clear()
        new = [w for w in words if w not in self.ids]
        self.ids.update(zip(new, (array("i", x).tobytes() for x in self.model.encode(new, num_threads=1))))
        self.sizes.update(zip(new, map(len, map(self.bytewise.encode_ordinary, new))))


_COUNTERS: dict[tuple[str, str], PieceCounter] = {}   # per worker process


def place(vocabulary: str) -> str:
    """The path of a public vocabulary's file (a path stays as it is)."""
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers
    return public_tokenizers.path(vocabulary)


def counter(pieces: str = FALLBACK_VOCABULARY, ranks: str = BYTE_VOCABULARY) -> PieceCounter:
    if (pieces, ranks) not in _COUNTERS:
        _COUNTERS[pieces, ranks] = PieceCounter(place(pieces), place(ranks))
    return _COUNTERS[pieces, ranks]


def repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a window of three that the text holds twice or more."""
    n = len(ids) - 2
    if n < 2:
        return 0
    if distinct < 1 << 21:
        windows = (ids[:n] << 42) | (ids[1:n + 1] << 21) | ids[2:]
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    else:
        _, inverse, counts = np.unique(np.stack([ids[:n], ids[1:n + 1], ids[2:]]), axis=1, return_inverse=True,
                                       return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[k:n + k] |= twice
    return int(covered.sum())


_SCRIPTS: dict[str, str] = {}


def script_of(text: str) -> str:
    """The main script of a text's letters: the first word of most of their Unicode names."""
    if text.isascii():
        return "LATIN" if any(c.isalpha() for c in text) else "NONE"
    counts: dict[str, int] = {}
    chars, n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
    for code, k in zip(chars.tolist(), n.tolist()):
        c = chr(code)
        if c not in _SCRIPTS:
            _SCRIPTS[c] = unicodedata.name(c, "OTHER").split()[0] if c.isalpha() else ""
        if s := _SCRIPTS[c]:
            counts[s] = counts.get(s, 0) + k
    return max(sorted(counts), key=counts.get) if counts else "NONE"


def measure(text: str, words: list[str], pieces: PieceCounter) -> tuple:
    """The row of one text; its words are known to ``pieces``."""
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    base = (len(words), sum(map(len, words)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)),
            repeat_words(ids, len(index)))
    if not words:
        return base + (0.0, 0.0, 0.0, 0.0, "NONE")
    each = list(map(pieces.ids.__getitem__, index))
    times = np.bincount(ids, minlength=len(index))
    tokens = np.frombuffer(b"".join(each), np.int32)
    weight = np.repeat(times, np.fromiter(map(len, each), np.int64, len(each)) // 4).astype(float)
    n = weight.sum()
    per_byte_token = base[1] / max(1, int(times @ np.fromiter(map(pieces.sizes.__getitem__, index), np.int64, len(index))))
    if not n:
        return base + (0.0, per_byte_token, 0.0, 0.0, script_of(text))
    p = np.bincount(tokens, weights=weight)
    p = p[p > 0] / n
    entropy = float(-(p * np.log2(p)).sum() / np.log2(n + 2))
    return base + (base[1] / n, per_byte_token, float(weight[pieces.is_byte[tokens]].sum() / n), entropy, script_of(text))


def measure_all(texts: Iterable[str], pieces: PieceCounter) -> Iterator[tuple]:
    """The rows of texts; the new words of about ``CHUNK_CHARS`` characters are tokenized in one call."""
    def rows(chunk: list[str]) -> list[tuple]:
        words = [WORD.findall(t) for t in chunk]
        pieces.learn(dict.fromkeys(chain.from_iterable(words)))
        return [measure(t, w, pieces) for t, w in zip(chunk, words)]

    chunk, size = [], 0
    for t in texts:
        chunk.append(t)
        size += len(t)
        if size >= CHUNK_CHARS:
            yield from rows(chunk)
            chunk, size = [], 0
    yield from rows(chunk)


def measures(docs: DataFrame, carried: Carried, pieces: str = FALLBACK_VOCABULARY, ranks: str = BYTE_VOCABULARY) -> DataFrame:
    """The carried columns, the base counts and the fertility measures of the whole text."""

    own = carried.own

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(pieces, ranks)
        for pdf in batches:
            got = pd.DataFrame(list(measure_all(pdf["_text"], count)), columns=list(RESULTS))
            yield pd.concat([pdf[own].reset_index(drop=True), got], axis=1)

    return map_batches(docs.select(*carried.columns, text_of().alias("_text")), run, f"{carried.schema}, {BASE_SCHEMA}")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def bands(texts: DataFrame, by: list[str], reach: float, least: dict[str, float], chance: dict[str, float]) -> DataFrame:
    """Per group of ``by`` the number of texts and, as arrays in the order of MEASURES, the lower and upper limits.

    The quantile sketches are mergeable: each task sends one sketch per group."""
    low, high = [], []
    for m in MEASURES:
        q = F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.75)), 1000)
        span = F.greatest(reach * (q[1] - q[0]), F.lit(least[m]) + F.lit(chance[m]) / F.sqrt(F.min("n_words")))
        low.append(q[0] - span)
        high.append(q[1] + span)
    return texts.groupBy(*by).agg(F.count(F.lit(1)).alias("texts"), F.array(*low).alias("low"), F.array(*high).alias("high"))


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), group: str | None = "lang",
          pieces: str = FALLBACK_VOCABULARY, ranks: str = BYTE_VOCABULARY) -> DataFrame:
    """Columns ``keep``, the counts and measures, base_failed and kept.  ``group`` names the language column;
    None takes each text's main script."""
    if clash := {c.lower() for c in keep} & {*RESULTS, "base_failed", "kept"}:
        raise ValueError(f"columns named like results: {sorted(clash)}")
    names = list(keep) if group is None or group in keep else [*keep, group]
    carried = Carried(docs, names)
    by = F.col("script") if group is None else F.col(carried.own[names.index(group)])
    measured = materialize(
        measures(docs, carried, pieces, ranks).withColumn("base_failed", base_failed()).withColumn("of", by)
        .withColumn("length", F.length(F.bin("n_words"))), "fertility")
    # copies count once: texts of equal length and measures are one text for the quartiles
    texts = measured.where(~F.col("base_failed")).dropDuplicates(["of", "length", "n_words", "word_chars", *MEASURES])
    classes = bands(texts, ["of", "length"], CLASS_REACH, CLASS_LEAST, CLASS_CHANCE).where(F.col("texts") >= CLASS_TEXTS)
    groups = bands(texts, ["of"], REACH, LEAST, dict.fromkeys(MEASURES, 0.0))
    # a row per group, and one per group and length class (some 40 at most); the joins pick broadcast or shuffle by size
    judged = (measured.alias("m")
              .join(classes.alias("c"), F.col("m.of").eqNullSafe(F.col("c.of")) & (F.col("m.length") == F.col("c.length")), "left")
              .join(groups.alias("g"), F.col("m.of").eqNullSafe(F.col("g.of")), "left"))
    low, high = F.coalesce("c.low", "g.low"), F.coalesce("c.high", "g.high")
    inside = F.lit(True)
    for i, m in enumerate(MEASURES):
        inside = inside & F.col(f"m.{m}").between(low[i], high[i])
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    back = [c for c, n in zip(carried.back(), names) if n in keep]
    return judged.select(*back, *(f"m.{c}" for c in RESULTS), "base_failed", kept.alias("kept"))
