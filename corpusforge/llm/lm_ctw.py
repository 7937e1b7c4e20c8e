"""Language-model scores by context-tree weighting over bytes.

A text is its UTF-8 bytes (A-Z lowered) and an end symbol; each byte is eight binary decisions along a binary
tree.  For every decision and every context of 0 to ``DEPTH`` preceding bytes a Krichevsky-Trofimov estimator counts the
corpus; context-tree weighting mixes the estimators of all depths: the weight of stopping at a node is its KT
block probability against the product of its children's weighted ones.  The tree is learned from the training
documents and then scores every text: the score is the log10 probability of the text, ``bits_per_byte`` its code
length per byte.

How it is spread: a decision's counts follow from the counts of (context, byte) grams.  Documents are dealt into
blocks; each block sends its distinct grams with their training counts, cut into parts by the two latest
context bytes, so a part holds whole subtrees of the context tree (see blocks.py).  Parts first report the
sums that the nodes of depth 0 and 1 need (at most 256 * 255 nodes, a fixed bound), and then answer each block's list
with the code length of each gram.  Word counts of the unigram base go the same way.

Nulls are empty texts: they have the end symbol only.  Repeated rows are learned as often as they come and
score alike.  Without training rows every estimator is at one half.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .blocks import mix, pack_bytes, pack_numbers, pack_sorted, unpack_bytes, unpack_numbers, unpack_sorted
from .common import block_count, map_batches, ship_package, text_of

DEPTH = 5                   # context bytes; a gram is DEPTH + 1 bytes
END = 0xFF                  # never a byte of UTF-8: end symbol, and the context before the text
END_WORD = b" "             # the end as a token of the word base; words have no white space
BLOCK_BYTES = 16 << 20
AT_ONCE = 2 << 20           # grams sorted at a time within a block
MAX_PARTS = 2048
LN2 = float(np.log(2.0))


def grams(data: bytes) -> np.ndarray:
    """One number per byte and the end: the contexts, latest byte first, then the byte itself lowest."""
    b = np.frombuffer(bytes([END]) * DEPTH + data + bytes([END]), np.uint8).astype(np.uint64)
    n = len(data) + 1
    code = b[DEPTH:DEPTH + n].copy()
    for k in range(1, DEPTH + 1):
        code |= b[DEPTH - k:DEPTH - k + n] << np.uint64(8 * (DEPTH + 1 - k))
    return code


def part_of(codes: np.ndarray, parts: int) -> np.ndarray:
    """By the two latest context bytes."""
    return (mix(codes >> np.uint64(8 * (DEPTH - 1))) % np.uint64(parts)).astype(np.int64)


def word_part(words: list[bytes], parts: int) -> np.ndarray:
    import zlib
    return np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))


_LG = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 20000) - 0.5))))       # ln G(n + 1/2) - ln G(1/2)
_LF = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 40000.0)))))           # ln n!


def _ln_half(n: np.ndarray) -> np.ndarray:
    x = np.maximum(n, 1.0) + 0.5
    far = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x ** 3) - 0.5 * np.log(np.pi)
    return np.where(n < len(_LG), _LG[np.minimum(n, len(_LG) - 1).astype(int)], far)


def _ln_factorial(n: np.ndarray) -> np.ndarray:
    x = np.maximum(n, 1.0) + 1
    far = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x ** 3)
    return np.where(n < len(_LF), _LF[np.minimum(n, len(_LF) - 1).astype(int)], far)


def ln_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return _ln_half(n0) + _ln_half(n1) - _ln_factorial(n0 + n1)


class Level:
    """The decisions of one depth: sorted keys (context << 8 | path of bits so far) and their counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int):
        context = codes >> np.uint64(8 * (DEPTH - depth) + 8)
        byte = codes & np.uint64(255)
        keys, bits = [], []
        for j in range(8):
            keys.append((context << np.uint64(8)) | np.uint64(1 << j) | (byte >> np.uint64(8 - j)))
            bits.append((byte >> np.uint64(7 - j)) & np.uint64(1))
        self.keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.tile(counts.astype(float), 8)
        ones = np.concatenate(bits).astype(bool)
        self.n1 = np.bincount(at[ones], n[ones], len(self.keys))
        self.n0 = np.bincount(at[~ones], n[~ones], len(self.keys))
        self.at, self.bit = at.reshape(8, -1), ones.reshape(8, -1)
        self.kt = ln_kt(self.n0, self.n1)

    def parents(self) -> np.ndarray:
        return ((self.keys >> np.uint64(16)) << np.uint64(8)) | (self.keys & np.uint64(255))

    def weigh(self, below: Level | None) -> None:
        """The weighted probability of every node, and the weight of stopping there."""
        if below is None:
            self.weighted, self.stop = self.kt, np.ones(len(self.keys))
            return
        children = np.bincount(np.searchsorted(self.keys, below.parents()), below.weighted, len(self.keys))
        self.weighted = np.logaddexp(self.kt, children) - LN2
        self.stop = np.exp(self.kt - LN2 - self.weighted)

    def predict(self, bits: np.ndarray) -> np.ndarray:
        """KT probability of each gram's bit, given all counts (rows are the eight bits)."""
        n = np.where(bits, self.n1[self.at], self.n0[self.at])
        return (n + 0.5) / (self.n0[self.at] + self.n1[self.at] + 1)


def subtrees(codes: np.ndarray, counts: np.ndarray) -> dict[int, Level]:
    """The levels DEPTH to 2 of the grams of a part, weighted from the leaves up."""
    levels, below = {}, None
    for depth in range(DEPTH, 1, -1):
        levels[depth] = Level(codes, counts, depth)
        levels[depth].weigh(below)
        below = levels[depth]
    return levels


class Top:
    """Depth 0 and 1 of the tree: stop weight and counts per decision (dense, 257 * 256 nodes)."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, children: np.ndarray):
        self.n0, self.n1 = np.zeros((2, 65536)), np.zeros((2, 65536))
        below = np.zeros(65536)
        self.n0[1][key], self.n1[1][key], below[key] = n0, n1, children
        kt = ln_kt(self.n0[1], self.n1[1])
        weighted = np.logaddexp(kt, below) - LN2
        self.stop = [np.zeros(65536), np.exp(kt - LN2 - weighted)]
        path = np.arange(65536) & 255
        for src, to in ((self.n0[1], self.n0[0]), (self.n1[1], self.n1[0])):
            to[:256] = np.bincount(path, src, 256)
        kt0 = ln_kt(self.n0[0], self.n1[0])
        product = np.zeros(65536)
        product[:256] = np.bincount(path, weighted, 256)
        self.stop[0] = np.exp(kt0 - np.logaddexp(kt0, product))

    def mix(self, p: np.ndarray, bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
        byte = codes & np.uint64(255)
        latest = (codes >> np.uint64(8 * DEPTH)).astype(np.int64)
        for depth in (1, 0):
            for j in range(8):
                at = ((1 << j) | (byte >> np.uint64(8 - j))).astype(np.int64)
                if depth:
                    at = at | (latest << 8)
                n0, n1 = self.n0[depth][at], self.n1[depth][at]
                k = (np.where(bits[j], n1, n0) + 0.5) / (n0 + n1 + 1)
                s = self.stop[depth][at]
                p[j] = s * k + (1 - s) * p[j]
        return p


def code_lengths(codes: np.ndarray, counts: np.ndarray, top: Top) -> np.ndarray:
    """Bits that each gram's byte takes in its context."""
    levels = subtrees(codes, counts)
    bits = levels[DEPTH].bit
    p = levels[DEPTH].predict(bits)
    for depth in range(DEPTH - 1, 1, -1):
        s = levels[depth].stop[levels[depth].at]
        p = s * levels[depth].predict(bits) + (1 - s) * p
    return -np.log2(top.mix(p, bits, codes)).sum(axis=0)


def _sum_counts(lists: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate(lists), return_inverse=True)
    return codes, np.bincount(at, np.concatenate(counts), len(codes)), at


def _extract(pdf: pd.DataFrame, parts: int) -> pd.DataFrame:
    """A block's distinct grams and words with their training counts, one row per part."""
    codes, counts = block_grams(pdf)
    words: dict[bytes, int] = {}
    for text, train in zip(pdf["text"], pdf["train"]):
        step = int(train)
        for w in text.encode().lower().split():
            words[w] = words.get(w, 0) + step
        words[END_WORD] = words.get(END_WORD, 0) + step
    names = sorted(words)
    gram_at, word_at = part_of(codes, parts), word_part(names, parts)
    by_gram = np.split(np.argsort(gram_at, kind="stable"), np.cumsum(np.bincount(gram_at, minlength=parts))[:-1])
    by_word = np.split(np.argsort(word_at, kind="stable"), np.cumsum(np.bincount(word_at, minlength=parts))[:-1])
    rows = []
    for p in range(parts):
        g, own = by_gram[p], [names[i] for i in by_word[p]]
        if len(g) or own:
            rows.append((int(pdf["block"].iloc[0]), p, pack_sorted(codes[g]), pack_numbers(counts[g].astype("<u8")),
                         pack_bytes(b"\n".join(own)), pack_numbers(np.array([words[w] for w in own], "<u8"))))
    return pd.DataFrame(rows, columns=["block", "part", "grams", "gram_n", "words", "word_n"])


def block_grams(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of a block's texts and their counts in its training texts."""
    lists, numbers = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for learned in (True, False):
        waiting, size = [], 0
        texts = pdf["text"][pdf["train"] == learned]
        for k, text in enumerate(texts, 1):
            waiting.append(grams(text.encode().lower()))
            size += len(waiting[-1])
            if size > AT_ONCE or k == len(texts):
                codes, n = np.unique(np.concatenate(waiting), return_counts=True)
                lists.append(codes)
                numbers.append(n if learned else np.zeros_like(n))
                waiting, size = [], 0
    codes, counts, _ = _sum_counts(lists, numbers)
    return codes, counts.astype(np.int64)


def _words(data: bytes) -> list[bytes]:
    raw = unpack_bytes(data)
    return raw.split(b"\n") if raw else []


def _report(pdf: pd.DataFrame) -> pd.DataFrame:
    """What depth 1 needs of a part: counts and the children's weighted sum per decision; and its word totals."""
    codes, counts, _ = _sum_counts([unpack_sorted(x) for x in pdf["grams"]], [unpack_numbers(x, "<u8") for x in pdf["gram_n"]])
    level = subtrees(codes, counts)[2] if len(codes) else None
    total: dict[bytes, int] = {}
    for ws, ns in zip(pdf["words"], pdf["word_n"]):
        for w, n in zip(_words(ws), unpack_numbers(ns, "<u8").tolist()):
            total[w] = total.get(w, 0) + n
    out = [pd.DataFrame({"key": [-1], "n0": [float(sum(total.values()))], "n1": [float(sum(n > 0 for n in total.values()))],
                         "w": [0.0]})]
    if level is not None:
        keys, at = np.unique(level.parents(), return_inverse=True)
        out.append(pd.DataFrame({"key": keys.astype(np.int64), "n0": np.bincount(at, level.n0), "n1": np.bincount(at, level.n1),
                                 "w": np.bincount(at, level.weighted)}))
    return pd.concat(out)


def score(docs: DataFrame, train: Column, key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: key, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte; learned where ``train`` holds."""
    spark = docs.sparkSession
    ship_package(spark)
    blocks = block_count(docs, block_bytes=block_bytes)
    parts = min(max(blocks, 2), MAX_PARTS)
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.pmod(F.xxhash64(F.col(key), F.col("text")), F.lit(blocks)).cast("int").alias("block"), F.col(key).alias("_key"),
                       F.coalesce(train, F.lit(False)).alias("train"), text_of().alias("text"))
    lists = materialize(rows.groupBy("block").applyInPandas(
        lambda pdf: _extract(pdf, parts), "block int, part int, grams binary, gram_n binary, words binary, word_n binary"),
        "ctw_lists")
    reports = (lists.groupBy("part").applyInPandas(_report, "key long, n0 double, n1 double, w double")
               .groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("w").alias("w")))
    got = {r["key"]: (r["n0"], r["n1"], r["w"]) for r in reports.collect()}      # at most 256 * 255 + 1 rows
    n_train, n_distinct, _ = got.pop(-1, (0.0, 0.0, 0.0))
    table = np.array([(k, *v) for k, v in sorted(got.items())]).reshape(-1, 4)
    top = spark.sparkContext.broadcast(Top(table[:, 0].astype(int), table[:, 1], table[:, 2], table[:, 3]))

    def answer(pdf):
        pdf = pdf.sort_values("block")
        own = [unpack_sorted(x) for x in pdf["grams"]]
        codes, counts, at = _sum_counts(own, [unpack_numbers(x, "<u8") for x in pdf["gram_n"]])
        bits = code_lengths(codes, counts, top.value).astype("<f4") if len(codes) else np.zeros(0, "<f4")
        total: dict[bytes, int] = {}
        names = [_words(x) for x in pdf["words"]]
        for ws, ns in zip(names, pdf["word_n"]):
            for w, n in zip(ws, unpack_numbers(ns, "<u8").tolist()):
                total[w] = total.get(w, 0) + n
        ends = np.cumsum([len(x) for x in own])
        return pd.DataFrame({
            "block": pdf["block"], "part": pdf["part"], "bits": [pack_numbers(x) for x in np.split(bits[at], ends[:-1])],
            "counts": [pack_numbers(np.array([total[w] for w in ws], "<u8")) for ws in names]})

    answers = lists.groupBy("part").applyInPandas(answer, "block int, part int, bits binary, counts binary")
    log_all = float(np.log10(n_train + n_distinct + 1))
    learned = int(n_train)

    def finish(pdf, ans):
        columns = [key, "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
        if not len(pdf):
            return pd.DataFrame(columns=columns)
        # each chunk's distinct grams once, with every gram's place among them; the block's list as `_extract` made it
        data = [t.encode().lower() for t in pdf["text"]]
        chunks, waiting, size = [], [], 0
        for k, d in enumerate(data, 1):
            waiting.append(grams(d))
            size += len(waiting[-1])
            if size > AT_ONCE or k == len(data):
                own, place = np.unique(np.concatenate(waiting), return_inverse=True)
                chunks.append((own, place.astype(np.int32), np.cumsum([0, *map(len, waiting[:-1])])))
                waiting, size = [], 0
        codes = np.unique(np.concatenate([own for own, _, _ in chunks]))
        at, ans = part_of(codes, parts), ans.sort_values("part")
        bits = np.zeros(len(codes))
        names = sorted({w for d in data for w in d.split()} | {END_WORD})
        word_at, count = word_part(names, parts), {}
        order, cuts = np.argsort(at, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(at, minlength=parts))))
        word_order = np.argsort(word_at, kind="stable")
        word_cuts = np.concatenate(([0], np.cumsum(np.bincount(word_at, minlength=parts))))
        for p, b, c in zip(ans["part"], ans["bits"], ans["counts"]):
            bits[order[cuts[p]:cuts[p + 1]]] = unpack_numbers(b, "<f4")
            own = [names[i] for i in word_order[word_cuts[p]:word_cuts[p + 1]]]
            count.update(zip(own, unpack_numbers(c, "<u8").tolist()))
        gain = {w: (np.log10(n + 1.0), n > 0) for w, n in count.items()}
        end = gain[END_WORD]
        lengths = np.concatenate([np.add.reduceat(bits[np.searchsorted(codes, own)][place], first) for own, place, first in chunks])
        out = []
        for k, d, length in zip(pdf["_key"], data, lengths.tolist()):
            words = [gain[w] for w in d.split()] + [end]
            out.append((k, len(words), sum(x for _, x in words), learned, sum(x for x, _ in words) - len(words) * log_all,
                        -length * np.log10(2.0), length / (len(d) + 1)))
        return pd.DataFrame(out, columns=columns)

    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        finish, f"`{key}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
                "bits_per_byte double")
