"""Hard-negative mining by a secondary-sort shuffle.

Scores are inner products of quantised vectors.  An anchor's positives are its best rows of the same label; a negative of a positive
with score ``p`` is a row of another label with ``low * p <= 100 * score <= high * p``.

1. Rows are dealt by their id into blocks of bounded bytes, one packed row each; the anchors of a block are packed likewise.
2. Every anchor block meets every row block (a stated query set against all rows, in blocks).  First each meeting keeps its best
   ``positives`` same-label rows per anchor; from these come the anchors' positives, hence their windows.
3. In a second round each meeting keeps, per window, its best ``negatives`` rows: a row that is not among the best of its own block
   can't be among the best of all, so nothing is lost and few pairs are shuffled.
4. The scores that are left are packed into keys (anchor, descending score, kind, id) and go through
   ``repartitionAndSortWithinPartitions``.  An iterator walks the sorted keys: a positive opens its window, a negative is given to
   the open windows that it fits and that still lack rows.  It holds the windows of one anchor, never its rows.

Inner products are exact: in doubles while they stay below 2^53, in Python's integers beyond; results beyond a long are cut to its range.

Defined cases: rows without id, label or vector, or with a null or non-finite component (also after scaling) take no part; of rows
with one id the least by (label, vector) stands for all; vectors of different lengths count as if filled up with zeros, an
empty vector scores 0; equal scores are ordered by id; anchors without a positive, and positives without a fitting row (all of
negative score), give no rows; an empty table gives an empty result.  Other columns are not read, so their names don't matter.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .blocks import pack_numbers, unpack_numbers
from .common import map_batches, ship_package

#: bytes of quantised doubles that one block holds at most (about)
BLOCK_BYTES = 8 << 20
#: anchors whose scores against a block are held at once
ANCHORS_AT_ONCE = 64
#: a bound on rows of a block, however short the vectors
BLOCK_ROWS = 1 << 16

KEY = struct.Struct(">QQBQ")
TOP = 1 << 63
PACKED = "n int, dims int, kind string, ids binary, labels binary, vectors binary"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


# ---- blocks --------------------------------------------------------------------------------------------------

def _pack(ids: np.ndarray, labels: np.ndarray, m: np.ndarray) -> dict:
    """Rows as compressed arrays; components in the smallest type that holds them all."""
    top = float(np.abs(m).max(initial=0))
    kind = next((k for k, most in (("i1", 127), ("i2", 32767), ("i4", 2**31 - 1)) if top <= most), "f8")
    return {"n": len(ids), "dims": m.shape[1], "kind": kind, "ids": pack_numbers(ids), "labels": pack_numbers(labels),
            "vectors": pack_numbers(m.astype(kind))}


def _unpack(row, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    get = lambda c: getattr(row, prefix + c)
    m = unpack_numbers(get("vectors"), get("kind")).reshape(get("n"), get("dims"))
    return unpack_numbers(get("ids"), "i8"), unpack_numbers(get("labels"), "i8"), m


def _matrix(vectors) -> np.ndarray:
    """floor(256 x) of each component, x as double; short vectors are filled up with zeros."""
    sizes = np.fromiter((len(v) for v in vectors), np.int64, len(vectors))
    m = np.zeros((len(sizes), int(sizes.max(initial=0))))
    m[np.arange(m.shape[1]) < sizes[:, None]] = np.concatenate([np.asarray(v, "f8") for v in vectors]) if len(vectors) else []
    return np.floor(256 * m)


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("id")
    whole = _pack(rows["id"].to_numpy("i8"), rows["label"].to_numpy("i8"), _matrix(rows["vector"].to_numpy()))
    some = rows[rows["anchor"]]
    part = _pack(some["id"].to_numpy("i8"), some["label"].to_numpy("i8"), _matrix(some["vector"].to_numpy()))
    return pd.DataFrame([{"block": rows["block"].iloc[0]} | whole | {f"a_{k}": v for k, v in part.items()}])


def blocks(vectors: DataFrame, anchors: Column, label: Column, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """One packed row per block (its rows and its anchors), written once, and the number of blocks."""
    fits = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) * 256 < float("inf"), F.lit(False)))
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                           F.when(fits, F.col(vector_col)).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
            .where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    per_block = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, size["d"] or 1))))
    n = max(1, -(-size["n"] // per_block))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("r")).select("id", "r.*")
    dealt = one.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    ship_package(vectors.sparkSession)
    schema = f"block int, {PACKED}, " + ", ".join(f"a_{f}" for f in PACKED.split(", "))
    return materialize(dealt.groupBy("block").applyInPandas(_block, schema), "negative_blocks"), n


# ---- meetings of an anchor block and a row block ----------------------------------------------------------------

def scores(a: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: doubles where every sum is below 2^53, Python's integers elsewhere."""
    d = max(a.shape[1], m.shape[1])
    a, m = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) if x.shape[1] < d else x for x in (a, m))
    if float(np.abs(a).max(initial=0)) * float(np.abs(m).max(initial=0)) * max(1, d) < 2.0**53:
        return a.astype("f8") @ m.astype("f8").T
    whole = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape)
    return whole(a) @ whole(m).T


def best(score: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` places of ``among`` (ascending ids) with the highest scores, ties by smaller id."""
    if len(among) > k and score.dtype != object:
        least = np.partition(score[among], len(among) - k)[len(among) - k]
        among = among[score[among] >= least]
    return among[np.argsort(-score[among], kind="stable")][:k]


def _meet(batches: Iterator[pd.DataFrame], pick) -> Iterator[pd.DataFrame]:
    """Per anchor the picked rows of the block: (anchor, id, score, home block of the anchor)."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            (ids, labels, m), (a_ids, a_labels, a) = _unpack(row), _unpack(row, "a_")
            windows = _windows(row.windows, row.low, row.high) if hasattr(row, "windows") else {}
            out: list[tuple] = []
            for lo in range(0, len(a_ids), ANCHORS_AT_ONCE):
                s = scores(a[lo:lo + ANCHORS_AT_ONCE], m)
                for i, x in enumerate(s, lo):
                    for j in pick(x, ids, labels, a_ids[i], a_labels[i], windows.get(int(a_ids[i]), ())):
                        out.append((int(a_ids[i]), int(ids[j]), min(TOP - 1, max(-TOP, int(x[j]))), row.home))
            yield pd.DataFrame(out, columns=["anchor", "id", "score", "home"])


def _positives(x, ids, labels, anchor, label, _, k: int):
    return best(x, np.flatnonzero((labels == label) & (ids != anchor)), k)


def _negatives(x, ids, labels, anchor, label, windows, k: int):
    other, taken = labels != label, set()
    for lo, hi in windows:
        taken.update(best(x, np.flatnonzero(other & (x >= lo) & (x <= hi)), k).tolist())
    return sorted(taken)


def window(p: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest integer score with ``low * p <= 100 * score <= high * p``."""
    return -((-low * p) // 100), (high * p) // 100


def _windows(found, low: int, high: int) -> dict[int, set[tuple[int, int]]]:
    out: dict[int, set[tuple[int, int]]] = {}
    for r in (found if found is not None else ()):
        if (w := window(int(r["score"]), low, high))[0] <= w[1]:
            out.setdefault(int(r["anchor"]), set()).add(w)
    return out


# ---- secondary sort ---------------------------------------------------------------------------------------------

def pack_key(anchor: int, score: int, kind: int, row: int) -> bytes:
    """Bytes whose order is (anchor, descending score, kind, id)."""
    return KEY.pack(anchor + TOP, TOP - 1 - score, kind, row + TOP)


def _to_keys(rows: Iterator, kind: int) -> Iterator[tuple[bytes, None]]:
    for r in rows:
        yield pack_key(r[0], r[2], kind, r[1]), None


def emit(keys: Iterator[tuple[bytes, None]], positives: int, negatives: int, low: int, high: int) -> Iterator[tuple]:
    """Walk sorted keys; the state is the open windows of one anchor."""
    anchor, open_ = None, []
    for key, _ in keys:
        a, s, kind, row = KEY.unpack(key)
        a, s, row = a - TOP, TOP - 1 - s, row - TOP
        if a != anchor:
            anchor, open_ = a, []
        if kind == 0:
            if len(open_) < positives:
                open_.append([row, s, 0])
            continue
        for w in open_:
            if w[2] < negatives and low * w[1] <= 100 * s <= high * w[1]:
                w[2] += 1
                yield a, w[0], w[2], row, w[1], s


def mine(vectors: DataFrame, anchors: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """One row per anchor, positive and fitting negative (``rank`` from 1), as :data:`RESULT`.

    ``anchors``: which rows are anchors; ``label``: integer label (default: the column ``label``); ``low`` and ``high``: bounds of a
    negative's score in percent of the positive's.
    """
    if not 0 <= low <= high < 100:
        raise ValueError("bounds must satisfy 0 <= low <= high < 100: a negative scores below its positive")
    spark = vectors.sparkSession
    packed, n = blocks(vectors, anchors, label if label is not None else F.col("label"), id_col, vector_col)
    rows = packed.select("block", *[f.split()[0] for f in PACKED.split(", ")])
    asked = packed.where("a_n > 0").select(F.col("block").alias("home"), *[f"a_{f.split()[0]}" for f in PACKED.split(", ")])

    def meetings(queries: DataFrame, pick) -> DataFrame:
        every = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return map_batches(every.join(rows, "block"), partial(_meet, pick=pick), "anchor long, id long, score long, home int")

    order = "row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id)"
    found = materialize(meetings(asked, partial(_positives, k=positives)).withColumn("_rank", F.expr(order))
                        .where(F.col("_rank") <= positives).drop("_rank"), "negative_positives")
    # at most `positives` windows per anchor, and the anchors of one block only
    spans = found.groupBy("home").agg(F.collect_list(F.struct("anchor", "score")).alias("windows"))
    with_spans = asked.join(spans, "home").withColumns({"low": F.lit(low), "high": F.lit(high)})
    near = meetings(with_spans, partial(_negatives, k=negatives))

    keys = (found.rdd.mapPartitions(partial(_to_keys, kind=0))
            .union(near.rdd.mapPartitions(partial(_to_keys, kind=1))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_anchor = keys.repartitionAndSortWithinPartitions(parts, partitionFunc=lambda key: zlib.crc32(key[:8]))
    return spark.createDataFrame(by_anchor.mapPartitions(partial(emit, positives=positives, negatives=negatives, low=low, high=high)),
                                 RESULT)
