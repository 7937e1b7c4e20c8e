"""Sequence packing: shortest-pack-first over the length histogram.

Texts are tokenized in tasks.  A document longer than a sequence is cut into full pieces and a rest.  Only the
histogram of piece lengths (at most ``size`` numbers) reaches the driver; there the lengths are placed
longest first, each into the pack with the most room left (the shortest pack), and whole groups of equal
packs are updated at once, so the work depends on the histogram and not on the number of documents.  The
result is a list of patterns with counts.  Pieces find their pattern by rank: the k-th piece of a length
takes the k-th place that the patterns have for that length.

Nulls and empty texts are the end token alone.  Repeated rows are packed as often as they come.  An empty
table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_batches, release_memory, text_of

SIZE, END_ID = 4096, 2
VOCABULARY = "word_bpe_49k.json"
CACHE_CHUNKS = 250_000
CHARS_AT_ONCE = 8 << 20


def _vocabulary_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


#: stands between words that are encoded together; words that hold it are encoded alone
SEPARATOR, WORDS_AT_ONCE = "\x01", 100
#: what counts as white space within Latin-1 besides the blank
OTHER_SPACE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"


class Encoder:
    """Token ids of whole texts, as the bytes of little-endian 32-bit numbers.  The vocabulary never joins across white space, so
    chunks between ASCII white space are encoded once and remembered (other white space stays inside a chunk).

    New chunks are encoded many at once, with a separator between whose single id no other chunk gives (checked when the
    vocabulary is loaded; else one by one), and cut apart there."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers
        self.tokenizer = Tokenizer.from_file(path)
        self.chunks: dict[str, bytes] = {"": b""}
        self.separator = self._separator()
        letters = "".join(chr(c) for c in range(33, 256) if chr(c).isalpha())
        self.lowers = self._ids(letters) == self._ids(letters.lower())
        self.bare = Tokenizer.from_file(path)         # without normalising, for words that it would not change
        self.bare.normalizer = normalizers.Sequence([])
        signs = "".join(chr(c) for c in range(33, 256) if chr(c) not in OTHER_SPACE).lower()
        self.lowers &= self.bare.encode(signs, add_special_tokens=False).ids == self._ids(signs)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _separator(self) -> int | None:
        """The separator's id if it has one of its own (not one that stands for unknown characters) and splits what it stands between."""
        own = self._ids(SEPARATOR)
        if len(own) != 1 or any(own[0] in self._ids(x) for x in ("\x02", "\uffff", "\U0010ffff", "a")):
            return None
        return own[0] if self._ids(f"ab {SEPARATOR} cd") == self._ids("ab") + own + self._ids("cd") else None

    def _is_plain(self, text: str) -> bool:
        """Whether the vocabulary's normalising would leave the text as it is: lower-case Latin-1 with no white space but blanks."""
        return self.lowers and latin(text) and text == text.lower() and not any(c in text for c in OTHER_SPACE)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, worked off in groups of about ``CHARS_AT_ONCE`` characters (a longer text alone)."""
        out: list[bytes] = []
        ends = np.cumsum([len(t) for t in texts]) // CHARS_AT_ONCE
        for group in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
            out += self._encode([texts[i] for i in group]) if len(group) else []
        return out

    def _learn(self, new: list[str]) -> None:
        """Remember the ids of chunks; a few thousand at a time, so that the tokenizer's own results stay small."""
        chunks = self.chunks
        for lo in range(0, len(new), 64 * WORDS_AT_ONCE):
            some = new[lo:lo + 64 * WORDS_AT_ONCE]
            joined = [w for w in some if SEPARATOR not in w] if self.separator is not None else []
            groups = [joined[k:k + WORDS_AT_ONCE] for k in range(0, len(joined), WORDS_AT_ONCE)]
            lines: list[tuple] = []
            for plain in (True, False):
                own = [(g, t) for g in groups if self._is_plain(t := f" {SEPARATOR} ".join(g)) == plain]
                use = self.bare if plain else self.tokenizer
                lines += zip([g for g, _ in own], use.encode_batch_fast([t for _, t in own], add_special_tokens=False))
            for group, line in lines:
                ids = np.array(line.ids, dtype="<u4")
                data, ends = ids.tobytes(), (4 * np.flatnonzero(ids == self.separator)).tolist()
                chunks.update(zip(group, [data[i:j] for i, j in zip([0, *[x + 4 for x in ends]], [*ends, len(data)])]))
            if len(joined) < len(some):
                chunks.update((w, np.array(self._ids(w), dtype="<u4").tobytes()) for w in some if w not in chunks)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.chunks) > CACHE_CHUNKS:
            self.chunks = {"": b""}
        # the vocabulary lowers letters; within Latin-1 Python does it alike, so fewer chunks differ
        lowered = [t.lower() if self.lowers and latin(t) else t for t in texts]
        lists = pc.ascii_split_whitespace(pa.array(lowered, pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self._learn([w for w in words if w not in self.chunks])
        known = list(map(self.chunks.__getitem__, words))
        # ids of the whole batch: each chunk's ids, chunk after chunk, then cut by text
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        first, n = (np.cumsum(size) - size)[at], size[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        places = np.repeat(first - ends[:-1], n) + np.arange(ends[-1])
        data = np.frombuffer(b"".join(known), "<u4")[places].tobytes()
        cuts = (4 * ends[lists.offsets.to_numpy()]).tolist()
        return [data[i:j] for i, j in zip(cuts[:-1], cuts[1:])]


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_ENCODERS: dict[str, Encoder] = {}   # per worker process; workers are reused between tasks


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (piece lengths in one sequence) and how many sequences have each."""
    by_room: dict[int, Counter] = {}     # room left -> pattern -> count

    def put(pattern: tuple[int, ...], count: int) -> None:
        room = size - sum(pattern)
        by_room.setdefault(room, Counter())[pattern] += count

    done: list[tuple[tuple[int, ...], int]] = []
    for length in sorted((x for x in histogram if histogram[x] > 0), reverse=True):
        left = histogram[length]
        while left:
            room = max(by_room, default=0)          # the shortest pack has the most room
            if room < length:
                fit = size // length                # new packs; equal lengths share a pack
                full, rest = divmod(left, fit)
                if full:
                    put((length,) * fit, full)
                if rest:
                    put((length,) * rest, 1)
                left = 0
                break
            pattern, count = next(iter(by_room[room].items()))
            fit = min(room // length, left)
            take = min(count, max(1, left // fit))
            by_room[room][pattern] -= take
            if not by_room[room][pattern]:
                del by_room[room][pattern]
                if not by_room[room]:
                    del by_room[room]
            put(pattern + (length,) * fit, take)
            left -= take * fit
        for room in [r for r in by_room if r == 0]:
            done += list(by_room.pop(room).items())
    for patterns in by_room.values():
        done += list(patterns.items())
    return sorted(done, key=lambda x: (-sum(x[0]), x[0]))


def places(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Per pattern and place: length, first rank that it takes, first sequence, offset in the sequence."""
    rows, taken, first = [], Counter(), 0
    for pattern, count in patterns:
        at = 0
        for length in pattern:
            rows.append((length, taken[length], first, at))
            taken[length] += count
            at += length
        first += count
    out = pd.DataFrame(rows, columns=["length", "rank", "sequence", "offset"], dtype="int64")
    return out.sort_values(["length", "rank"], kind="stable").reset_index(drop=True)


def pieces(docs: DataFrame, vocabulary: str | None = None, size: int = SIZE, end_id: int = END_ID,
           key: str = "doc_id", path_of: Callable[[str], str] = _vocabulary_path) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, task, nth): each document's pieces; ``nth`` counts equal lengths in a task."""
    name = vocabulary or VOCABULARY
    kind = dict(docs.dtypes)[key]

    def run(batches):
        from pyspark import TaskContext
        task, seen = TaskContext.get().partitionId(), Counter()
        path = name if os.path.sep in name else path_of(name)
        enc, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        for pdf in batches:
            rows = []
            for k, ids in zip(pdf[key], enc.encode(pdf["_text"].tolist())):
                ids += end
                for lo in range(0, len(ids), 4 * size):
                    part = ids[lo:lo + 4 * size]
                    n = len(part) // 4
                    rows.append((k, lo // 4, n, zlib.crc32(part), len(ids) // 4, task, seen[n]))
                    seen[n] += 1
            yield pd.DataFrame(rows, columns=[key, "start", "length", "ids_crc32", "doc_tokens", "task", "nth"])
        release_memory()

    return map_batches(
        docs.select(key, text_of().alias("_text")), run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long")


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = SIZE, end_id: int = END_ID,
         key: str = "doc_id") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = materialize(pieces(docs, vocabulary, size, end_id, key), "pack_pieces")
    per_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    histogram = {int(r["length"]): int(r["n"]) for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(shortest_pack_first(histogram, size))      # grows with the histogram, at most ``size`` lengths
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kind = dict(docs.dtypes)[key]
    columns = [key, "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches):
        t = shared.value
        lengths, ranks = t["length"].to_numpy(), t["rank"].to_numpy()
        low = np.searchsorted(lengths, np.arange(size + 2))
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), (pdf["_first"] + pdf["nth"]).to_numpy()
            at = np.zeros(len(pdf), dtype=int)
            for x in np.unique(length):
                own = length == x
                at[own] = low[x] + np.searchsorted(ranks[low[x]:low[x + 1]], rank[own], side="right") - 1
            out = pdf[columns].copy()
            out["sequence_id"] = t["sequence"].to_numpy()[at] + rank - ranks[at]
            out["offset"] = t["offset"].to_numpy()[at]
            yield out

    ranked = cut.join(firsts, ["length", "task"]).select(*columns, "nth", "_first")
    return map_batches(ranked, place, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                                     "sequence_id long, offset long")
