"""URL filter on a sorted digest array.

A rule list is kept as one file: the sorted 64-bit xxhash keys of the rule strings, and the strings
themselves.  Every task maps that file into memory (one copy for all workers of a machine), hashes the
candidate strings of its urls, probes the sorted keys with a vectorised binary search and compares the
stored full string, so a hash collision never decides.  The file reaches the executors through
``SparkContext.addFile``.

A rule ``host/path`` fits a url whose host is the rule's or one of its subdomains, if the url's path
starts with the rule's; the longest fitting rule wins (of equally long ones that with the longer host).
A url that no rule fits gets the method's default verdict.

Nulls and urls without ``://`` have an empty host and path and get the default.  Repeated rows are
judged alike; an empty rule list gives the default everywhere.
"""

from __future__ import annotations

import mmap
import uuid
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, map_batches, write_shared

#: a rule list beyond this size is refused: split the list and apply the parts one after another
MAX_LIST_BYTES = 2 << 30
MAGIC = b"DIGARR01"


def host_of(url: Column) -> Column:
    return F.when(url.contains("://"), ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), slash + path


def digest_array(rules: Iterable[tuple[str, str]]) -> bytes:
    """rules: (verdict, ``host/path``).  Layout: magic, n, m, keys u64[n], offsets u64[n+1], distinct lengths
    of rule paths u64[m], verdicts u8[n], strings.  Of equal rules the last one holds."""
    entries: dict[str, int] = {}
    for verdict, rule in rules:
        host, rest = split_rule(rule)
        entries[host + rest] = 1 if verdict == "block" else 0
    keyed = sorted((xxhash.xxh64_intdigest(r.encode()), r.encode(), v) for r, v in entries.items())
    lengths = sorted({len(split_rule(r)[1]) for r in entries})
    offsets = np.cumsum([0] + [len(r) for _, r, _ in keyed]).astype(np.uint64)
    data = b"".join([
        MAGIC, np.array([len(keyed), len(lengths)], dtype=np.uint64).tobytes(),
        np.array([k for k, _, _ in keyed], dtype=np.uint64).tobytes(), offsets.tobytes(),
        np.array(lengths, dtype=np.uint64).tobytes(), np.array([v for _, _, v in keyed], dtype=np.uint8).tobytes(),
        *(r for _, r, _ in keyed)])
    if len(data) > MAX_LIST_BYTES:
        raise ValueError("the rule list is larger than MAX_LIST_BYTES; apply it in parts")
    return data


class DigestArray:
    """A digest array file, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:8] != MAGIC:
            raise ValueError("not a digest array")
        n, m = (int(x) for x in np.frombuffer(self.map, np.uint64, 2, 8))
        at = 24
        self.keys = np.frombuffer(self.map, np.uint64, n, at)
        self.offsets = np.frombuffer(self.map, np.uint64, n + 1, at := at + 8 * n)
        self.lengths = np.frombuffer(self.map, np.uint64, m, at := at + 8 * (n + 1)).astype(int).tolist()
        self.verdicts = np.frombuffer(self.map, np.uint8, n, at := at + 8 * m)
        self.strings = at + n

    def probe(self, digests: np.ndarray, strings: list[bytes]) -> np.ndarray:
        """Index of the entry equal to each string, or -1."""
        found = np.full(len(digests), -1)
        if not len(self.keys) or not len(digests):
            return found
        at = np.searchsorted(self.keys, digests)
        same = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests)
        for i in np.flatnonzero(same).tolist():
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == digests[i]:   # entries that share a digest
                lo, hi = self.strings + int(self.offsets[k]), self.strings + int(self.offsets[k + 1])
                if self.map[lo:hi] == strings[i]:
                    found[i] = k
                    break
                k += 1
        return found

    def string(self, k: int) -> str:
        return self.map[self.strings + int(self.offsets[k]):self.strings + int(self.offsets[k + 1])].decode()

    def longest(self, hosts: list[str], paths: list[str]) -> list[tuple[str, int] | None]:
        """Per url the longest rule that fits, and its verdict."""
        owner: list[int] = []
        rank: list[tuple[int, int]] = []
        strings: list[bytes] = []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            ends = [host]
            dot = host.find(".")
            while dot >= 0:
                ends.append(host[dot + 1:])
                dot = host.find(".", dot + 1)
            heads = [path[:n] for n in self.lengths if n <= len(path)]
            for e in ends:
                for h in heads:
                    owner.append(i)
                    rank.append((len(e) + len(h), len(e)))
                    strings.append((e + h).encode("utf-8", "surrogatepass"))
        digests = np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), np.uint64, len(strings))
        best: list[tuple | None] = [None] * len(hosts)
        entry = self.probe(digests, strings)
        for j in np.flatnonzero(entry >= 0).tolist():
            i = owner[j]
            if best[i] is None or rank[j] > best[i][0]:
                best[i] = (rank[j], int(entry[j]))
        return [None if b is None else (self.string(b[1]), int(self.verdicts[b[1]])) for b in best]


def ship_rules(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> str:
    """Write the array into the shared folder and hand it to every executor; returns the file's name."""
    uri = write_shared(spark, f"digests-{uuid.uuid4().hex[:12]}.bin", digest_array(rules))
    spark.sparkContext.addFile(uri)
    return uri.rpartition("/")[2]


def judge(pages: DataFrame, rules: list[tuple[str, str]], keep: tuple[str, ...] = ("page_id",),
          url_col: str = "url", default: str = "allow") -> DataFrame:
    """Columns ``keep`` and host, path, rule (null if none fits), verdict.  rules: (verdict, ``host/path``)."""
    name = ship_rules(pages.sparkSession, rules)
    fields = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in keep) + ", host string, path string, rule string, verdict string"

    def run(batches):
        array = DigestArray(SparkFiles.get(name))
        for pdf in batches:
            found = array.longest(pdf["_host"].tolist(), pdf["_path"].tolist())
            yield pd.DataFrame({c: pdf[c] for c in keep} | {
                "host": pdf["_host"], "path": pdf["_path"], "rule": [f and f[0] for f in found],
                "verdict": [default if f is None else ("block" if f[1] else "allow") for f in found]})

    url = F.coalesce(F.col(url_col), F.lit(""))
    return map_batches(pages.select(*keep, host_of(url).alias("_host"), path_of(url).alias("_path")), run, schema)
