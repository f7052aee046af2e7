"""URL rules by a sorted digest array: memory-mapped, probed by vectorised binary search.

A rule is a host and a path prefix, written ``host/path``. The array holds the 64-bit xxhash of
each rule in order, the rule's verdict and where its full string lies. A URL offers one candidate
per host suffix and rule path length; a candidate whose digest is found counts only if the stored
string equals it, so a collision never decides.

The file lies in the shared folder and is given to the executors by ``addFile``; each Python worker
maps it: the workers of an executor share the pages, and none loads the list.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hamsieve.sources.scratch import scratch_path

#: Verdict of URLs that no rule fits.
DEFAULT_VERDICT = "allow"
_RECORD = np.dtype([("digest", "<u8"), ("start", "<u8"), ("size", "<u4"), ("block", "u1")])
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def digest_file(rules: Iterable[tuple[str, str]]) -> bytes:
    """The file of ``rules`` (rule, verdict).

    Layout: number of records, bytes of strings, records by (digest, string), strings. The first of
    repeated rules counts. A rule without ``/`` gets one; hosts are lower-cased.
    """
    known: dict[str, str] = {}
    for rule, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        host, slash, path = rule.partition("/")
        known.setdefault(host.lower() + "/" + path if slash else host.lower() + "/", verdict)
    entries = sorted((xxhash.xxh64_intdigest(r), r.encode(), v == "block") for r, v in known.items())
    records = np.zeros(len(entries), _RECORD)
    at = 0
    for i, (digest, text, block) in enumerate(entries):
        records[i] = (digest, at, len(text), block)
        at += len(text)
    return np.array([len(entries), at], "<u8").tobytes() + records.tobytes() + b"".join(e[1] for e in entries)


def share_file(spark: SparkSession, body: bytes) -> str:
    """Write ``body`` to the shared folder and hand it to the executors; returns the name it has there."""
    # A name of its own for each call: Spark refuses one file name from two places.
    path = scratch_path(spark, "digests")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    try:
        out.write(bytearray(body))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


class DigestArray:
    """The mapped file. ``shapes`` (host labels, path characters) tell which candidates can exist at all."""

    def __init__(self, path: str):
        count, size = (int(v) for v in np.fromfile(path, "<u8", 2)) if os.path.getsize(path) else (0, 0)
        start = 16 + count * _RECORD.itemsize
        self.records = np.memmap(path, _RECORD, "r", 16, (count,)) if count else np.zeros(0, _RECORD)
        self.strings = np.memmap(path, "u1", "r", start, (size,)) if size else np.zeros(0, "u1")
        self.digests = self.records["digest"]
        self.shapes = sorted({self._shape(self.text(i)) for i in range(count)})

    @staticmethod
    def _shape(rule: str) -> tuple[int, int]:
        host, _, path = rule.partition("/")
        return host.count(".") + 1 if host else 0, len(path) + 1

    def text(self, i: int) -> str:
        r = self.records[i]
        return self.strings[int(r["start"]) : int(r["start"]) + int(r["size"])].tobytes().decode()

    def find(self, candidates: list[str]) -> np.ndarray:
        """The record of each candidate, -1 where there is none."""
        out = np.full(len(candidates), -1, np.int64)
        if not candidates or not len(self.digests):
            return out
        wanted = np.fromiter((xxhash.xxh64_intdigest(c) for c in candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.digests, wanted)
        near = np.minimum(at, len(self.digests) - 1)
        for i in np.flatnonzero((at < len(self.digests)) & (self.digests[near] == wanted)):
            k = int(at[i])
            # Equal digests stand together: confirm by the stored string.
            while k < len(self.digests) and self.digests[k] == wanted[i]:
                if self.text(k) == candidates[i]:
                    out[i] = k
                    break
                k += 1
        return out


def _best(array: DigestArray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """The longest fitting rule's record per URL, -1 if none."""
    best = np.full(len(hosts), -1, np.int64)
    best_size = np.full(len(hosts), -1, np.int64)
    for labels, chars in array.shapes:
        rows, candidates = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            if len(path) < chars:
                continue
            parts = host.rsplit(".", labels) if labels else [host]
            if labels and len(parts) < labels:
                continue
            suffix = ".".join(parts[-labels:]) if labels else ""
            rows.append(i)
            candidates.append(suffix + path[:chars])
        found = array.find(candidates)
        hit = found >= 0
        at = np.asarray(rows, np.int64)[hit] if rows else np.zeros(0, np.int64)
        sizes = np.fromiter((len(c) for c, h in zip(candidates, hit, strict=True) if h), np.int64, int(hit.sum()))
        longer = sizes > best_size[at]
        best[at[longer]] = found[hit][longer]
        best_size[at[longer]] = sizes[longer]
    return best


def judge_urls(df: DataFrame, rules: Iterable[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Per row of ``df``: id, ``host``, ``path``, ``rule`` (null if none fits), ``verdict``.

    A rule fits its host and all subdomains when the path starts with the rule's; the longest wins,
    and where none fits the verdict is ``default``. A null URL, or one without ``://``, has an empty
    host and path, which no rule fits. Repeated rows are judged each; an empty table gives no rows;
    further columns are ignored; URLs of any length are judged whole. No rows are shuffled.
    """
    name = share_file(df.sparkSession, digest_file(rules))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        array = DigestArray(SparkFiles.get(name))
        for rows in batches:
            best = _best(array, rows["host"].tolist(), rows["path"].tolist())
            yield rows.assign(
                rule=[array.text(k) if k >= 0 else None for k in best],
                verdict=[("block" if array.records[k]["block"] else "allow") if k >= 0 else default for k in best],
            )

    url = F.col(url_col).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    return rows.mapInPandas(judge, f"`{id_col}` long, host string, path string, rule string, verdict string")
