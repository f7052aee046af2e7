"""Records with quoted line ends, from one large file in many tasks.

A line end inside quotes ends no record, so a reader that starts in the middle of a file must know whether
it starts inside quotes. Quotes come in pairs (a doubled one counts two), so their number up to a place
tells: each byte range counts its own, and a running sum over the ranges of a file, a row each, gives every
range its start. Then all ranges cut their records at the same time. Nothing is shuffled but the
pieces of the one record that may cross each border.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_RECORDS = "file string, start long, place long, kind string, record binary"


def _borders(lines: DataFrame) -> DataFrame:
    """``file, start, inside``: does the range start inside quotes?"""
    odd = (F.sum(F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))) % 2).cast("int")
    ranges = lines.groupBy("file", "start").agg(odd.alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int").alias("inside"))


class _Range:
    """Records of one byte range, line batch by line batch."""

    def __init__(self, file: str, start: int, inside: int):
        self.file, self.start = file, start
        self.odd = inside
        self.place = 0
        # Lines of the record that is open, and did it begin in a range before this one?
        self.open: list[pa.Array] = []
        self.older = bool(inside)

    def add(self, lines: pa.Array) -> Iterator[tuple[str, pa.Array]]:
        """Kind and texts of the records that end in ``lines``."""
        quotes = np.asarray(pc.count_substring(lines, pattern='"'), np.int64)
        after = (np.cumsum(quotes) + self.odd) % 2
        fresh = np.flatnonzero(np.concatenate([[self.odd], after[:-1]]) == 0)
        self.odd = int(after[-1])
        first = int(fresh[0]) if len(fresh) else len(lines)
        if first:
            self.open.append(lines.slice(0, first))
        if not len(fresh):
            return
        yield from self.close(True)
        # The last record may go on in the lines to come.
        ends = np.append(fresh[1:], len(lines))
        whole = len(fresh) - 1 if self.odd else len(fresh)
        if whole:
            bounds = pa.array(np.append(fresh[:whole], ends[whole - 1]), pa.int32())
            yield "whole", pc.binary_join(pa.ListArray.from_arrays(bounds, lines), b"\n")
        if self.odd:
            self.open.append(lines.slice(int(fresh[-1])))

    def close(self, ended: bool) -> Iterator[tuple[str, pa.Array]]:
        """What is open: a whole record, or the piece of one that crosses a border of the range."""
        if self.open:
            bounds = pa.array([0, sum(map(len, self.open))], pa.int32())
            kind = ("end" if ended else "middle") if self.older else ("whole" if ended else "begin")
            yield kind, pc.binary_join(pa.ListArray.from_arrays(bounds, pa.concat_arrays(self.open)), b"\n")
        self.open = []
        self.older = False


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Range | None = None

    def rows(found: Iterator[tuple[str, pa.Array]]) -> Iterator[pa.RecordBatch]:
        for kind, texts in found:
            if kind == "whole":
                texts = texts.filter(pc.invert(pc.is_in(texts, value_set=pa.array([b"", b"\r"]))))
            n = len(texts)
            places = pa.array(np.arange(now.place, now.place + n))
            now.place += n
            columns = [pa.array([now.file] * n, pa.string()), pa.array([now.start] * n, pa.int64()), places, pa.array([kind] * n, pa.string()), texts]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "start", "place", "kind", "record"])

    for batch in batches:
        start = np.asarray(batch.column("start"))
        file = batch.column("file").dictionary_encode().indices
        change = np.flatnonzero((np.diff(start) != 0) | (np.diff(np.asarray(file)) != 0)) + 1
        for s, e in zip([0, *change.tolist()], [*change.tolist(), len(start)], strict=True):
            if s == e:
                continue
            name, place = batch.column("file")[s].as_py(), int(start[s])
            if now is None or (now.file, now.start) != (name, place):
                if now is not None:
                    yield from rows(now.close(now.odd == 0))
                now = _Range(name, place, batch.column("inside")[s].as_py())
            yield from rows(now.add(batch.column("value").slice(s, e - s)))
    if now is not None:
        yield from rows(now.close(now.odd == 0))


def read_records(spark: SparkSession, path: str, skip_header: bool = True) -> DataFrame:
    """``record``: each record below ``path``, whole, its line ends as they are; the files' first ones are left out.

    Quotes stand around values that hold a quote or a line end, and are doubled inside, as in RFC 4180: a
    lone quote inside an unquoted value would mislead the count. Blank lines between records are none.
    """
    raw = spark.read.text(path, lineSep="\n")
    lines = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    known = lines.join(F.broadcast(_borders(lines)), ["file", "start"])  # a row per range
    cut = known.select(F.col("value").cast("binary").alias("value"), "file", "start", "inside").mapInArrow(_cut, _RECORDS)
    whole = cut.where("kind = 'whole'").drop("kind")
    # A piece that begins a record is followed by pieces that fill their ranges, if any, and by the one that ends it.
    pieces = cut.where("kind <> 'whole'")
    begins = F.col("kind") == "begin"
    so_far = Window.partitionBy("file").orderBy("start", begins).rowsBetween(Window.unboundedPreceding, 0)
    first = F.last(F.when(begins, F.struct("start", "place")), ignorenulls=True).over(so_far)
    chains = pieces.select("file", "start", "kind", "place").select("file", "start", "kind", first.alias("first"))
    parts = pieces.select("file", "start", "kind", "record").join(chains, ["file", "start", "kind"])
    joined = parts.groupBy("file", "first").agg(F.sort_array(F.collect_list(F.struct("start", F.col("record").cast("string").alias("r")))).alias("p"))
    crossing = joined.select("file", "first.start", "first.place", F.array_join("p.r", "\n").cast("binary").alias("record"))
    records = whole.unionByName(crossing)
    if skip_header:
        records = records.where((F.col("start") > 0) | (F.col("place") > 0))
    return records.select(F.regexp_replace(F.col("record").cast("string"), r"\r\z", "").alias("record"))
