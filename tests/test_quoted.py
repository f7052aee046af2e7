"""Records that quotes stretch over lines, cut at byte ranges of any size, against the plain reader."""

import csv
import random

import pytest

from hamsieve.sources.corpus import _CSV, CSV_SCHEMA, read_mail_csv
from hamsieve.sources.quoted import read_records


def spelt(value):
    return '"' + value.replace('"', '""') + '"' if any(c in value for c in '",\r\n') else value


def folder_of(tmp_path, seed, end):
    """Files of odd mails: quoted line ends, doubled quotes, CRLF, blank lines, a mail longer than many ranges, no last line end."""
    r = random.Random(seed)
    pieces = ["a", "b c", '"', '""', ",", "\n", "\r\n", "\n\n", "é漢", "From: x", " "]
    for k in range(3):
        lines = ["file,message"]
        for i in range(r.choice([0, 1, 60])):
            message = "".join(r.choice(pieces) for _ in range(r.choice([1, 4, 30]))) or "x"
            if i == 7:
                message = "long\n" * 300 + 'with "quotes"'
            lines.append(f"{spelt(f'f{k}/{i}')},{spelt(message)}")
            if r.random() < 0.1:
                lines.append("")
        text = end.join(lines) + (end if r.random() < 0.5 else "")
        (tmp_path / f"part{k}.csv").write_bytes(text.encode())
    (tmp_path / "none.csv").write_bytes(b"")
    return str(tmp_path)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize(("seed", "size"), [(1, 64), (2, 500), (3, 1 << 27)])
def test_ranges_give_what_the_plain_reader_gives(spark, tmp_path, seed, size, end):
    path = folder_of(tmp_path, seed, end)
    want = sorted(map(tuple, spark.read.schema(CSV_SCHEMA).options(**_CSV).csv(path).collect()), key=repr)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 0)
        found = read_mail_csv(spark, path)
        got = sorted(map(tuple, found.collect()), key=repr)
        if size < 1000 and len(want) > 20:
            assert read_records(spark, path).rdd.getNumPartitions() > 8
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    if end == "\n":
        assert got == want and len(want) >= 1
    # Line ends inside quotes stay as they are, whatever ends the records.
    rows = []
    for k in range(3):
        with open(f"{path}/part{k}.csv", newline="", encoding="utf-8") as f:
            rows += [tuple(v or None for v in row) for row in list(csv.reader(f))[1:] if row]
    assert got == sorted(rows, key=repr)
