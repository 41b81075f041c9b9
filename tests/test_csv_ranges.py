"""Quoted CSV in ranges: the same rows as the whole-file reader, wherever ranges begin."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import csv_ranges


@pytest.fixture
def range_size(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]

    def put(size: int) -> None:
        for k, v in zip(keys, (str(size), "1"), strict=True):
            spark.conf.set(k, v)

    yield put
    for k, v in zip(keys, before, strict=True):
        spark.conf.set(k, v)


def made(seed: int, end: str, n: int = 120) -> str:
    rng = random.Random(seed)

    def cell() -> str:
        return "".join(rng.choice('ab ,"\n\né😀x') for _ in range(rng.randint(0, 12))) if rng.random() < 0.4 else rng.choice(["x", "yy", "", " z ", '"', "1"])

    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    for i in range(n):
        row = [cell() or "k", cell(), cell()]
        writer.writerow([*row, "more"] if i % 37 == 1 else row[:2] if i % 41 == 5 else row)
        if i % 29 == 3:
            out.write(end)
    return out.getvalue()


def write(tmp_path, text: str, name: str = "a.csv") -> str:
    (tmp_path / name).write_text(text, newline="")
    return f"file://{tmp_path}/{name}"


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [31, 200, 1 << 20])
def test_like_whole_file_readers(spark, tmp_path, range_size, end, size):
    text = made(size, end, 60)
    path = write(tmp_path, text)
    plain = [(len(r) != 3, *(r + [""] * 3)[:3]) for r in csv.reader(io.StringIO(text, newline="")) if r]
    whole = spark.read.schema("a string, b string, c string, _bad string").options(multiLine=True, **{k: v for k, v in csv_ranges.OPTIONS.items() if k != "multiLine"}).csv(path)
    want = [tuple(r) for r in whole.select(F.expr("_bad IS NOT NULL"), *(F.coalesce(c, F.lit("")) for c in "abc")).collect()]
    if end == "\n":  # Spark takes the first line end of a file, a quoted one too, for that of all its rows
        assert plain == want
    range_size(size)
    rows = csv_ranges.records(spark, path)
    got = csv_ranges.cells(rows, ["a", "b", "c"]).orderBy("ordinal").collect()
    assert [tuple(r)[1:] for r in got] == plain and [r.ordinal for r in got] == list(range(1, len(plain) + 1))
    if size == 200:
        assert csv_ranges.lines(spark, path).rdd.getNumPartitions() > 4


def test_a_cell_over_many_ranges_and_more_ranges_than_are_broadcast(spark, tmp_path, range_size, monkeypatch):
    long = "\n".join(f'line {i} "" quoted' for i in range(40))
    path = write(tmp_path, f'h,i\n1,"{long}"\n2,x\n"3","{long}"')
    range_size(50)
    for most in (csv_ranges.MOST_RANGES, 1):
        monkeypatch.setattr(csv_ranges, "MOST_RANGES", most)
        got = csv_ranges.cells(csv_ranges.records(spark, path), ["h", "i"]).orderBy("ordinal").collect()
        assert [(r.h, r.i) for r in got] == [("h", "i"), ("1", long.replace('""', '"')), ("2", "x"), ("3", long.replace('""', '"'))]


def test_folder_in_order_of_names(spark, tmp_path, range_size):
    write(tmp_path, "h\nb1\n\"b\n2\"\n", "b.csv")
    write(tmp_path, "h\na1\n", "a.csv")
    range_size(4)
    got = csv_ranges.records(spark, f"file://{tmp_path}").orderBy("ordinal").collect()
    assert [(r.ordinal, r.heads, r.record) for r in got] == [(1, True, "h"), (2, False, "a1"), (3, True, "h"), (4, False, "b1"), (5, False, '"b\n2"')]


def test_broken_files(spark, tmp_path, range_size):
    range_size(8)
    with pytest.raises(csv_ranges.SourceError):
        csv_ranges.records(spark, write(tmp_path, 'a,b\n1,"x\n2,y\n3,z'))
    with pytest.raises(Exception, match="longer than"):
        csv_ranges.records(spark, write(tmp_path, 'a\n"' + "x\n" * 50 + '"\n'), most=20).collect()
    assert csv_ranges.records(spark, write(tmp_path, "")).count() == 0
    assert csv_ranges.records(spark, write(tmp_path, "\n\r\n\n")).count() == 0
