"""CSV files with line breaks in fields, read in ranges by many tasks."""

import csv
import random

import pytest

from kindred.sources import split_csv, tables

ODD = ["plain", 'with "quotes", and commas', "line\nbreak\n\nand more\n", "", "é漢\r\nx", " s ", '"', "a\n" * 200]


@pytest.fixture
def small_ranges(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "600", "spark.sql.files.openCostInBytes": "100", "spark.sql.files.minPartitionNum": "1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k in conf:
        spark.conf.unset(k)


def write(path, rows, end="\n"):
    with open(path, "w", newline="") as f:
        own = csv.writer(f, lineterminator=end)
        own.writerow(["id", "text", "x y"])
        own.writerows(rows)
    return str(path)


def drawn(seed, n=120):
    rng = random.Random(seed)
    return [[str(i), rng.choice(ODD[:-1]) if i % 41 else ODD[-1], rng.choice(["", "z", "a\nb"])] for i in range(n)]


def in_order(df):
    return [tuple(r[c] for c in df.columns if c != tables.POSITION) for r in sorted(df.collect(), key=lambda r: r[tables.POSITION])]


def one_task(spark, path):
    """A carriage return before a line feed is dropped, which that reader does only where all lines end so."""
    rows = spark.read.csv(path, header=True, mode="FAILFAST", multiLine=True, escape='"', inferSchema=False).collect()
    return [tuple(v and v.replace("\r\n", "\n") for v in r) for r in rows]


@pytest.mark.parametrize(("seed", "end"), [(1, "\n"), (2, "\r\n")])
def test_ranges_equal_the_one_task_reader(small_ranges, tmp_path, seed, end):
    path = write(tmp_path / "a.csv", drawn(seed), end)
    assert split_csv._lines(small_ranges, path).rdd.getNumPartitions() > 5
    starts = split_csv._starts(split_csv._lines(small_ranges, path))
    assert len(next(iter(starts.values()))[1]) > 1  # ranges begin inside fields, some of them hold nothing else
    assert in_order(split_csv.read(small_ranges, path, tables.POSITION)) == one_task(small_ranges, path)
    plain = write(tmp_path / "b.csv", [[a, b.replace("\r", ""), c] for a, b, c in drawn(seed)], end)
    assert sorted(in_order(tables.csv(small_ranges, plain))) == sorted(in_order(tables.csv(small_ranges, plain, whole=True)))
    assert in_order(tables.csv(small_ranges, plain, 7)) == in_order(tables.csv(small_ranges, plain, 7, whole=True))


def test_folders_headers_empty_lines_and_unclosed_quotes(small_ranges, tmp_path):
    folder = tmp_path / "both"
    folder.mkdir()
    write(folder / "1.csv", drawn(3, 30))
    write(folder / "2.csv", drawn(4, 25))
    got = in_order(split_csv.read(small_ranges, str(folder), tables.POSITION))
    assert got == one_task(small_ranges, str(folder / "1.csv")) + one_task(small_ranges, str(folder / "2.csv"))
    odd = tmp_path / "odd.csv"
    odd.write_text('id,"te\nxt"\n\n1,a\n\n2,"not closed\n' + "more\n" * 300)
    got = split_csv.read(small_ranges, str(odd), tables.POSITION)
    assert got.columns[:2] == ["id", "te\nxt"]
    rows = in_order(got)
    assert rows[0] == ("1", "a") and rows[1][0] == "2" and len(rows) == 2


def test_ragged_rows_and_empty_files_fail(small_ranges, tmp_path):
    for name, text in (("ragged.csv", "a,b\n1,2,3\n"), ("few.csv", "a,b\n1\n"), ("none.csv", "a,b\n"), ("empty.csv", "")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception):  # noqa: B017
            tables.csv(small_ranges, str(tmp_path / name)).collect()
