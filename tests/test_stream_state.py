"""Limits over replayed streams: as in one batch, with state that ends."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kindred.streaming import limits, matching

START = datetime(2024, 1, 1)


def replayed(spark, tmp_path, slices, decide):
    """(rows that the stream gave, its last progress) where each slice of rows is a micro-batch."""
    schema = "i long, ts timestamp, k string, d int"
    folder = str(tmp_path / "in")
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    name = f"q{random.randrange(1 << 40)}"
    stream = matching.read_rows(spark, folder, spark.createDataFrame([], schema).schema)
    q = decide(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect(), q.lastProgress


@pytest.fixture(scope="module")
def slices():
    rng = random.Random(2)
    times = sorted(rng.randrange(0, 600) for _ in range(150))
    rows = [(i, START + timedelta(seconds=t), f"u{rng.randrange(6)}", rng.choice([1, 1, -1])) for i, t in enumerate(times)]
    cuts = [0, 40, 90, 150]
    # Equal times stay in one slice.
    cuts = [next(j for j in range(c, len(rows) + 1) if j in (0, len(rows)) or rows[j][1] != rows[j - 1][1]) for c in cuts]
    return [rows[a:b] for a, b in zip(cuts, cuts[1:])]


def test_rate_limits_are_those_of_one_batch_and_their_state_ends(spark, tmp_path, slices):
    every = [r for rows in slices for r in rows]
    df = spark.createDataFrame(every, "i long, ts timestamp, k string, d int")
    want = {r["i"]: r["allowed"] for r in limits.rate_limited(df, "k", "ts", "i", 2, 60).collect()}
    late = [(999, START + timedelta(hours=2), "last", 1)]
    decide = lambda s: limits.rate_limited_stream(s.withWatermark("ts", "0 seconds"), "k", "ts", "i", 2, 60)
    got, progress = replayed(spark, tmp_path, [*slices, late], decide)
    assert {r["i"]: r["allowed"] for r in got} == want | {999: True} and {*want.values()} == {True, False}
    assert progress["stateOperators"][0]["numRowsTotal"] == 1  # the last key alone: its window is open


def test_without_a_watermark_keys_are_kept(spark, tmp_path, slices):
    got, progress = replayed(spark, tmp_path, slices, lambda s: limits.rate_limited_stream(s, "k", "ts", "i", 2, 60))
    assert len(got) == 150 and progress["stateOperators"][0]["numRowsTotal"] == 6


def test_connections_are_those_of_one_batch_and_closed_keys_are_forgotten(spark, tmp_path, slices):
    every = [r for rows in slices for r in rows]
    df = spark.createDataFrame(every, "i long, ts timestamp, k string, d int")
    want = {r["i"]: r["open"] for r in limits.connections(df, "k", "ts", "i", F.col("d")).collect()}
    close = [(1000 + i, START + timedelta(hours=2), f"u{i % 6}", -1) for i in range(600)]
    got, progress = replayed(spark, tmp_path, [*slices, close], lambda s: limits.connections_stream(s, "k", "ts", "i", "d"))
    assert {r["i"]: r["open"] for r in got if r["i"] < 1000} == want and max(want.values()) > 2
    assert all(r["open"] >= 0 for r in got) and progress["stateOperators"][0]["numRowsTotal"] == 0


def test_slices_of_several_files_are_one_micro_batch_each(spark, sf_dir, monkeypatch):
    from kindred.plans import catalog

    want = sorted(map(tuple, catalog.connection_count(spark, sf_dir).collect()))
    monkeypatch.setattr(catalog, "SLICE_ROWS", 100)
    read, seen = matching.read_rows, []
    monkeypatch.setattr(matching, "read_rows", lambda *a: seen.append(a[3]) or read(*a))
    assert sorted(map(tuple, catalog.connection_stream(spark, sf_dir).collect())) == want and seen == [3]
