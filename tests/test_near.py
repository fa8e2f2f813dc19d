"""The link of filters as machine words against the nested loop, with frequent keys in tiles and signatures of different lengths."""

import random

import pytest

from kindred.operators import match, near
from kindred.plans.profiles import Thresholds


def party(spark, seed, n, prefix):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        m, k = r.choice([(64, 3), (130, 3)])
        bits = sorted({*r.sample(range(8), 3), *r.sample(range(m), r.randrange(0, 8))})
        rows.append((f"{prefix}{i}", bits, [r.choice([1, 2, 5 << 33]) for _ in range(r.choice([4, 4, 4, 2]))], m, k))
    return rows, spark.createDataFrame(rows, "id string, bits array<int>, signature array<long>, m int, k int").repartition(3)


@pytest.mark.parametrize("t, tau", [(4, 0.5), (9, 0.25), (9, 0.0)])
def test_words_find_what_the_nested_loop_finds_and_each_pair_once(spark, monkeypatch, t, tau):
    seen = []
    met = near.met
    monkeypatch.setattr(near, "met", lambda *a: seen.append(1) or met(*a))
    monkeypatch.setattr(near, "HOT", 16)
    (rows_a, a), (rows_b, b) = party(spark, 1, 60, "a"), party(spark, 2, 50, "b")
    want = []
    for x in rows_a:
        for y in rows_b:
            d = len(set(x[1]) ^ set(y[1]))
            j = sum(p == q for p, q in zip(x[2], y[2], strict=True)) / len(x[2]) if len(x[2]) == len(y[2]) else 0.0
            if x[3:] == y[3:] and d <= t and j >= tau and (tau <= 0 or set(x[1]) & set(y[1])):
                want.append((x[0], y[0], d, j))
    got = sorted((r.id1, r.id2, r.distance, r.similarity) for r in match.fuzzy_link(a, b, Thresholds(t, tau)).collect())
    assert got == sorted(want) and seen and want


def test_counts_by_classes_are_those_of_the_pairs(spark):
    from kindred.operators import evaluate

    (_, a), (_, b) = party(spark, 3, 40, "a"), party(spark, 4, 40, "b")
    again = a.unionByName(a.where("id < 'a2'")).unionByName(a.selectExpr("concat('c', id) as id", "bits", "signature", "m", "k"))
    found = match.fuzzy_classes(again, b, Thresholds(9, 0.25))
    pairs = match.expanded(*found).select("id1", "id2")
    own = pairs.orderBy("id1", "id2").limit(30)
    truth = own.unionByName(own.limit(3)).unionByName(spark.createDataFrame([("a1", "nobody"), ("b1", "a1")], "id1 string, id2 string"))
    for expected in (truth, truth.limit(0)):
        assert evaluate.evaluate_classes(*found, expected).collect() == evaluate.evaluate(pairs, expected).collect()
        assert evaluate.evaluate_classes(*found, expected, both_ways=True).collect() == evaluate.evaluate_bidirectional(pairs, expected).collect()


def test_every_shape_is_encoded_by_all_cores(spark):
    from kindred.plans import catalog

    cores = spark.sparkContext.defaultParallelism
    assert catalog.mixed_party(spark, "/root/testdata/sf0.001", "a").rdd.getNumPartitions() >= len(catalog.O.SHAPES) * cores > 4


def test_few_records_are_few_tasks(spark, monkeypatch):
    """A task in Python costs what hundreds of records do: they, not the shuffle partitions, say how many there are."""
    (_, a), (_, b) = party(spark, 5, 40, "a"), party(spark, 6, 40, "b")
    cores, seen = spark.sparkContext.defaultParallelism, []
    keyed, met, before = near.keyed, near.met, spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(near, "keyed", lambda df, *x: seen.append(df.rdd.getNumPartitions()) or keyed(df, *x))
    monkeypatch.setattr(near, "met", lambda df, *x: seen.append(df.rdd.getNumPartitions()) or met(df, *x))
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        match.fuzzy_link(a, b, Thresholds(9, 0.25))
        assert seen == [cores] * 3
        monkeypatch.setattr(match, "RECORDS", 2)
        match.fuzzy_link(a, b, Thresholds(9, 0.25))
        assert all(cores < n <= 20 for n in seen[3:5]), seen
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_stream_finds_its_peers_classes_once(spark, tmp_path, monkeypatch):
    from kindred.plans.profiles import VALIDATE
    from kindred.streaming import matching

    calls, classes = [], match.classes
    monkeypatch.setattr(match, "classes", lambda df, columns: calls.append(1) or classes(df, columns))
    rows = spark.createDataFrame([(f"s{i}", f"ann lee {i}", "1") for i in range(3)], "id string, name string, z string").repartition(3, "id")
    folder = str(tmp_path / "rows")
    for i in range(3):
        rows.where(f"id = 's{i}'").coalesce(1).write.mode("append").parquet(folder)
    peer = matching.records(rows.selectExpr("concat('p', id) as id", "name", "z"), ["name", "z"], VALIDATE)
    matching.start(matching.read_rows(spark, folder, rows.schema), peer, ["name", "z"], str(tmp_path / "out"), str(tmp_path / "cp"), VALIDATE, Thresholds(2, 0.9)).awaitTermination(180)
    got = spark.read.json(str(tmp_path / "out" / "json" / "batch=*"))
    assert {(f"s{i}", f"ps{i}") for i in range(3)} <= {(r["local_id"], r["peer_id"]) for r in got.collect()} and len(calls) == 4


def test_differences_by_classes_are_those_of_the_pairs(spark, monkeypatch):
    """The peer's pairs either way round, repeated, unknown and null, and ids that recur; pairs of members are not shuffled."""
    from kindred.operators import evaluate

    monkeypatch.setattr(match, "HELD", 2)
    (_, a), (_, b) = party(spark, 3, 40, "a"), party(spark, 4, 40, "b")
    again = a.unionByName(a.where("id < 'a2'")).unionByName(a.selectExpr("concat('c', id) as id", "bits", "signature", "m", "k"))
    found = match.fuzzy_classes(again, b, Thresholds(9, 0.25))
    pairs = match.expanded(*found).select("id1", "id2")
    own = pairs.orderBy("id1", "id2").limit(30)
    odd = spark.createDataFrame([("a1", "nobody"), ("b1", "a1"), (None, "b1"), ("a1", None), ("a1", "nobody")], "id1 string, id2 string")
    for peer in (own.unionByName(odd), own.selectExpr("id2 as id1", "id1 as id2").unionByName(own.limit(3)), own.limit(0)):
        got, want = (sorted(map(str, f.collect())) for f in (evaluate.difference_classes(*found, peer), evaluate.difference(pairs, peer)))
        assert got == want and got
