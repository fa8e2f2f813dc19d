"""Pairs of members by tiles: what is written grows with members and pairs of classes, not with pairs of members."""

import hashlib

import pytest

from kindred.operators import assign, tiles
from kindred.operators.match import expanded

MEMBERS = "member string, id long, weight long"


def sides(spark):
    a = {1: ["a1", "a2", "a10"], 2: ["a3"], 3: [f"a{i}" for i in range(20, 40)]}
    b = {7: ["b1", "b2"], 8: [f"b{i}" for i in range(10, 40)], 9: ["b3"]}
    pairs = [(1, 7, 3), (1, 8, 4), (2, 9, 0), (3, 8, 1), (3, 9, 2)]
    frames = [spark.createDataFrame([(m, i, len(ms)) for i, ms in side.items() for m in ms], MEMBERS) for side in (a, b)]
    every = [(x, y, d) for i, j, d in pairs for x in a[i] for y in b[j]]
    return spark.createDataFrame(pairs, "id1 long, id2 long, distance int"), *frames, every


def greedy(every, symmetric=False):
    key = lambda x, y: int.from_bytes(hashlib.sha256("|".join(sorted((x, y)) if symmetric else (x, y)).encode()).digest()[:8], "little")
    first, second, out = set(), set(), []
    for _, x, y in sorted(((key(x, y), x, y) for x, y, _ in every), reverse=True):
        if x not in first and y not in second:
            first.add(x), second.add(y), out.append((x, y))
    return sorted(out)


@pytest.mark.parametrize("symmetric", [False, True])
def test_assignment_makes_pairs_in_tiles_and_writes_none(spark, monkeypatch, symmetric):
    pairs, a, b, every = sides(spark)
    monkeypatch.setattr(tiles, "HELD", 4)
    monkeypatch.setattr(assign, "WRITTEN", 0)
    monkeypatch.setattr(assign, "SETTLED", 0)
    made = []
    monkeypatch.setattr(assign, "expanded", lambda p, *rest: made.append(p.count()) or expanded(p, *rest))
    assert sorted(map(tuple, assign.one_to_one_classes(pairs, a, b, symmetric=symmetric, settled=0).collect())) == greedy(every, symmetric)
    assert made == [0]


def test_best_pairs_of_classes(spark):
    pairs, a, b, every = sides(spark)
    rows = spark.createDataFrame(every, "id1 string, id2 string, distance int")
    want = assign.best_of_both(rows.select("id1", "id2", assign.priority(rows.id1, rows.id2).alias("p")))
    assert sorted(map(tuple, assign.best_pairs(pairs, a, b).collect())) == sorted(map(tuple, want.collect()))


def test_members_of_large_classes_fall_into_parts(spark, monkeypatch):
    pairs, a, b, every = sides(spark)
    monkeypatch.setattr(tiles, "HELD", 4)
    monkeypatch.setattr(tiles, "PAIRS", 8)
    assert sorted(map(tuple, expanded(pairs, a, b).collect())) == sorted(every)
    own = spark.createDataFrame([(3, 3, 0), (2, 3, 1)], "id1 long, id2 long, distance int")
    got = sorted(map(tuple, expanded(own, a, a, within=True).collect()))
    large = sorted(f"a{i}" for i in range(20, 40))
    assert got == sorted([(x, y, 0) for i, x in enumerate(large) for y in large[i + 1 :]] + [(min(x, "a3"), max(x, "a3"), 1) for x in large])


def test_a_join_of_members_shuffles_no_lists(spark):
    """Of one pair of classes of 2,000 members each, 4,000,000 pairs are made, and each member goes to a few tiles."""
    n = 2000
    a, b = (spark.createDataFrame([(f"{s}{i}", 1, n) for i in range(n)], MEMBERS) for s in "ab")
    found = tiles.tiled(spark.createDataFrame([(1, 1, n, n)], "id1 long, id2 long, w1 long, w2 long"), a, b, 2)
    assert found.where("kind < 2").count() == 2 * 2 * n and found.where("kind = 2").count() == 4
    assert expanded(spark.createDataFrame([(1, 1)], "id1 long, id2 long"), a, b).distinct().count() == n * n


def test_differences_are_counted_by_classes(spark):
    """Copies of an id in one class, a pair known the other way round, and one that nobody found."""
    from kindred.operators import evaluate

    pairs, a, b, every = sides(spark)
    a = a.unionByName(spark.createDataFrame([("a3", 2, 2)], MEMBERS))
    every = [*every, ("a3", "b3", 0)]
    peer = spark.createDataFrame([("a1", "b1"), ("b3", "a3"), ("a1", "b99"), ("a1", "b1")], "id1 string, id2 string")
    rows = spark.createDataFrame(every, "id1 string, id2 string, distance int")
    got = evaluate.difference_summary_classes(pairs, a, b, peer)
    want = evaluate.difference_summary(rows, peer)
    assert got.columns == want.columns and got.collect() == want.collect()


def test_rows_of_equal_values_are_encoded_once(spark, monkeypatch):
    from kindred.operators import encode
    from kindred.operators.match import record_classes
    from kindred.plans.profiles import VALIDATE

    seen, coded = [], encode.encoded
    monkeypatch.setattr(encode, "encoded", lambda df, profile: seen.append(df.count()) or coded(df, profile))
    rows = spark.createDataFrame([(f"a{i}", "Ann" if i % 3 else "Bob", "x") for i in range(30)] + [("none", "", None), ("case", "ANN", "x")], "id string, name string, zip string")
    found, members = record_classes(rows, ["name", "zip"], VALIDATE)
    assert seen == [3]
    assert sorted(r["weight"] for r in found.collect()) == [10, 21] and members.count() == 31
    assert {r["weight"] for r in members.where("member = 'case'").collect()} == {21}
