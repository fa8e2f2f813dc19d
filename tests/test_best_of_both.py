"""The first round of the assignment joins one row an id, not all pairs."""

from kindred.operators.assign import best_of_both


def test_best_pairs_of_both_ids(spark):
    rows = [("a1", "b1", "5"), ("a1", "b2", "7"), ("a2", "b2", "9"), ("a2", "b3", "1"), ("a3", "b3", "4"), ("a3", "b1", "3")]
    pairs = spark.createDataFrame(rows, "id1 string, id2 string, p string")
    assert sorted(map(tuple, best_of_both(pairs).collect())) == [("a2", "b2"), ("a3", "b3")]


def test_repeated_matches_are_found_once(spark, monkeypatch):
    """The link's lineage is cut once, so neither evaluation links again."""
    from kindred.plans import catalog

    seen = []
    cut = catalog.cut
    monkeypatch.setattr(catalog, "cut", lambda df: seen.append(1) or cut(df))
    monkeypatch.setattr(catalog, "_matches", lambda *_: spark.createDataFrame([("a1", "b1"), ("a2", "b2"), ("a3", "b4")], "id1 string, id2 string"))
    catalog.repeated_matches(spark, "/root/testdata/sf0.001").collect()
    assert len(seen) == 2
