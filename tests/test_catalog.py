import pytest

from kindred.operators import blocking
from kindred.plans import catalog


def test_encrypted_bucket_join_is_the_plain_join_of_whole_parties(spark, sf_dir, tmp_path):
    for name, where in (("customer", "c_custkey % 6 = 1"), ("nation", "true")):
        catalog.table(spark, sf_dir, name).where(where).write.parquet(str(tmp_path / f"{name}.parquet"))
    a, b = (blocking.buckets(catalog.encoded_party(spark, str(tmp_path), side)) for side in "ab")
    want = {(r["id1"], r["id2"]) for r in blocking.cross_pairs(a, b).collect()}
    rows = [tuple(r) for r in catalog.encrypted_bucket_join(spark, str(tmp_path)).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert any(int(x[1:]) > 40 for x, _ in rows)


def test_within_duplicates_compares_all_candidates(spark, sf_dir, monkeypatch):
    limits, plain = [], blocking.candidate_pairs
    monkeypatch.setattr(blocking, "candidate_pairs", lambda blocks, limit=None: limits.append(limit) or plain(blocks, limit))
    got = {(r["id1"], r["id2"]) for r in catalog.within_duplicates(spark, sf_dir).collect()}
    assert limits == [None]
    own = {r["id"]: (set(r["bits"]), r["signature"]) for r in catalog.encoded_party(spark, sf_dir, "a").collect()}
    shared = lambda x, y: any(own[x][1][i : i + 4] == own[y][1][i : i + 4] for i in range(0, 100, 4))
    alike = lambda x, y: len(own[x][0] ^ own[y][0]) <= 20 and sum(p == q for p, q in zip(own[x][1], own[y][1])) >= 32
    assert got == {(x, y) for x in own for y in own if x < y and shared(x, y) and alike(x, y)}


def test_cap_of_candidates_is_an_option(spark, sf_dir):
    blocks = blocking.buckets(catalog.encoded_party(spark, sf_dir, "a")).persist()
    pairs = [(r["id1"], r["id2"]) for r in blocking.candidate_pairs(blocks).collect()]
    assert [(r["id1"], r["id2"]) for r in blocking.candidate_pairs(blocks, 3).collect()] == sorted(pairs)[:3]


def test_encrypted_token_round_trip_takes_a_whole_party(spark, sf_dir):
    own = catalog.table(spark, sf_dir, "customer").selectExpr("concat('a', c_custkey)")
    got = [tuple(r) for r in catalog.encrypted_token_round_trip(spark, sf_dir).collect()]
    assert sorted(got) == sorted((x, True, True) for (x,) in own.collect())


def test_both_parties_hold_every_customer(spark, sf_dir):
    n = catalog.table(spark, sf_dir, "customer").count()
    a, b = ({r["id"] for r in catalog.party(spark, sf_dir, side).select("id").collect()} for side in "ab")
    assert len(a) == len(b) == n and any(x.startswith("x") for x in b)
    true = catalog.expected(spark, sf_dir).collect()
    assert {r["id1"] for r in true} <= a and {r["id2"] for r in true} <= b


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_a_large_table_is_encoded_by_tasks_of_bounded_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(catalog, "TASK_ROWS", 10)
    own = catalog.encoded_party(spark, sf_dir, "a")
    assert own.rdd.getNumPartitions() == 15 and own.count() == 150


def test_blocks_of_a_known_length_need_no_pass_before(spark, sf_dir, monkeypatch):
    own = catalog.encoded_party(spark, sf_dir, "a")
    want = sorted(map(tuple, blocking.buckets(own).collect()))
    monkeypatch.setattr(type(own), "first", lambda self: pytest.fail("a pass over the records"))
    assert sorted(map(tuple, catalog.bands(spark, sf_dir, "a").collect())) == want
    with pytest.raises(Exception, match="differ in length"):
        blocking.buckets(own, places=99).collect()
