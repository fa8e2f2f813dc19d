"""Database tables in ranges of keys and in pages, with the embedded database of a local session."""

import pytest

from kindred.plans.catalog import database
from kindred.sources import embedded, tables


@pytest.fixture(scope="module")
def people(spark):
    rows = [(f"k{i * 7 % 100:03d}", f"name '{i}'" if i % 4 else None, i) for i in range(100)]
    return sorted((a, b or "", str(c)) for a, b, c in rows), database(spark, spark.createDataFrame(rows, "id string, name string, n int"), "id VARCHAR(20)")


def got(df):
    return sorted(map(tuple, df.collect()))


def test_ranges_of_keys_hold_about_as_many_rows_and_all_of_them(spark, people):
    want, (url, options) = people
    assert got(tables.jdbc(spark, url, "PEOPLE", **options)) == want
    for parts in (2, 7):
        df = tables.jdbc(spark, url, "PEOPLE", parts=parts, **options)
        sizes = [len(x) for x in df.rdd.glom().collect()]
        assert len(sizes) == parts and max(sizes) - min(sizes) <= 1 and got(df) == want
    assert tables.jdbc(spark, url, "PEOPLE", parts=1000, **options).rdd.getNumPartitions() == 100


def test_keys_that_recur_are_null_or_hold_quotes(spark):
    for keys, types in ((["it's", "it's", "it's", "z", 'a"b'], "id VARCHAR(20)"), ([None, None, 3, 3, 3, -4, 9], "id BIGINT")):
        rows = [(k, i) for i, k in enumerate(keys)]
        url, options = database(spark, spark.createDataFrame(rows, f"id {'string' if 'CHAR' in types else 'long'}, n int"), types)
        df = tables.jdbc(spark, url, "PEOPLE", parts=4, **options)
        assert got(df) == sorted(("" if k is None else str(k), str(i)) for k, i in rows) and df.rdd.getNumPartitions() > 1
    none, options = database(spark, spark.createDataFrame([], "id string, n int"), "id VARCHAR(20)")
    assert tables.jdbc(spark, none, "PEOPLE", parts=4, **options).count() == 0


def test_pages_after_a_key_are_those_by_number(spark, people):
    want, (url, options) = people
    last, seen = None, []
    while rows := tables.jdbc_after(spark, url, "PEOPLE", last, 30, **options).collect():
        assert got(tables.jdbc_page(spark, url, "PEOPLE", len(seen), 30, **options)) == sorted(map(tuple, rows))
        seen += map(tuple, rows)
        last = rows[-1][0]
    assert seen == want
    assert tables.jdbc_after(spark, url, "PEOPLE", "k050", 0, **options).count() == 0


def test_names_and_values_cannot_leave_their_place(spark, people):
    _, (url, options) = people
    with pytest.raises(Exception):  # noqa: B017
        tables.jdbc_page(spark, url, 'PEOPLE" WHERE 1 = 1 --', 0, 5, **options).collect()
    assert tables.jdbc_after(spark, url, "PEOPLE", "' OR 1 = 1 --", 5, **options).count() == 5  # compared as a key, below all others
    with pytest.raises(KeyError):
        tables.jdbc_get(spark, url, "PEOPLE", "x' OR '1' = '1", **options)


def test_an_archive_is_opened_by_processes_of_their_own(spark):
    """As on a cluster: the archive is read-only, so another process reads it while this one does."""
    texts = ["", None, "it's", 'a"b, c', " x ", "line\nbreak", "é€", "plain"]
    rows = [(i if i else None, t) for i, t in enumerate(texts)]
    url, options = embedded.archived(spark.createDataFrame(rows, "id long, name string"), "PEOPLE", "id BIGINT"), {"driver": embedded.DRIVER}
    want = sorted(("" if i is None else str(i), t or "") for i, t in rows)
    assert got(tables.jdbc(spark, url, "PEOPLE", **options)) == got(tables.jdbc(spark, url, "PEOPLE", parts=3, **options)) == want
    assert got(tables.jdbc_get(spark, url, "PEOPLE", "3", **options)) == [("3", 'a"b, c')]
    assert got(tables.jdbc_after(spark, url, "PEOPLE", 5, 2, **options)) == [("6", "é€"), ("7", "plain")]
    assert spark.read.format("jdbc").options(url=url, dbtable="PEOPLE", **options).load().where("name is null").count() == 1
    assert ";create" not in url and "memory" not in url
    none = embedded.archived(spark.createDataFrame([], "id long, name string"), "PEOPLE", "id BIGINT")
    assert tables.jdbc(spark, none, "PEOPLE", parts=3, **options).count() == 0
