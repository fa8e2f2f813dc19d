"""Encrypted files of several messages: what does not belong together fails."""

import pytest
from pyspark.sql import functions as F

from kindred.sources import frames, sinks, tables

KEY = "0f" * 32


def rows(spark, n):
    return spark.createDataFrame([(f"id{i}, \"x\"", f"b{i}", f"m\n{i}", "t") for i in range(n)], "id string, bloom_filter string, minhash string, timestamp string")


@pytest.fixture(scope="module")
def written(spark):
    own = rows(spark, 40)
    return sorted(map(tuple, own.collect())), [r[0] for r in sinks.encrypted_frames(own, KEY, most=4).collect()]


def read(spark, lines, key=KEY):
    return sorted(map(tuple, tables.framed_tokens(spark.createDataFrame([(x,) for x in lines], "value string"), key).collect()))


def test_frames_in_any_order(spark, written):
    want, lines = written
    assert len(lines) > 5 and read(spark, lines) == want == read(spark, lines[::-1])
    assert sorted(int(x.split(".")[1]) for x in lines) == list(range(len(lines)))
    with pytest.raises(Exception, match="decryption failed"):
        read(spark, lines, "1" * 64)


def test_dropped_repeated_swapped_foreign_and_changed_frames_fail(spark, written):
    _, lines = written
    other = [r[0] for r in sinks.encrypted_frames(rows(spark, 40), KEY, most=4).collect()]
    a, b = (x.split(".") for x in lines[:2])
    message = a[3][:40] + ("A" if a[3][40] != "A" else "B") + a[3][41:]
    number = a[1]
    foreign = next(x for x in other if x.split(".")[1] == number).split(".")
    fewer = [".".join([f, n, str(len(lines) - 1), m]) for f, n, _, m in (x.split(".") for x in lines) if int(n) < len(lines) - 1]
    bad = {
        "dropped": lines[1:],
        "repeated": [*lines, lines[0]],
        "in place of another": [lines[1], *lines[1:]],
        "swapped": [".".join([*a[:3], b[3]]), ".".join([*b[:3], a[3]]), *lines[2:]],
        "foreign": [".".join(foreign), *lines[1:]],
        "foreign under this name": [".".join([*a[:3], foreign[3]]), *lines[1:]],
        "added": [*lines, *other],
        "cut and counted anew": fewer,
        "changed": [".".join([*a[:3], message]), *lines[1:]],
        "no frame": [*lines, "not a frame"],
        "nothing": [],
    }
    for what, held in bad.items():
        with pytest.raises(Exception, match="frames missing|decryption failed"):
            read(spark, held)
            pytest.fail(what)


def test_files_and_folders(spark, tmp_path):
    own, path = rows(spark, 9), str(tmp_path / "x.enc")
    for one in (100, 0):
        where = path + str(one)
        sinks.write_encrypted(own, where, KEY, most=2, one=one)
        assert tables.is_folder(spark, where) == (not one)
        assert sorted(map(tuple, tables.encrypted_tokens(spark, where, KEY).collect())) == sorted(map(tuple, own.collect()))
    sinks.write_encrypted(own.limit(0), path, KEY)
    assert tables.encrypted_tokens(spark, path, KEY).count() == 0


def test_parts_of_one_text_each(spark):
    texts = spark.createDataFrame([(7, "a"), (3, "b")], "part int, text string")
    assert sorted(r[0] for r in frames.opened(frames.sealed(texts, KEY), KEY).collect()) == ["a", "b"]
    assert frames.sealed(texts, KEY).where(F.col("value").contains("..")).count() == 0


def test_header_of_a_match_file_whose_first_part_is_not_the_largest(spark, tmp_path):
    from kindred.sources import tables

    parts = {"part-00000.txt": ["# Only matching pairs are listed", "local_id,peer_id", "a0,b0"], "part-00001.txt": [f"a{i},b{i}" for i in range(1, 500)]}
    for name, lines in parts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    assert sorted(map(tuple, tables.matches_file(spark, str(tmp_path)).collect())) == sorted((f"a{i}", f"b{i}") for i in range(500))
