import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import prefix_trie as T
from kindred.llm import queries
from kindred.llm.common import table

FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Every node from the rows (conv_id, turn, role, text) by its definition; turns of a conversation have different numbers."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(path))))
        children = [p for p in below if len(p) == len(path) + 1]
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    assert all(k == "bigint" for c, k in df.dtypes if c in FIELDS[:-1])
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=repr)


def nodes(spark, rows, **options):
    return got(T.trie(T.branched(T.sequences(spark.createDataFrame(rows, SCHEMA))), **options))


def drawn(seed, convs, most=5):
    rng = random.Random(seed)
    texts = ["hi there", "a b  c", "", "x\ny", "one"]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in range(convs) for t in range(rng.randrange(1, most))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force_over_many_stretches(spark, monkeypatch, seed):
    monkeypatch.setattr(T, "RUN_BYTES", 2000)
    rows = drawn(seed, 90)
    assert nodes(spark, rows, task_bytes=600) == nodes(spark, rows) == brute(rows)


def test_copies_of_one_conversation_are_spread_and_long_ones_kept(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 400, 20) for t in range(3)]
    rows += [(500, t, None, "again " * (t % 3)) for t in range(300)]
    assert nodes(spark, rows, task_bytes=500) == brute(rows)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(None, 0, "user", "left out")],
        [(5, 0, "user", "turnless, as its first three turns are another's, which is absent")],
        [(7, None, None, None), (7, 0, "", "x"), (0, 3, "a", "b"), (-3, 1, "a", "b")],
        [(1, 0, "ab", "c"), (2, 0, "a", "bc")],
    ],
)
def test_nulls_empty_tables_and_absent_bases(spark, rows):
    assert nodes(spark, rows) == brute(rows)


def test_repeated_rows_are_turns_and_other_columns_are_left_aside(spark):
    own = spark.createDataFrame([(20, 0, "u", "x", "k")] * 6, SCHEMA + ", key string").withColumnRenamed("key", "digest")
    depth = T.trie(T.branched(T.sequences(own))).agg({"depth": "max"}).first()[0]
    assert depth == 6


keys = st.lists(st.lists(st.integers(0, 2), max_size=5), max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(keys, max_size=6))
def test_loser_tree_merges_and_carries_prefixes(runs):
    made, every, n = [], [], 0
    for run in runs:
        rows = []
        for k in run:
            rows.append((b"".join(bytes([x]) * T.DIGEST for x in k), n, [1] * len(k)))
            n += 1
        every += rows
        made.append(T.sorted_run(rows))
    out = list(T.merged(made))
    assert [r[:2] for r in out] == sorted(r[:2] for r in every)
    assert [r[3] for r in out] == [T.shared(a[0], b[0]) if a else 0 for a, b in zip([None, *out], out, strict=False)]


def test_query_of_a_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op13_prefix_trie(spark, sf_dir)) == brute(rows)
