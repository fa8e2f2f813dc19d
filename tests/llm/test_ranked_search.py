import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from kindred.llm import graph_bisection, ranked_search
from kindred.llm.ranked_search import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """(item_id, rank, doc_id, score) by the definition."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, total = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in counts:
            m = 50 + 50 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    assert df.dtypes[1:] == [("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, df.collect()), key=repr)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def drawn(seed, n):
    """Documents of a few topics, so that clusters differ."""
    rng = random.Random(seed)
    topics = [[f"w{t}x{i}" for i in range(12)] for t in range(5)]
    common = ["The", "of", "ünd", "漢字"]
    text = lambda: " ".join(rng.choice(rng.choice([topics[rng.randrange(5)], common])) for _ in range(3)) + ", " + " ".join(rng.choices(rng.choice(topics) + common, k=rng.randrange(0, 30)))
    return [(i, text()) for i in range(n)], [(100 + i, text()) for i in range(12)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force_through_small_clusters(spark, seed):
    docs, items = drawn(seed, 300)
    want = brute(docs, items, 7)
    assert got(ranked(*frames(spark, docs, items), k=7, cluster=4, block=300)) == want
    assert got(ranked(*frames(spark, docs, items), k=7, item_chars=200)) == want


@pytest.mark.parametrize(
    ("docs", "items"),
    [
        ([], [(1, "a b")]),
        ([(1, "a b")], []),
        ([(1, None), (2, ""), (3, "?!")], [(1, "a"), (2, None)]),
        ([(None, "a b"), (None, "a b"), (5, "a b"), (4, "b a"), (4, "b a"), (9, "c " * 9), (8, "d " * 40_000 + "a")], [(1, "A, a! c"), (1, "b"), (None, "c zz"), (3, "zz"), (4, "  ")]),
    ],
)
def test_nulls_ties_repeats_and_empty_tables(spark, docs, items):
    assert got(ranked(*frames(spark, docs, items), k=5)) == brute(docs, items, 5)


def test_a_group_of_copies_fills_several_blocks_and_names_may_clash(spark):
    docs = [(i, "same words here") for i in range(500)] + [(1000 + i, f"other text {i}") for i in range(100)]
    own = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, terms string, n int")
    items = spark.createDataFrame([(1, "words text 7", 2)], "item_id long, text string, rank int")
    assert got(ranked(own, items, k=50, cluster=8, block=64)) == brute(docs, [(1, "words text 7")], 50)


def test_terms_are_those_of_the_pattern():
    every = "".join(map(chr, range(0x20, 0x250))) + " aÀB_1İß\x00z\x7f漢"
    assert [t.decode() for t in ranked_search.term_list(every)] == terms(every)


def test_bisection_brings_topics_together():
    rng = np.random.default_rng(1)
    topic = rng.permutation(np.repeat(np.arange(4), 64))
    doc = np.repeat(np.arange(256), 6)
    terms_ = topic[doc] * 20 + rng.integers(0, 20, len(doc))
    leaf = graph_bisection.ordered(doc, terms_, 256, 80, 64)
    assert np.bincount(leaf).max() <= 64
    pure = sum(np.bincount(topic[leaf == g]).max() for g in np.unique(leaf))
    assert pure > 240
    tree = graph_bisection.fitted(doc, terms_, 256, 80, 2)
    routed = tree.leaves(doc, terms_, 256)
    assert sum(np.bincount(topic[routed == g]).max() for g in np.unique(routed)) > 240


def test_clusters_below_the_floor_are_not_visited(monkeypatch):
    """What a cluster cannot reach is never scored: the floor is its k-th best score."""
    best = ranked_search.Best(2, 5)
    best.add(np.array([4, 3]), np.array([True, True]), np.array([4, 5]))
    assert best.floor == 5 and best.held[0].tolist() == [3]
    best.add(np.array([9, 2, 1]), np.array([True, True, True]), np.array([7, 7, 5]))
    assert best.floor == 7 and best.held[0].tolist() == [2, 9]
