import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from kindred.llm import near_duplicates, shingles, suffix_dedup
from kindred.llm.components import components

LEAST = -(2**63)


def brute_links(rows, threshold=0.8, size=5):
    """(n_links, class) of each row place, by all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall("[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    n = len(rows)
    parent, links = list(range(n)), Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = len(a & b) >= threshold * len(a | b) if a and b else bool(not a and not b and rows[i][1] and rows[i][1] == rows[j][1])
            if same:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min(least.get(r, 2**63), LEAST if d is None else d)
    return [(d, None if least[root(i)] == LEAST else least[root(i)], links[i]) for i, (d, _) in enumerate(rows)]


def corpus():
    random.seed(7)
    vocabulary = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = []
    for g in range(12):
        base = [random.choice(vocabulary) for _ in range(random.choice([3, 5, 8, 60, 200]))]
        for _ in range(random.choice([1, 2, 6])):
            w = list(base)
            for _ in range(random.randint(0, max(1, len(w) // 60))):
                w[random.randrange(len(w))] = random.choice(vocabulary)
            rows.append(" ".join(w))
    rows += [rows[0], rows[0].upper(), "", None, "", "!!!", "!!!", "?", "x", "X", "x y", "word " * 300, "word " * 40_000]
    return [(i, t) for i, t in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "extra") for d, t in rows], "doc_id long, text string, class_id string")


def test_classes_and_links_equal_brute_force(spark):
    rows = [*corpus(), (None, "x"), (3, corpus()[3][1])]  # a null id, a repeated row
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in near_duplicates.near_duplicates(frame(spark, rows)).collect())
    assert got == Counter(brute_links(rows))


def test_one_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK_DOCS", 16)
    random.seed(1)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(70):
        w = list(base)
        w[random.randrange(150)] = f"own{i}"
        rows.append((i, " ".join(w)))
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in near_duplicates.near_duplicates(frame(spark, rows)).collect())
    assert got == Counter(brute_links(rows))


def test_runs_too_large_to_meet_at_once(spark, monkeypatch):
    """Runs of more than 8 representatives: prefixes are shortened from the deepest, the rest meets in tiles."""
    random.seed(4)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(150)]
        for i in range(60):
            w = list(base)
            for _ in range(random.choice([1, 1, 2, 4])):
                w[random.randrange(150)] = f"own{g}-{i}"
            rows.append((len(rows), " ".join(w)))
    rows += [(1000, "one text that stands alone among all the others here"), (1001, None)]
    called = []
    plain = near_duplicates._shortened
    monkeypatch.setattr(near_duplicates, "_shortened", lambda *a: called.append(a[-1]) or plain(*a))
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in near_duplicates.near_duplicates(frame(spark, rows), run=8).collect())
    assert got == Counter(brute_links(rows)) and called == [8]


def test_leaders_stand_in_within_their_radius():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, 192)
    sig = np.array([np.where(rng.random(192) < rng.choice([0.02, 0.04, 0.3]), rng.integers(0, 256, 192), base) for _ in range(50)], np.uint8)
    nodes = np.arange(50) + 7
    a, b, leads, radius = near_duplicates._led(nodes, sig, np.zeros(50), 0.55, 0.1)
    far = 1 - (sig[:, None] == sig[None]).mean(2)
    assert 0 < len(leads) < 50
    assert (far[:, leads].min(1) <= 0.1).all() and (radius[leads] <= 0.1).all()
    assert {*a, *b} <= set(nodes) and len(a) == 49  # one group, so a spanning tree


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7, 1), (2, "a b c d e f", 8, 2)], "doc_id long, text string, id int, id_ int")
    assert [tuple(r) for r in near_duplicates.deduplicated(df).collect()] == [(1, "a b c d e f", 7, 1)]


def test_one_of_each_class(spark):
    rows = [*corpus(), (3, corpus()[3][1]), (None, "x")]
    kept = near_duplicates.deduplicated(frame(spark, rows)).collect()
    assert kept[0].asDict().keys() == {"doc_id", "text", "class_id"}
    want = {c for _, c, _ in brute_links(rows)}
    assert Counter(r["doc_id"] for r in kept) == Counter(want)
    assert near_duplicates.deduplicated(frame(spark, rows).limit(0)).count() == 0


def test_prefix_length():
    assert near_duplicates.prefix_length(0.8) == 4
    assert near_duplicates.prefix_length(0.99) == near_duplicates.DEEPEST
    d = near_duplicates.prefix_length(0.5)
    assert d == 1 or 1 - (1 - 0.5**d) ** near_duplicates.TREES >= near_duplicates.RECALL


def test_components(spark):
    random.seed(5)
    edges = [(random.randint(-60, 60), random.randint(-60, 60)) for _ in range(70)] + [(i, i + 1) for i in range(1000, 1030)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingle_sets_tell_texts_apart():
    a, b, c, d = shingles.shingle_sets(["One two THREE four five six", "one, two: three four\nfive six!", "six five four three two one", "a b"])
    assert (a == b).all() and not np.intersect1d(a, c).size and len(d) == 1


def brute_removed(rows, length=50):
    ordered = sorted(((LEAST if d is None else d), (t or "").encode()) for d, t in rows)
    first = {}
    for d, t in ordered:
        for s in range(len(t) - length + 1):
            first.setdefault(t[s : s + length], d)
    out = []
    for d, t in ordered:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if first[t[s : s + length]] < d:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((None if d == LEAST else d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def removed(spark, rows, **options):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_bytes int")
    return Counter(tuple(r)[:4] + (r["kept_sha256"],) for r in suffix_dedup.removed_strings(df, **options).collect())


def passages(alphabet, n):
    random.seed(3)
    base = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 300))) for _ in range(10)]
    rows = []
    for i in range(n):
        t = ""
        for _ in range(random.randint(0, 4)):
            b = random.choice(base)
            x = random.randint(0, len(b))
            t += b[x : random.randint(x, len(b))] + ("y" * random.randint(0, 120) if random.random() < 0.3 else "")
        rows.append((i if i % 19 else None, t if i % 23 else None))
    return rows + [(5, rows[5][1]), (5, rows[8][1]), (400, rows[8][1])]


@pytest.mark.parametrize("alphabet", ["ab é", "ab \0é", "abcdefghijklmnop ,."])
def test_removed_strings_equal_brute_force(spark, alphabet):
    rows = passages(alphabet, 90)
    assert removed(spark, rows) == brute_removed(rows)


def test_removed_strings_edges(spark):
    assert not removed(spark, [(1, "x")][:0])
    same = "z" * 49
    rows = [(1, same), (2, same), (3, "q" * 50), (4, "q" * 50), (5, "q" * 51), (6, ""), (7, None)]
    assert removed(spark, rows) == brute_removed(rows)
    rows = passages("abcd ", 40)
    assert removed(spark, rows, length=30) == brute_removed(rows, 30)


def test_one_passage_in_all_documents(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 700)
    random.seed(2)
    rows = [(i, f"own {random.random()} " + "The notice that every page of this site carries, word for word, at its end." + f" {random.random()}") for i in range(120)]
    assert removed(spark, rows) == brute_removed(rows)


def test_texts_of_a_shard_are_merged():
    random.seed(9)
    base = ["".join(random.choice("abc ") for _ in range(random.randint(50, 80))).encode() for _ in range(12)]
    contexts = sorted({b[i : i + random.randint(50, 80)] + random.choice([b"", b"xy"]) for b in base for i in range(0, 25) if len(b) - i >= 50})
    documents = np.array([random.randint(0, 1000) for _ in contexts])
    least = {}
    for c, d in zip(contexts, documents.tolist(), strict=True):
        for s in range(len(c) - 49):
            least[c[s : s + 50]] = min(d, least.get(c[s : s + 50], d))
    for most in (1, 300, 2000, 1 << 20):
        got = suffix_dedup.least_documents(contexts, documents, 50, most)
        for i, c in enumerate(contexts):
            assert got[i, : len(c) - 49].tolist() == [least[c[s : s + 50]] for s in range(len(c) - 49)]
    strings, _, which = suffix_dedup.sorted_strings(contexts, documents, 50)
    assert strings.tolist() == sorted(least) and which.max() == len(least) - 1


def test_hash_equal_contexts_are_compared_by_bytes():
    data = np.frombuffer(b"abcdeabcdfabcde", np.uint8)
    got = suffix_dedup._same_bytes(data, np.array([5, 10, 10, 0]), np.array([0, 0, 0, 0]), np.array([5, 5, 4, 5]), np.array([5, 5, 5, 5]))
    assert got.tolist() == [False, True, False, True]


def test_what_recurs_is_sent_once_a_task(spark):
    """One partition of many slices: a passage in every document, of ids in no order, one context on its way."""
    random.seed(12)
    ids = list(range(400))
    random.shuffle(ids)
    passage = "The notice that every page of this site carries, word for word, at its end. "
    rows = [(i, f"own {random.random()} " * 400 + passage + f"{random.random()}") for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = Counter(tuple(r)[:4] + (r["kept_sha256"],) for r in suffix_dedup.removed_strings(df).collect())
    assert got == brute_removed(rows)


def test_a_very_long_text(spark):
    text = " ".join(f"w{i * 7919 % 100_003}" for i in range(60_000))
    rows = [(1, text), (2, "x " * 30 + text[200_000:200_400]), (3, "tail " + text[-300:])]
    assert removed(spark, rows) == brute_removed(rows)


def test_suffix_array_and_common_prefixes():
    random.seed(1)
    contexts = [bytes(random.choice(b"ab") for _ in range(random.randint(1, 90))) for _ in range(12)] + [b"ab" * 20, b"ab" * 20]
    raw = b"\0".join(contexts) + b"\0"
    data = np.frombuffer(raw, np.uint8)
    starts = np.cumsum([0, *(len(c) + 1 for c in contexts)])[:-1]
    sa = suffix_dedup.suffix_array(data)
    rest = lambda i: (raw[i : raw.index(b"\0", i)], i)
    assert [rest(i) for i in sa] == sorted(map(rest, range(len(raw))))
    got = suffix_dedup.common_prefixes(data, sa, starts, np.array([len(c) for c in contexts]), 20)

    def common(i, j):
        n = 0
        while n < 20 and raw[i + n] == raw[j + n] != 0:
            n += 1
        return n

    for r in range(1, len(raw)):
        if raw[sa[r]]:
            assert got[r] == common(sa[r], sa[r - 1])
