import itertools
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import decontamination, html_text, labelled_pages, mixing, sharding, topk, toxicity

# --- sharding


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_sharding(spark):
    random.seed(1)
    rows = [(i if i % 50 else None, None if i % 31 == 0 else "x" * random.randint(0, 300), "s") for i in range(1000)] + [(7, "same", "s")] * 40
    df = docs(spark, rows).withColumn("shard", F.lit("clash"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    out = sharding.sharded(df, ["doc_id"], size, bucket_bytes=4000)
    got = out.collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == Counter(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.sharded(df, ["doc_id"], size, bucket_bytes=4000).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    other = sharding.sharded(df, ["doc_id"], size, seed=8, bucket_bytes=4000).collect()
    assert Counter(map(tuple, got)) != Counter(map(tuple, other))
    assert sharding.sharded(df.limit(0), ["doc_id"], size).count() == 0
    assert sharding.sharded(df.limit(3), ["doc_id"], size).count() == 3


def test_shard_files(spark, tmp_path):
    df = docs(spark, [(i, f"t{i}", "s") for i in range(100)])
    sharding.write_shards(sharding.sharded(df, ["doc_id"], F.lit(1), shards=4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.select("shard").distinct().count() == 4
    for file in (tmp_path / "out").glob("shard=*/*.parquet"):
        slots = [r["slot"] for r in spark.read.parquet(str(file)).collect()]
        assert slots == sorted(slots)


def test_many_buckets_a_task(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PARTS", 4)
    rows = [(i, "x" * (i % 9), "s") for i in range(500)] + [(1000, "y" * 5000, None)]
    df = docs(spark, rows).withColumn("bucket", F.lit(1)).withColumn("record", F.lit(2)).withColumn("text_crc", F.lit(3))
    out = sharding.document_shards(df, bucket_bytes=100)
    assert out.columns == [*df.columns, "shard", "slot"]
    got = out.collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((*r, 1, 2, 3) for r in rows)
    assert sorted(r["slot"] * 16 + r["shard"] for r in got) == list(range(501))


# --- mixing


def filled(sizes, most=3):
    """Targets by stopping one source after the other."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    out, left, rest = {}, sum(sizes.values()), set(order)
    while rest:
        level = left / sum(weight[s] for s in rest)
        over = {s for s in rest if level * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in rest}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        rest -= over
    return out


def test_mixing(spark):
    random.seed(2)
    rows = []
    for source, n in (("a", 600), ("b", 30), (None, 200), ("é", 5), ("", 3), ("zero", 2)):
        for _ in range(n):
            rows.append((len(rows), " ".join(["w"] * random.randint(1, 40)) if source != "zero" else "", source))
    rows += [(9999, None, "a"), (10000, "a b\x0bc", "a"), (5, rows[5][1], "a")]
    df = docs(spark, rows).withColumn("size", F.lit("clash"))
    out = mixing.mix_plan(df).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for r in out:
        sizes[r["source"]] += r["size"]
    assert {r["size"] for r in out if r["doc_id"] == 10000} == {2}
    want = filled(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert math.floor(rate) <= r["copies"] <= min(3, math.ceil(rate))
    taken = Counter()
    for r in out:
        taken[r["source"]] += r["size"] * r["copies"]
    for s in ("a", None):
        assert abs(taken[s] / want[s] - 1) < 0.2
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == sum((Counter({r["doc_id"]: r["copies"]}) for r in out), Counter())
    assert mixing.mix_plan(df.limit(0)).count() == 0


# --- toxicity


def toxic_corpus(spark, n=400):
    random.seed(5)
    words = ["".join(random.choice("aeioulmnrst") for _ in range(random.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [random.choice(words) for _ in range(random.randint(20, 80))]
        bad = i % 7 == 0
        if bad:
            for _ in range(3):
                w.insert(random.randrange(len(w)), random.choice(["blorgy!", "blorgish", "Zankface", "zankface."]))
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 0, int(bad)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    df, labels = toxic_corpus(spark)
    grammar = toxicity.fit(toxicity.sample(df, labels))
    got = {r["doc_id"]: r for r in toxicity.scored(df, grammar).withColumn("held", toxicity.held_out()).collect()}
    for i, r in got.items():
        assert r["held"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in got.values() if r["held"]]
    right = sum(r["predicted"] == int(r["doc_id"] % 7 == 0) for r in held)
    assert right / len(held) > 0.97


def test_held_out_labels_are_not_learned(spark):
    df, labels = toxic_corpus(spark, 200)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(toxicity.sample(df, x)) for x in (labels, flipped))
    assert a.lexicon == b.lexicon and (a.coefficients == b.coefficients).all()


def test_toxicity_edges(spark):
    df, labels = toxic_corpus(spark, 60)
    odd = docs(spark, [(None, None, None), (1, "", "s"), (1, "", "s"), (2, "word " * 50_000, "s")]).withColumn("score", F.lit("clash"))
    for known in (labels, labels.limit(0), labels.withColumn("toxic", F.lit(None).cast("int")), labels.withColumn("toxic", F.lit(0))):
        out = toxicity.scored(odd, toxicity.fit(toxicity.sample(df, known))).collect()
        assert len(out) == 4 and all(r["predicted"] == 0 for r in out)
    assert toxicity.scored(odd.limit(0), toxicity.Grammar({}, toxicity.PRIOR)).count() == 0


def test_clauses():
    g = toxicity.Grammar({"=blorg": 2.0, "zank": 1.0}, toxicity.PRIOR)
    events = lambda text: np.expm1(g.features(text)[1:6]).round(6).tolist()  # noqa: E731  plain, addressed, negated, reported, threat
    assert events("what a blorg") == [2, 0, 0, 0, 0]
    assert events("you are a blorg") == [0, 2, 0, 0, 0]
    assert events("you. a blorg") == [2, 0, 0, 0, 0]
    assert events("he is not a blorg") == [0, 0, 2, 0, 0]
    assert events("not one of all these many is a blorg") == [2, 0, 0, 0, 0]
    assert events("she said blorg") == [0, 0, 0, 2, 0]
    assert events("I will hurt you, zankish") == [0, 1, 0, 0, 1]
    assert events("they said I will hurt you") == [0, 0, 0, 0, 0]
    assert events("nothing here") == [0, 0, 0, 0, 0]
    assert g.score("you blorg, you zankface") > g.score("he is not a blorg") > g.score("plain words")


def plain_clause(symbols):
    """The events of a clause by walking it, without transducers."""
    events, denied, told = [], -99, False
    for at, s in enumerate(symbols):
        if s == "N":
            denied = at
        elif s == "R":
            told = True
        elif s == "T" and "Y" in symbols and not told and at - denied > toxicity.REACH:
            events.append("threat")
        elif s == "I":
            events.append("reported" if told else "negated" if at - denied <= toxicity.REACH else "addressed" if "Y" in symbols else "plain")
    return events


def test_composed_transducers_equal_a_plain_walk():
    g = toxicity.Grammar({}, toxicity.PRIOR)
    machines = [toxicity.negation(), toxicity.reported_speech(), toxicity.target(), toxicity.threat(), toxicity.insult()]
    every = [tuple(c) for n in range(5) for c in itertools.product("oITYNR", repeat=n)]
    random.seed(6)
    for clause in every + [tuple(random.choices("ooooITYNR", k=random.randint(5, 9))) for _ in range(300)]:
        written = [clause]
        for m in machines:  # one after the other, every path
            written = [tuple(out) for w in written for out in m.every(w)]
        assert len(written) == 1 and list(toxicity.CLAUSE.every(clause)) == [list(written[0])]
        assert toxicity.CLAUSE.read(clause) == list(written[0])
        want = plain_clause(clause)
        assert [e for e in written[0] if e != "o"] == want == g.events("".join(clause))
    long = "N" + "o" * 50 + "IY" + "o" * 9 + "T"
    assert g.events(long) == plain_clause(long) == ["addressed", "threat"]


def test_an_item_at_the_end_of_a_very_long_text(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards watch"
    df = docs(spark, [(1, "plain words of a long text " * 40_000 + item.replace("lazy", "lasy"), "s"), (2, "plain words of a long text " * 40_000, "s")])
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = {r["doc_id"]: [(h["item_id"], h["distance"]) for h in r["hits"]] for r in decontamination.matches(df, bench).collect()}
    assert got == {1: [(5, 1)], 2: []}


def test_names_that_clash(spark):
    df = docs(spark, [(1, "some text", "s")]).withColumn("scored_text", F.lit(5)).withColumn("_text", F.lit(6)).withColumn("_source", F.lit(7))
    out = toxicity.scored(df, toxicity.Grammar({}, toxicity.PRIOR))
    assert out.columns == [*df.columns, "score", "predicted"] and out.first()["_text"] == 6 and out.first()["scored_text"] == 5
    bench = spark.createDataFrame([(1, "other words that stand nowhere else")], "item_id long, text string")
    assert decontamination.clean(df, bench).first() == df.first() == mixing.mixed(df).first()
    assert mixing.mix_plan(df).first()["_source"] == 7


# --- decontamination


def distance(item, text):
    """Least edit distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    random.seed(3)
    for _ in range(200):
        item = "".join(random.choice("ab ") for _ in range(random.randint(1, 40)))
        text = "".join(random.choice("ab ") for _ in range(random.randint(0, 60)))
        want = distance(item, text)
        assert decontamination.Pattern(item).least(text, len(item))[0] == want
        got, end = decontamination.Pattern(item).least(text, 2)
        assert got == min(want, 3) and (end >= 0) == (want < 3)


def edited(text, n):
    t = list(text)
    for _ in range(n):
        i = random.randrange(len(t))
        random.choice([lambda: t.__setitem__(i, "q"), lambda: t.pop(i), lambda: t.insert(i, "k")])()
    return "".join(t)


def test_matches_equal_brute_force(spark):
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(random.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(random.randint(4, 30)))) for i in range(12)] + [(90, "short one"), (91, None), (92, ""), (93, "!!!")]
    items.append((94, items[0][1].upper()))
    rows = []
    for i in range(150):
        t = " ".join(word() for _ in range(random.randint(0, 60)))
        if i % 2:
            k = random.randrange(13)
            t += " " + edited(items[k][1], random.randint(0, len(items[k][1]) // 12)) + " " + word()
        rows.append((i, None if i % 37 == 0 else t, "s"))
    rows += [(500, "This is a SHORT, one!", "s"), (501, "short ones", "s"), (502, "", "s"), rows[1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, rows).withColumn("hits", F.lit("clash"))
    want = {}
    for d, t, _ in rows:
        x = decontamination.normalized(t or "")
        for k, item in items:
            n = decontamination.normalized(item or "")
            if not n:
                continue
            e = decontamination.budget(n)
            if len(n) < decontamination.LEAST_CHARS:
                if f" {n} " in f" {x} ":
                    want[d, k] = 0
            elif (got := distance(n, x)) <= e:
                want[d, k] = got
    for options in ({}, {"block_chars": 200}):
        got = {(r["doc_id"], h["item_id"]): h["distance"] for r in decontamination.matches(df, bench, **options).collect() for h in r["hits"]}
        assert got == want
    assert len(want) > 40
    kept = decontamination.clean(df, bench)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _, _ in rows} - {d for d, _ in want}
    assert decontamination.clean(df, bench.limit(0)).count() == len(rows)
    assert decontamination.clean(df.limit(0), bench).count() == 0


# --- HTML


PAGE = """<!DOCTYPE html><html><head><title>Site &amp; title words</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home page</a></li><li><a href="/b">About the site</a></li></ul></nav>
<div class="cookie-banner">We use cookies, accept <button>OK</button></div>{article}
<aside>Side bar text</aside><div id="comments"><p>I agree with this</p></div><footer>&copy; Owner of the site</footer></body></html>"""


@pytest.mark.parametrize("article, want", [
    ("<article><h1>Head</h1><p>One  two\n three &amp; four.</p><p>Five.</p></article>", "Head\n\nOne two three & four.\n\nFive."),
    ("<article><p><b>Bold text here<br>next line<p>Second &eacute;t&#233; &lt;tag&gt;</p><nav><a>Inner menu words</a></nav><p>Last</p></article>", "Bold text here next line\n\nSecond été <tag>\n\nLast"),
    ("<main><div class='post'><p>" + "Word and more words. " * 30 + "</p><form><input>Your mail</form><p>End of it.</p></div></main>", ("Word and more words. " * 30).strip() + "\n\nEnd of it."),
    ("<div class='content'><p>" + "Plain words in a division. " * 9 + "</p><p>And a second one with <a href='/x'>a link</a> in it.</p></div>", ("Plain words in a division. " * 9).strip() + "\n\nAnd a second one with a link in it."),
    ("<article><ul><li>One item</li><li>Two item</li></ul><!-- no --><p>Text of it<div class='ad'>Buy now</div></p>tail words</article>", "One item\n\nTwo item\n\nText of it\n\ntail words"),
    ("", ""),
])
def test_main_text(article, want):
    assert html_text.main_text(PAGE.replace("{article}", article)) == want


def test_main_text_odd():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<div><!-- open") == ""
    assert html_text.main_text("just words") == "just words"
    assert html_text.main_text("<article><p>cut off in the mid") == "cut off in the mid"
    assert html_text.main_text("<article>" + "<div>" * 3000 + "deep words") == "deep words"
    assert html_text.main_text("<article><p>a < b and c</p></article>") == "a < b and c"


def plain_text(page, w):
    """The same by brute force: features by walking up, all contiguous regions tried."""
    es = html_text.events(page)
    ups = []
    for e in es:
        up, at = set(), e.features or ()
        while at:
            up, at = up | at[0], at[1]
        ups.append(up)
    held = [bool(up & {"<article>", "<main>"}) for up in ups]
    beside = any(h and e.words for h, e in zip(held, es, strict=True))
    score = [
        -w.tag.get(e.kind, w.other) if e.features is None else sum(w.word.get(f, 0) for f in up) + w.word["all"] + (w.word["beside"] if beside and not h else 0)
        for e, up, h in zip(es, ups, held, strict=True)
    ]
    value = [s if e.features is None else min(html_text.WORD, max(-html_text.OTHER_WORD, s)) * e.words for e, s in zip(es, score, strict=True)]
    best, i, j = max(((sum(value[i:j]), -i, -j) for i in range(len(es)) for j in range(i, len(es) + 1)), default=(0, 0, 0))
    i, j, out = -i, -j, [[]]
    if best > 1e-9:
        paths = {}
        for k, e in enumerate(es):
            path, at = [], e.features or ()
            while at:
                path, at = [at, *path], at[1]
            paths[k] = path
        words = [paths[k] for k in range(i, j) if es[k].words]
        common = [n for n in words[0] if all(any(n is m for m in p) for p in words)]
        if common and common[-1][0]:
            within = [k for k in paths if any(n is common[-1] for n in paths[k])]
            i, j = min(i, within[0]), max(j, within[-1] + 1)
        for e, s in zip(es[i:j], score[i:j], strict=True):
            if e.block:
                out.append([])
            if e.features is None or s > 0 or not e.words:
                out[-1].append(e.text)
    return "\n\n".join(t for t in (" ".join("".join(b).split()) for b in out) if t), best


def test_text_equals_brute_force():
    random.seed(4)
    w = html_text.weights()
    parts = ["word and word ", "<p>", "</p>", "<nav>menu item", "</nav>", "<a>link</a>", "<div>", "</div>", "<article>", "</article>", "<div class='ad-box'>buy it", "<br>", "<div class=story>"]
    for _ in range(120):
        page = "".join(random.choice(parts) for _ in range(25))
        want, best = plain_text(page, w)
        es = html_text.events(page)
        value = html_text.values(es, w.scores(es))
        i, j = html_text.region(value)
        assert math.isclose(sum(value[i:j]), max(0, best), abs_tol=1e-9)
        assert html_text.main_text(page) == want, page


LONG = ("The words of this text go on for a while. " * 6).strip()
FRAME = '<html><body><nav><ul><li><a href="/">Home page</a></li></ul></nav>{}<footer>Owner of the site</footer></body></html>'


@pytest.mark.parametrize("body, want", [
    (f"<div class='ad-free story'><p>{LONG}</p></div>", LONG),
    (f"x<div class='banner-story'><p>{LONG}</p></div>", f"x\n\n{LONG}"),
    (f"<article><p>{LONG}</p></article><article><p>{LONG}</p></article>", f"{LONG}\n\n{LONG}"),
    (f"<article><p>{LONG}</p></article><div class='box-left'><p>{'Plain side words here. ' * 60}</p></div>", LONG),
    (f"<div><p>{LONG}</p></div><div class='box-left'><p>{'Plain side words here. ' * 60}</p></div>", LONG),
    (f"<article><p>{LONG}</p></article><div class='reader-remarks'><p>{'I think so too. ' * 20}</p></div>", LONG),
    (f"<article><p>{LONG}</p><div class='reader-remark'><p>I agree</p></div><p>End.</p></article>", f"{LONG}\n\nEnd."),
    (f"<div class='content with-sidebar'><p>{LONG}</p></div>", LONG),
    (f"<article><p>{LONG}</p><ul><li><a href=/>A link</a></li><li>One <a href=/>more</a></li></ul><h2><a href=/>Head</a></h2><p>End.</p></article>", f"{LONG}\n\nA link\n\nOne more\n\nHead\n\nEnd."),
    (f"<article><header><h1>Title</h1></header><p>{LONG}</p><aside>Also read this</aside><p>Short.</p></article>", f"Title\n\n{LONG}\n\nShort."),
])
def test_names_are_features_not_filters(body, want):
    assert html_text.main_text(FRAME.format(body)) == want


def _judged(pages, w):
    """(precision, recall) by words."""
    hit = made = true = 0
    for page in pages:
        es = html_text.events(page)
        score = w.scores(es)
        i, j = html_text.grown(es, *html_text.region(html_text.values(es, score)))
        for k, (e, s) in enumerate(zip(es, score, strict=True)):
            got, own = i <= k < j and s > 0, labelled_pages.MARK in e.text
            hit, made, true = hit + e.words * (got and own), made + e.words * got, true + e.words * own
    return hit / made, hit / true


def test_learned_weights_decide():
    held_out = labelled_pages.pages(120, seed=99)
    precision, recall = _judged(held_out, html_text.weights())
    assert precision > 0.96 and recall > 0.96
    flat = html_text.Weights({html_text.ALL: 1.0}, {})
    assert _judged(held_out, flat)[0] < 0.75
    assert html_text.main_text(PAGE.replace("{article}", f"<article>{LONG}</article>"), flat) != LONG


def test_stray_tags_take_linear_time():
    def seconds(n):
        start = time.process_time()
        html_text.main_text("<div>" * n + "</span>" * n + "words" + "<b>" * n + "<p>x</p>" * n)
        return time.process_time() - start

    seconds(1000)
    assert seconds(40_000) < 40 * max(0.02, seconds(4000))


def test_very_long_page():
    page = "<nav>menu</nav><article>" + "<p>word and word</p>" * 100_000 + "</article><footer>end</footer>"
    assert html_text.main_text(page) == "\n\n".join(["word and word"] * 100_000)


def test_extract(spark):
    rows = [(1, "u", PAGE.replace("{article}", "<article>Ünïcode text</article>")), (2, None, None), (2, None, ""), (None, "v", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_text.extract(df, ["page_id", "url"]).collect())
    assert got == Counter([(1, "u", "Ünïcode text", 12), (2, None, "", 0), (2, None, "", 0), (None, "v", "x", 1)])
    assert html_text.extract(df.limit(0), ["page_id"]).count() == 0
    clash = df.drop("text").withColumn("html_text", F.lit(7))
    assert {r["html_text"] for r in html_text.extract(clash, ["page_id", "html_text"]).collect()} == {7}
    with pytest.raises(ValueError):
        html_text.extract(df, ["page_id", "text"])


# --- top-k


def brute_top(rows, k, every):
    vectors = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for qi, q in vectors:
        if qi % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), ci) for ci, c in vectors if ci != qi and len(c) == len(q))
            for rank, (s, ci) in enumerate(scored[:k], 1):
                out[qi, rank, ci, -s] += 1
    return out


@pytest.mark.parametrize("spread", [0.05, 1.0, 1e6])
def test_top_k_equals_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_CELLS", 24 * 40)
    monkeypatch.setattr(topk, "QUERY_CELLS", 24 * 4)
    monkeypatch.setattr(topk, "MEETINGS", 3)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 24)) * spread * rng.random((300, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(300, rows[20][1]), (301, rows[20][1]), (302, [0.0] * 24), (303, None), (304, [None] * 24), (305, [math.nan] * 24), (306, [math.inf] + [0.0] * 23), (None, [1.0] * 24), (320, []), (340, [1.0, 2.0]), (341, [1.0, 2.5]), (20, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = Counter(tuple(r) for r in topk.top_k(df, 5, 20).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows, 5, 20)


def test_top_k_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few).collect()] == [(0, 1, 1, 64 * 128)]


def test_top_k_of_very_large_components(spark):
    """Scores are exact beyond 64-bit sums; one that does not fit a long is an error, if it is among the best."""
    rows = [(0, [1e20, 0.0, 3.0]), (1, [0.0, 1e20, 2.0]), (2, [0.0, -1e300, -5.0]), (3, [0.0, 7.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, 2, 20).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 64 * 64 * 6), (0, 2, 3, 64 * 64 * 6)]
    huge = spark.createDataFrame([(0, [3e38, 1.0]), (1, [3e38, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(huge).collect()


def test_top_k_meets_only_blocks_that_can_serve():
    """Long candidates serve every query, short ones none whose floor is high."""
    rng = np.random.default_rng(2)
    q, c = np.abs(rng.integers(1, 50, (30, 8))), np.abs(rng.integers(1, 50, (400, 8)))
    c[200:] //= 20
    ids = np.arange(400) + 100
    score = q @ c.T
    want = [sorted(zip((-s).tolist(), ids.tolist(), strict=True))[:4] for s in score]
    floor = np.array([-w[-1][0] for w in want], float)
    need = floor / np.sqrt((q * q).sum(1))
    assert need.min() > np.sqrt((c[200:] ** 2).sum(1)).max()
    for floors in (floor, np.full(30, -np.inf)):
        best = topk.Best(np.arange(30), q, floors, 4, np.eye(8))
        for block in (slice(200, 400), slice(0, 200)):
            best.meet(ids[block], c[block])
        qi, who, got, fits = best.rows()
        assert fits.all() and [[(-int(s), int(i)) for k, i, s in zip(qi, who, got, strict=True) if k == x] for x in range(30)] == want
