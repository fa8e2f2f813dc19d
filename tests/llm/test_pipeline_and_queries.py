import pathlib
import zlib
from collections import Counter

import corpus_pipeline

import __spark_entry__ as entry
from kindred.llm import queries

STAGES = ["toxicity", "near duplicates", "decontamination", "mixing", "sharding"]


def test_all_operators_are_registered():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert names == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stages(spark, sf_dir, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == STAGES
    docs = first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = [t for (t,) in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()]
    ids = {r["doc_id"] for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if name != "sharding":
            assert docs.columns == first.columns
        now = {r["doc_id"] for r in docs.collect()}
        assert now <= ids and len(now) > 0.5 * len(ids)
        ids = now
    assert not any(b in r["text"] for r in docs.collect() for b in benchmark)
    slots = sorted((r["shard"], r["slot"]) for r in docs.collect())
    assert len(slots) == len(set(slots))


def test_empty_and_odd_documents(spark, sf_dir):
    """What each stage makes of rows without text, id or source, of repeated rows and of a very long text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    empty = (1, "", "en", "s", 0)
    long = (3, "plain words of one very long text " * 30_000, "en", "t", 9)
    odd = [(None, None, None, None, None), empty, empty, (2, None, None, None, None), long, (4, "a few words", "en", None, 3)]
    once = sorted({*odd}, key=str)
    want = {"toxicity": odd, "near duplicates": once, "decontamination": odd}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        out = stage(spark, spark.createDataFrame(odd, docs.schema), sf_dir)
        if name == "mixing":  # a source without words has no copies; the null source, three of each row
            got = Counter(tuple(r) for r in out.collect())
            assert got == Counter([long, *3 * [odd[0], odd[3], odd[5]]])
        elif name == "sharding":
            assert Counter(tuple(r)[:5] for r in out.collect()) == Counter(odd)
            assert sorted((r["shard"], r["slot"]) for r in out.collect()) == [(i, 0) for i in range(6)]
        else:
            assert Counter(tuple(r) for r in out.collect()) == Counter(want[name]), name


def test_pipeline_equals_its_stages_and_leaves_one_folder(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_dir)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    folder = pathlib.Path(got.inputFiles()[0].removeprefix("file:")).parent
    assert [p.name for p in folder.parent.iterdir()] == ["sharding"]
    assert not [p for p in folder.parent.parent.glob("pipeline-*/*") if p.name != "sharding" and p.is_dir() and any(p.iterdir())]


def test_shards_hold_every_whole_text(spark, sf_dir):
    want = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op5_sharding(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in want.items()}
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
