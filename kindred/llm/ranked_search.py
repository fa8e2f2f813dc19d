"""Ranked lexical search: documents in clusters by recursive graph bisection, visited by their clusters' bounds.

Documents become rows of the terms that any item asks for. The upper bisections are found on a bounded sample
and route every document to a leaf; a leaf's documents are dealt into blocks of bounded size, which the bisection
orders down to clusters of `CLUSTER` documents. A cluster keeps each term's largest impact, so an item's score in
it has a bound. First every item is scored in the best clusters of each batch; the k-th best score of all is the
item's floor. Then clusters are visited from the highest bound down, until the bound falls below the floor or
the k-th best score found: no document that is left out can be among the k best, ties included.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import cut, sliced, text_or_empty
from kindred.llm.graph_bisection import Tree, fitted, ordered

#: ASCII letters in lower case, digits, and all bytes of other characters; every other byte parts terms.
TERM_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()

#: Bytes of text cut into terms at once, and characters of items that one pass over the texts looks for.
SLICE_BYTES, ITEM_CHARS = 4 << 20, 4 << 20
#: Documents of the sample that the upper bisections are found on, and how many levels of them there are.
SAMPLE_DOCS, LEVELS = 4096, 5
#: Postings of a block, and documents of a cluster.
BLOCK_POSTINGS, CLUSTER = 1 << 18, 64
#: Cells of the matrix of clusters' largest impacts.
CELLS = 1 << 22


def term_list(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


class Items:
    """A block of items: the terms they ask for, numbered, and each item's."""

    def __init__(self, texts: list[str | None]):
        self.vocabulary: dict[bytes, int] = {}
        self.asked = [np.unique(np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in term_list(x)], np.int64)) for x in texts]


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: how many terms it has, and those of the vocabulary with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most the terms of one block of items
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        size = max(1, len(number))
        for batch in batches:
            for part in sliced(batch, 1, SLICE_BYTES):
                lists = [term_list(t) for t in part.column(1).to_pylist()]
                n = np.fromiter(map(len, lists), np.int64, len(lists))
                found = np.fromiter(map(number.get, chain.from_iterable(lists), repeat(-1)), np.int64, int(n.sum()))
                own = np.repeat(np.arange(len(lists)), n)
                keys, counts = np.unique(own[found >= 0] * size + found[found >= 0], return_counts=True)
                some = np.flatnonzero(n)
                offsets = np.append(np.searchsorted(keys, some * size), len(keys)).astype(np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (keys % size, counts)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.array(n[some]), *columns], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(list number of each element, elements)."""
    n = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _routed(postings: DataFrame, tree: Tree) -> DataFrame:
    shared = postings.sparkSession.sparkContext.broadcast(tree)
    names = postings.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = shared.value.leaves(*_flat(b.column(names.index("terms"))), b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32))], names=[*names, "leaf"])

    return postings.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in [*postings.dtypes, ("leaf", "int")]))


_INDEX = "docs binary, known binary, starts binary, terms binary, impacts binary, top_terms binary, top_impacts binary"
_BINARY = pa.schema([(c.split()[0], pa.binary()) for c in _INDEX.split(", ")])


def index(postings: DataFrame, n_terms: int, documents: int, all_terms: int, cluster: int = CLUSTER, block: int = BLOCK_POSTINGS) -> DataFrame:
    """One row a cluster: its documents, their terms and impacts, and each term's largest impact."""
    some = postings.where(F.size("terms") > 0)
    drawn = some.select("terms", F.xxhash64("doc_id", "n", "terms").alias("h")).orderBy("h").limit(SAMPLE_DOCS).select("terms").toArrow()
    doc, terms = _flat(drawn.column("terms").combine_chunks()) if drawn.num_rows else (np.zeros(0, np.int64),) * 2
    routed = _routed(some.withColumn("row", F.monotonically_increasing_id()), fitted(doc, terms, drawn.num_rows, n_terms, LEVELS))
    # The leaves are few; a leaf with many documents has as many blocks as its postings fill.
    blocks = {r["leaf"]: max(1, -(-r["n"] // block)) for r in routed.groupBy("leaf").agg(F.sum(F.size("terms")).alias("n")).collect()}
    count = F.element_at(F.create_map(*[F.lit(x) for kv in (blocks or {0: 1}).items() for x in kv]), F.col("leaf"))
    dealt = routed.withColumn("block", F.pmod(F.xxhash64("row"), count)).drop("row")

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        doc, terms = _flat(group.column("terms").chunk(0))
        tf = _flat(group.column("tfs").chunk(0))[1]
        n = group.column("n").to_numpy().tolist()
        m = np.array([50 + 50 * x * documents // all_terms for x in n], np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
        leaf = ordered(doc, terms, len(n), n_terms, cluster)
        ids = group.column("doc_id").combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        starts = np.searchsorted(doc, np.arange(len(n) + 1))
        rows = []
        order = np.argsort(leaf, kind="stable")
        cuts = np.append(np.searchsorted(leaf[order], np.arange(leaf.max() + 1)), len(order))
        for s, e in zip(cuts, cuts[1:], strict=False):
            own = order[s:e]
            size = starts[own + 1] - starts[own]
            at = np.repeat(starts[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            by = np.argsort(terms[at], kind="stable")
            top, first = np.unique(terms[at][by], return_index=True)
            parts = (ids[own], known[own], np.append(0, np.cumsum(size)).astype(np.int32), terms[at].astype(np.int32), impact[at].astype(np.int32), top.astype(np.int32), np.maximum.reduceat(impact[at][by], first).astype(np.int32))
            rows.append([x.tobytes() for x in parts])
        return pa.table([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], schema=_BINARY)

    return dealt.groupBy("leaf", "block").applyInArrow(build, _INDEX)


class Best:
    """The k best of one item so far: highest scores, then smallest ids, unknown ones last."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, floor
        self.held = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))

    def add(self, ids: np.ndarray, known: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.floor
        if not good.any():
            return
        ids, known, scores = (np.concatenate([a, b[good]]) for a, b in zip(self.held, (ids, known, scores), strict=True))
        order = np.lexsort((ids, ~known, -scores))[: self.k]
        self.held = ids[order], known[order], scores[order]
        if len(order) == self.k:
            self.floor = max(self.floor, int(scores[order[-1]]))


def visited(clusters: DataFrame, items: Items, weights: np.ndarray, k: int, floors: dict[int, int] | None = None) -> DataFrame:
    """(item, doc_id, score) of the k best of each task. Without floors each batch's best cluster of an item is visited alone."""
    shared = clusters.sparkSession.sparkContext.broadcast((items.asked, weights, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight, least = shared.value
        best = [Best(k, max(1, (least or {}).get(q, 1))) for q in range(len(asked))]
        wanted = np.zeros(len(weight), np.int64)
        for batch in batches:
            step = max(1, CELLS // max(1, len(weight)))
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                columns = [c.to_pylist() for c in part.columns]
                ids, known, starts, terms, impacts, top, top_impacts = ([np.frombuffer(x, t) for x in c] for c, t in zip(columns, (np.int64, bool, np.int32, np.int32, np.int32, np.int32, np.int32), strict=True))
                highest = np.zeros((part.num_rows, len(weight)), np.int64)
                for c in range(part.num_rows):
                    highest[c, top[c]] = top_impacts[c]
                for q, own in enumerate(asked):
                    bounds = highest[:, own] @ weight[own]
                    order = np.argsort(-bounds, kind="stable")
                    wanted[own] = weight[own]
                    for c in (order if least is not None else order[:1]).tolist():
                        if bounds[c] < best[q].floor:
                            break
                        best[q].add(ids[c], known[c], np.add.reduceat(impacts[c] * wanted[terms[c]], starts[c][:-1]))
                    wanted[own] = 0
        found = [(np.full(len(b.held[0]), q), *b.held) for q, b in enumerate(best)]
        item, ids, known, scores = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int64)), pa.array(ids, pa.int64(), mask=~known.astype(bool)), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    return clusters.mapInArrow(run, "item long, doc_id long, score long")


def _block(docs: DataFrame, texts: list[str | None], k: int, cluster: int, block: int) -> DataFrame:
    """(item, rank, doc_id, score) for one block of items."""
    items = Items(texts)
    postings = cut(_postings(docs, items.vocabulary))
    total = postings.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    holders = np.zeros(max(1, len(items.vocabulary)), np.int64)
    for term, n in postings.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow().to_pandas().itertuples(index=False):
        holders[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * df + 1))) for df in holders.tolist()], np.int64)
    by_rank = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    clusters = cut(index(postings, len(weights), total["n"], total["l"] or 1, cluster, block))
    first = visited(clusters, items, weights, k).withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") == k)
    floors = {r["item"]: r["score"] for r in first.collect()}  # one row an item of the block
    return cut(visited(clusters, items, weights, k, floors).withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k))


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", item_chars: int = ITEM_CHARS, cluster: int = CLUSTER, block: int = BLOCK_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest score above 0, equal scores by ascending id.

    Scores are integers: each distinct term of the item weighs floor(1000 ln((2 N + 2) / (2 df + 1))), times its saturated
    frequency in the document, whose length counts by half. N and the lengths are those of documents with at least one
    term. Null texts have no terms; a null doc_id stands after all others of its score. Repeated documents are ranked
    each; every row of `items` is an item of its own, also under one id. Items without terms, or whose terms no
    document holds, have no rows; so has an empty table. Texts are read whole, their terms held in memory a slice at a
    time. Other columns are left aside, so their names cannot clash.

    The index holds the terms that the items ask for, no others: what else a document says only counts for its length.
    Items of more than `item_chars` characters together are answered in several passes over the documents.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    blocks = max(1, -(-asked.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0] // item_chars))
    found = None
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect()
        if not rows:
            continue
        names = spark.createDataFrame([(n, r["item_id"]) for n, r in enumerate(rows)], f"item long, item_id {asked.dtypes[0][1]}")
        part = _block(own, [r["text"] for r in rows], k, cluster, block).join(F.broadcast(names), "item")
        part = part.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], f"item_id {asked.dtypes[0][1]}, rank int, doc_id long, score long")
