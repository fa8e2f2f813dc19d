"""Prefix trie of conversations, by a mergesort that carries common prefixes.

A conversation is the sequence of its turns' digests; sequences are sorted in runs of bounded size, each
record with the number of turns that it shares with the one before (its LCP). Records of all runs are dealt by
range, so that a task holds a stretch of the sorted order, however often one sequence recurs. There a loser
tree merges the runs: of two heads the one that shares more turns with the last record is the lesser, and
turns are compared only from where both share as many. The merged stream's LCPs say which nodes of the path
that is open have ended. Nodes at the rim of a stretch may go on in the next; they are merged in a last, short
stream by the same kind of stack.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import cut
from kindred.llm.mixing import words

#: Bytes of a turn's digest, of a sorted run, and of what a task merges.
DIGEST, RUN_BYTES, TASK_BYTES = 16, 8 << 20, 32 << 20
#: Rows of one batch of nodes.
BATCH = 8192


def _digest(*parts: Column) -> Column:
    """128 bits of SHA-256 over parts told apart by their lengths."""
    held = [F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.substring(F.unhex(F.sha2(F.concat(*held), 256)), 1, DIGEST)


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<turn, digest, words>>): each conversation's turns by number, null first."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn"), _digest(role, text).alias("digest"), words(text).alias("words"))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).where("conv_id is not null")
    return own.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def branched(own: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, turns) where conversation c begins with the first h turns of c - c % block, with crc32(c) % most as h,
    and goes on with its own turns after its first h."""
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % most).cast("int")
    heads = own.where(c % block == 0).select(c.alias("base"), F.slice("turns", 1, most).alias("head"))
    joined = own.withColumn("base", c - c % block).join(heads, "base", "left")
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", F.slice("turns", 1, F.lit(0))), F.lit(1), h), rest).alias("turns"))


def _records(own: DataFrame) -> DataFrame:
    """(conv_id, key, words): digests one after the other, so that keys sort as sequences of turns do."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    return own.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))


def shared(a: bytes, b: bytes, start: int = 0) -> int:
    """How many turns two keys share, given that they share `start`."""
    n, most = start, min(len(a), len(b)) // DIGEST
    while n < most and a[n * DIGEST : (n + 1) * DIGEST] == b[n * DIGEST : (n + 1) * DIGEST]:
        n += 1
    return n


Record = tuple[bytes, int, list[int], int]


def sorted_run(rows: list[tuple[bytes, int, list[int]]]) -> list[Record]:
    """(key, conv_id, words, LCP with the record before) in order of key and id."""
    rows.sort(key=lambda r: r[:2])
    return [(*r, shared(before[0], r[0]) if before else 0) for before, r in zip([None, *rows], rows, strict=False)]


def merged(runs: list[list[Record]]) -> Iterator[Record]:
    """All records of sorted runs in order, each with its LCP with the one before: a loser tree over the runs' heads."""
    runs = [r for r in runs if r]
    k = len(runs)
    if not k:
        return
    at, lcp = [0] * k, [0] * k

    def lesser(i: int, j: int) -> tuple[int, int]:
        """(winner, loser) of two runs; both heads' LCPs are with the last record, the loser's then with the winner."""
        if at[i] == len(runs[i]):
            return j, i
        if at[j] == len(runs[j]):
            return i, j
        if lcp[i] != lcp[j]:
            return (i, j) if lcp[i] > lcp[j] else (j, i)
        a, b = runs[i][at[i]], runs[j][at[j]]
        n = shared(a[0], b[0], lcp[i])
        x, y = a[0][n * DIGEST : (n + 1) * DIGEST], b[0][n * DIGEST : (n + 1) * DIGEST]
        won, lost = (i, j) if (x, a[1]) < (y, b[1]) else (j, i)
        lcp[lost] = n
        return won, lost

    loser, won = [0] * k, [0] * (2 * k)
    won[k:] = range(k)
    for node in range(k - 1, 0, -1):
        won[node], loser[node] = lesser(won[2 * node], won[2 * node + 1])
    best = won[1]
    while at[best] < len(runs[best]):
        key, conv, held, _ = runs[best][at[best]]
        yield key, conv, held, lcp[best]
        at[best] += 1
        lcp[best] = runs[best][at[best]][3] if at[best] < len(runs[best]) else 0
        node = (best + k) // 2
        while node:
            best, loser[node] = lesser(best, loser[node])
            node //= 2


@dataclass
class Node:
    """A node of the open path. What its ended children had, and its own ends, is summed here."""

    digest: bytes
    name: bytes
    words: int
    place: int
    edge: bool = False
    least: int | None = None
    n: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: list[str] = field(default_factory=list)

    def add(self, least: int, n: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


_NODE = "node binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, part int, place long, digest binary, words long, ends string"
_ARROW = pa.schema([(n, {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "int": pa.int32()}[t]) for n, t in (c.split(" ") for c in _NODE.split(", "))])


class OpenPath:
    """The nodes from the root to the last record. Rows of nodes that ended gather in `rows`; those of `edge` nodes,
    which may begin before the stretch or go on after it, with their part and their place in order."""

    def __init__(self, part: int | None = None):
        self.part, self.path, self.rows, self.places = part, [], [], 0

    def enter(self, digest: bytes, own_words: int, edge: bool = False) -> Node:
        name = hashlib.sha256(self.path[-1].name + digest).digest()[:DIGEST] if self.path else bytes(DIGEST)
        self.path.append(Node(digest, name, own_words, self.places, edge))
        self.places += 1
        return self.path[-1]

    def leave(self, depth: int) -> None:
        """End all nodes from `depth` on."""
        while len(self.path) > depth:
            node = self.path.pop()
            parent = self.path[-1] if self.path else None
            if node.edge:
                self.rows.append((None, None, len(self.path), node.least, node.n, node.children, node.leaves, node.saved, None, self.part, node.place, node.digest, node.words, ",".join(node.ends)))
                continue
            leaves, saved = node.leaves if node.children else 1, node.saved + (node.n - 1) * node.words
            ends = hashlib.sha256(",".join(node.ends).encode()).hexdigest()
            self.rows.append((node.name, parent and parent.name, len(self.path), node.least, node.n, node.children, leaves, saved, ends, None, None, None, None, None))
            if parent:
                parent.add(node.least, node.n)
                parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + leaves, parent.saved + saved

    def flushed(self, least: int = BATCH) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= max(1, least):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
            self.rows = []


def _stretch(records: Iterator[Record], part: int) -> Iterator[pa.RecordBatch]:
    """The nodes of a stretch of sorted records: those on its first and last path are edges."""
    open_, first = OpenPath(part), True
    for key, conv, own_words, lcp in records:
        if first:
            open_.enter(b"", 0, True)
        open_.leave(lcp + 1)
        for d in range(lcp, len(own_words)):
            open_.enter(key[d * DIGEST : (d + 1) * DIGEST], own_words[d], first)
        open_.path[-1].add(conv, 1)
        open_.path[-1].ends.append(str(conv))
        first = False
        yield from open_.flushed()
    for node in open_.path:
        node.edge = True
    open_.leave(0)
    yield from open_.flushed(1)


def _joined_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edge nodes in order of part and place: equal ones of neighbouring stretches are one node."""
    open_ = OpenPath()
    for batch in batches:
        for r in batch.to_pylist():
            d = r["depth"]
            if len(open_.path) <= d or open_.path[d].digest != r["digest"]:
                open_.leave(d)
                open_.enter(r["digest"], r["words"])
            node = open_.path[d]
            if r["conv_id"] is not None:
                node.add(r["conv_id"], r["n_convs"])
            node.children, node.leaves, node.saved = node.children + r["n_children"], node.leaves + r["n_leaves"], node.saved + r["saved_tokens"]
            if r["ends"]:
                node.ends.append(r["ends"])
            yield from open_.flushed()
    open_.leave(0)
    yield from open_.flushed(1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of about RUN_BYTES, their records numbered."""
    part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

    def run() -> pa.RecordBatch:
        records = sorted_run(held)
        number = (part << 32) + made
        columns = [[number] * len(records), range(len(records)), *zip(*[(c, k, w, n) for k, c, w, n in records], strict=True)]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["run", "place", "conv_id", "key", "words", "lcp"])

    for batch in batches:
        for conv, key, own_words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append((key, conv, own_words))
            size += 2 * len(key) + 100
            if size >= RUN_BYTES:
                yield run()
                made, held, size = made + 1, [], 0
    if held:
        yield run()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a task's records, which come run by run."""
    runs: dict[int, list[Record]] = {}
    for batch in batches:
        for number, _, conv, key, own_words, lcp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs.setdefault(number, []).append((key, conv, own_words, lcp))
    yield from _stretch(merged(list(runs.values())), TaskContext.get().partitionId())


def trie(own: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The nodes of the prefix trie of (conv_id, turns), as `sequences` or `branched` make them.

    A node is a distinct sequence of the first d turns of some conversation, from the root (d = 0) down. Per node:
    node and parent (names that its turns decide), conv_id (its smallest member), depth, parent_conv_id (null for the
    root), n_convs (members), n_children, n_leaves (nodes without children below it or itself), saved_tokens (over the
    nodes below it and itself: members but one, times words of the last turn), ends_sha256 (of the ids, ascending and
    joined by commas, of the members that have no further turn).

    Null roles and texts count as empty; rows without a conv_id are left out. Turns of one number stand in an order
    that their contents decide, repeated rows are turns of their own. A conversation without turns is a member of the
    root. Other columns are not read. Without conversations there is no node. A conversation is held as its turns' digests
    (24 bytes a turn), the texts are not kept; conversations that recur are dealt to several tasks by their ids.
    """
    runs = cut(_records(own).mapInArrow(_runs, "run long, place long, conv_id long, key binary, words array<long>, lcp long"))
    size = runs.agg(F.coalesce(F.sum(2 * F.length("key") + 100), F.lit(0))).first()[0]
    parts = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // task_bytes))
    dealt = runs.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("run", "place")
    nodes = cut(dealt.mapInArrow(_merge, _NODE))
    edges = nodes.where("part is not null").repartition(1).sortWithinPartitions("part", "place").mapInArrow(_joined_edges, _NODE)
    fields = ["node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    every = cut(nodes.where("part is null").select(*fields).unionByName(edges.select(*fields)))
    parents = every.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return every.join(parents, "parent", "left")
