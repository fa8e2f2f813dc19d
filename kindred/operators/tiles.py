"""Pairs of members by tiles: a tile holds a part of each side's members, once for all of its pairs of classes, so what is
shuffled are members and pairs of classes, never lists of members a pair, and pairs of members are made by the task that
reads them.

A class of more than `HELD` members falls into parts, and a pair of classes into pairs of parts: no tile is left with all
pairs of one large class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Members of a part of a class, at about.
HELD = 1024

#: Members of a side that one tile holds, pairs of members that it makes, at about, and those that are handled together.
MEMBERS, TILE, PAIRS = 1 << 17, 1 << 26, 1 << 16

#: What a row of a tile is: a member of the first side, one of the second, or a pair of parts.
_FIRST, _SECOND, _PAIR = range(3)

_TOP = np.uint64(1 << 63)


def per_side(first: DataFrame, second: DataFrame, pairs: int = 0) -> int:
    """How many parts each side's members are dealt to, so that a tile holds bounded members, makes about TILE pairs of members
    if their number is known, and all cores get tiles."""
    cores = 2 * first.sparkSession.sparkContext.defaultParallelism
    members = max(first.count(), second.count())
    return max(-(-members // MEMBERS), int(np.ceil(np.sqrt(max(cores, -(-pairs // TILE))))))


def _parts(weight: str) -> Column:
    return F.ceil(F.col(weight) / HELD).cast("int")


def _place(id_: Column, part: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(id_, part), F.lit(n)).cast("int")


def _members(members: DataFrame, n: int, side: int) -> DataFrame:
    """The members of one side, a row for each of its tiles."""
    part = F.pmod(F.xxhash64("member"), _parts("weight")).cast("int")
    own = members.select("id", part.alias("part"), F.col("member").cast("string").alias("member"))
    placed = own.withColumn("at", _place(F.col("id"), F.col("part"), n)).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    row, column = ("at", "other") if side == _FIRST else ("other", "at")
    none = F.lit(0)
    return placed.select((F.col(row) * n + F.col(column)).alias("tile"), F.lit(side).alias("kind"), "id", "part", none.cast("bigint").alias("id2"), none.alias("part2"), "member")


def tiled(pairs: DataFrame, first: DataFrame, second: DataFrame, n: int) -> DataFrame:
    """Rows (tile, kind, id, part, id2, part2, member, ...) in order of tile and kind within partitions, a tile in one of them:
    the members (member, id, weight) of both sides, then the pairs of parts of the classes' pairs (id1, id2, w1, w2, ...)."""
    more = [c for c in pairs.columns if c not in ("id1", "id2", "w1", "w2")]
    each = lambda w: F.explode(F.sequence(F.lit(0), _parts(w) - 1))
    parted = pairs.select("id1", "id2", "w2", *more, each("w1").alias("p1")).select("id1", "id2", "p1", *more, each("w2").alias("p2"))
    tile = _place(F.col("id1"), F.col("p1"), n) * n + _place(F.col("id2"), F.col("p2"), n)
    met = parted.select(tile.alias("tile"), F.lit(_PAIR).alias("kind"), F.col("id1").alias("id"), F.col("p1").alias("part"), "id2", F.col("p2").alias("part2"), F.lit(None).cast("string").alias("member"), *more)
    own = _members(first, n, _FIRST).unionByName(_members(second, n, _SECOND))
    rows = own.unionByName(met, allowMissingColumns=True)
    return rows.repartition(n * n, "tile").sortWithinPartitions("tile", "kind")


class _Side:
    """One side's members in a tile, those of a part side by side."""

    def __init__(self, ids: list[np.ndarray], parts: list[np.ndarray], members: list[list[str]]):
        ids, parts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, parts))
        order = np.lexsort((parts, ids))
        flat = [m for held in members for m in held]
        self.members = [flat[i] for i in order.tolist()]
        ids, parts = ids[order], parts[order]
        self.starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (parts[1:] != parts[:-1])]) if len(ids) else np.zeros(0, np.int64)
        self.sizes = np.diff(np.r_[self.starts, len(ids)])
        self.keys = {k: i for i, k in enumerate(zip(ids[self.starts].tolist(), parts[self.starts].tolist(), strict=True))}

    def found(self, ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
        get = self.keys.get
        return np.fromiter((get(k, -1) for k in zip(ids.tolist(), parts.tolist(), strict=True)), np.int64, len(ids))


def _made(first: _Side, second: _Side, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of members that pairs of parts (a, b) make, some at a time: the pair's place, and those of both members."""
    n1, n2, s1, s2 = first.sizes[a], second.sizes[b], first.starts[a], second.starts[b]
    counts = n1 * n2
    ends, at = np.cumsum(counts), 0
    while at < len(a):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        c = counts[at:stop]
        pair = np.repeat(np.arange(at, stop), c)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(c) - c, c)
        yield pair, s1[pair] + k // n2[pair], s2[pair] + k % n2[pair]
        at = stop


def _walked(batches: Iterator[pa.RecordBatch], tile_of: Callable) -> Iterator[pa.RecordBatch]:
    """The rows of every tile. tile_of(first, second) makes a tile's state: its taken(pairs, pair, i, j) gets rows of pairs of
    parts, places of them, and of both members of as many pairs, its ended() comes last; both give batches."""
    held, number, tile = [([], [], []), ([], [], [])], None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        tiles, kinds = batch.column("tile").to_numpy(), batch.column("kind").to_numpy()
        change = np.flatnonzero(np.r_[True, (tiles[1:] != tiles[:-1]) | (kinds[1:] != kinds[:-1])]).tolist()
        for lo, hi in zip(change, [*change[1:], batch.num_rows], strict=True):
            if tiles[lo] != number:
                if tile is not None:
                    yield from tile.ended()
                held, number, tile = [([], [], []), ([], [], [])], tiles[lo], None
            part = batch.slice(lo, hi - lo)
            ids, parts = part.column("id").to_numpy(), part.column("part").to_numpy()
            if kinds[lo] != _PAIR:
                for own, x in zip(held[kinds[lo]], (ids, parts, part.column("member").to_pylist()), strict=True):
                    own.append(x)
                continue
            if tile is None:
                first, second = (_Side(*x) for x in held)
                tile = tile_of(first, second)
            a, b = first.found(ids, parts), second.found(part.column("id2").to_numpy(), part.column("part2").to_numpy())
            some = np.flatnonzero((a >= 0) & (b >= 0))
            for pair, i, j in _made(first, second, a[some], b[some]):
                yield from tile.taken(part, some[pair], i, j)
    if tile is not None:
        yield from tile.ended()


class _Best:
    """The best partner of each member of a side: by priority, then by the partner's id."""

    def __init__(self, own: _Side, other: _Side):
        n = len(own.members)
        self.p, self.rank = np.zeros(n, np.uint64), np.full(n, -1, np.int64)
        self.order = sorted(range(len(other.members)), key=other.members.__getitem__)
        self.rank_of = np.empty(len(self.order), np.int64)
        self.rank_of[self.order] = np.arange(len(self.order))

    def take(self, own: np.ndarray, other: np.ndarray, p: np.ndarray) -> None:
        before = self.p[own]
        some = p >= before
        own, other, p = own[some], other[some], p[some]
        np.maximum.at(self.p, own, p)
        top = self.p[own]
        self.rank[own[top > before[some]]] = -1
        best = p == top
        np.maximum.at(self.rank, own[best], self.rank_of[other[best]])


class _Bests:
    """A tile's best pairs of each member of either side."""

    def __init__(self, first: _Side, second: _Side, symmetric: bool):
        self.sides, self.best, self.symmetric = (first, second), (_Best(first, second), _Best(second, first)), symmetric
        self.heads, self.tails = [f"{m}|".encode() for m in first.members], [m.encode() for m in second.members]

    def priorities(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """`assign.priority` of pairs as numbers: the first eight bytes of SHA-256 of 'local|peer', the least one first."""
        if self.symmetric:
            (one, two), own = (side.members for side in self.sides), zip(i.tolist(), j.tolist(), strict=True)
            texts = [f"{a}|{b}" if a <= b else f"{b}|{a}" for a, b in ((one[x], two[y]) for x, y in own)]
            digests = [sha256(x.encode()).digest() for x in texts]
        else:
            heads, tails = self.heads, self.tails
            digests = [sha256(heads[x] + tails[y]).digest() for x, y in zip(i.tolist(), j.tolist(), strict=True)]
        return np.frombuffer(b"".join(digests), "<u8")[::4]

    def taken(self, _: pa.RecordBatch, __: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple:
        p = self.priorities(i, j)
        self.best[0].take(i, j, p)
        self.best[1].take(j, i, p)
        return ()

    def ended(self) -> Iterator[pa.RecordBatch]:
        for side, best in enumerate(self.best):
            own = np.flatnonzero(best.rank >= 0)
            members, others = self.sides[side].members, self.sides[1 - side].members
            for at in range(0, len(own), 1 << 13):
                part = own[at : at + (1 << 13)].tolist()
                p = (best.p[part] ^ _TOP).view(np.int64)  # in order as signed numbers
                names = [[members[x] for x in part], [others[best.order[best.rank[x]]] for x in part]]
                yield pa.RecordBatch.from_arrays([pa.array([side] * len(part), pa.int32()), pa.array(names[0]), pa.array(p), pa.array(names[1])], names=["side", "own", "p", "other"])


def best_of_both(pairs: DataFrame, first: DataFrame, second: DataFrame, n: int, symmetric: bool = False) -> DataFrame:
    """(id1, id2) of the pairs of members that are the best of both, by `assign.priority`, among all that pairs of classes (id1, id2,
    w1, w2) stand for. A tile keeps a best pair of each of its members, and no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _walked(batches, lambda a, b: _Bests(a, b, symmetric))

    found = tiled(pairs.select("id1", "id2", "w1", "w2"), first, second, n).mapInArrow(run, "side int, own string, p bigint, other string")
    best = found.groupBy("side", "own").agg(F.max(F.struct("p", "other")).alias("top"))
    # A pair that is the best of both its ids comes from either side.
    low, high = F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("top.other")), F.when(F.col("side") == 0, F.col("top.other")).otherwise(F.col("own"))
    both = best.select(low.alias("id1"), high.alias("id2")).groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("_n"))
    return both.where("_n = 2").select("id1", "id2")


class _Members:
    """A tile's pairs of members with their pair of classes' other columns."""

    def __init__(self, first: _Side, second: _Side, more: list[str], within: bool):
        self.members, self.more, self.within = tuple(pa.array(side.members, pa.string()) for side in (first, second)), more, within
        if within:
            every = {m: i for i, m in enumerate(sorted({*first.members, *second.members}))}
            self.ranks = tuple(np.array([every[m] for m in side.members], np.int64) for side in (first, second))

    def taken(self, pairs: pa.RecordBatch, pair: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = self.members
        if self.within:
            # The lesser member is first; a class with itself gives each pair of different members once.
            lesser = self.ranks[0][i] < self.ranks[1][j]
            kept = lesser | (pairs.column("id").to_numpy()[pair] != pairs.column("id2").to_numpy()[pair])
            pair, i, j, lesser = pair[kept], i[kept], j[kept], lesser[kept]
            one, two = a.take(pa.array(i)), b.take(pa.array(j))
            swap = pa.array(lesser)
            names = [pc.if_else(swap, one, two), pc.if_else(swap, two, one)]
        else:
            names = [a.take(pa.array(i)), b.take(pa.array(j))]
        rest = [pairs.column(c).take(pa.array(pair)) for c in self.more]
        made = pa.RecordBatch.from_arrays([*names, *rest], names=["id1", "id2", *self.more])
        for at in range(0, made.num_rows, 1 << 15):
            yield made.slice(at, 1 << 15)

    def ended(self) -> tuple:
        return ()


def pairs_of_members(pairs: DataFrame, first: DataFrame, second: DataFrame, n: int, within: bool = False) -> DataFrame:
    """(id1, id2, ...): all pairs of members that pairs of classes (id1, id2, w1, w2, ...) stand for."""
    more = [c for c in pairs.columns if c not in ("id1", "id2", "w1", "w2")]
    schema = StructType([StructField("id1", StringType()), StructField("id2", StringType()), *[pairs.schema[c] for c in more]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _walked(batches, lambda a, b: _Members(a, b, more, within))

    return tiled(pairs, first, second, n).mapInArrow(run, schema)
