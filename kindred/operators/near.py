"""The prefix-filter join of `match` over Arrow batches: keys of records, and what meets on a key compared in numpy.

A filter is a row of machine words, a bit for each rank, so the distance of two filters is a few words' AND and a count
of bits, and a pair's rarest common bits are the lowest ones of that AND.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Longest filters, in bits, that are compared as words.
NARROW = 1 << 12
#: Place of the second rank in a key of one rank.
ALONE = 2 * NARROW - 1
#: Records that get their keys together, pairs that are compared together.
ROWS, PAIRS = 512, 1 << 16
#: Records of one side that meet on a key in one tile, at about; tiles of a side at most, before they grow.
HOT, TILES = 1 << 14, 128

_RANK, _TILE = 13, 14
_LOW = (1 << _RANK) - 1
KEYED = "key bigint, side int, id bigint, n int, filter binary"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def parts(counts: np.ndarray) -> np.ndarray:
    """Parts that as many records fall into."""
    return np.clip(-(-counts // HOT), 1, TILES)


def words(shapes: dict[tuple[int, int], dict]) -> int:
    return max((len(shape["parts0"]) + 63) // 64 for shape in shapes.values())


def _filters(row: np.ndarray, rank: np.ndarray, n: int, width: int) -> np.ndarray:
    """(n, width) words of the ranks of each row; sorted by row and rank."""
    out = np.zeros(n * width, np.uint64)
    place = row * width + (rank >> 6)
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    out[place[starts]] = np.bitwise_or.reduceat(np.uint64(1) << (rank & 63).astype(np.uint64), starts)
    return out.reshape(n, width)


def _tiled(keys: np.ndarray, owner: np.ndarray, ids: np.ndarray, last: np.ndarray, shape: dict, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and owners with the tiles of frequent keys: no key has more records than its rarer bit, so those bits' counts
    say into how many parts each side falls. A record is in one part of its own side, and meets every part of the other."""
    own, other = (shape[f"parts{i}"][last] for i in (side, 1 - side))
    if own.max(initial=1) == 1 == other.max(initial=1):
        return keys, owner
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIX >> np.uint64(33)
    part = (mixed[owner] % own.astype(np.uint64)).astype(np.int64)
    each = np.repeat(np.arange(len(keys)), other)
    meets = np.arange(len(each)) - np.repeat(np.cumsum(other) - other, other)
    # A part of the first side is a row of tiles, one of the second a column.
    tile = part[each] * TILES + meets if side == 0 else meets * TILES + part[each]
    return keys[each] | tile << 2 * _RANK, owner[each]


def _packed(column: pa.Array, dtype, side: int) -> pa.Array:
    """Lists of numbers as bytes; a null number is none of the other side's."""
    column = column.fill_null([]) if column.null_count else column
    values = column.flatten()
    values = pc.fill_null(values, -1 - side) if values.null_count else values
    data = values.to_numpy(zero_copy_only=False).astype(dtype)
    offsets = (column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py()) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def keyed(df: DataFrame, shapes: dict[tuple[int, int], dict], side: int, signed: str | None = None) -> DataFrame:
    """df (id, bits, m, k[, signature]) by its keys, a row each. shapes: of each (m, k) its number `at`, the `rank` of every bit,
    `two` and `one`, the places of keys of two ranks and of one for each number of bits, and `parts0` and `parts1`, how
    many parts each side's records of a rank fall into. signed: the type of the signatures that go along."""
    width = words(shapes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                ids, bits = part.column("id").to_numpy(), part.column("bits")
                sizes = np.asarray(pc.list_value_length(bits)).astype(np.int64)
                flat = bits.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(ids)), sizes)
                m, k = (np.asarray(part.column(c).fill_null(-1)) for c in ("m", "k"))
                more = _packed(part.column("signature"), signed, side) if signed else None
                for (own_m, own_k), shape in shapes.items():
                    here = (m == own_m) & (k == own_k)
                    if not here.any():
                        continue
                    held = here[row]
                    code = np.sort(row[held] * NARROW + shape["rank"][flat[held]])
                    r, rank = code // NARROW, code % NARROW
                    starts = np.searchsorted(r, np.arange(len(ids)))
                    vectors = _filters(r, rank, len(ids), width)
                    keys, owners, lasts = [], [], []
                    for name, places in (("two", shape["two"]), ("one", shape["one"])):
                        most = np.where(here, places[np.minimum(sizes, len(places) - 1)], 0)
                        for p in np.unique(most[most > 0]).tolist():
                            own = np.flatnonzero(most == p)
                            first = rank[starts[own][:, None] + np.arange(p)]
                            x, y = np.triu_indices(p, 1) if name == "two" else (np.arange(p), None)
                            low, high = first[:, x], (first[:, y] if y is not None else np.int64(ALONE))
                            # Ranks grow with how often a bit occurs, so the first is the rarer one.
                            lasts.append(low.ravel())
                            keys.append((low << _RANK | high).ravel())
                            owners.append(np.repeat(own, len(x)))
                    if not keys:
                        continue
                    key, owner = np.concatenate(keys), np.concatenate(owners)
                    key, owner = _tiled(key, owner, ids, np.concatenate(lasts), shape, side)
                    key |= np.int64(shape["at"]) << (2 * _RANK + _TILE)
                    n = len(key)
                    filters = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * (8 * width)).tobytes()), pa.py_buffer(vectors[owner].tobytes())])
                    columns = [pa.array(key), pa.array(np.full(n, side, np.int32)), pa.array(ids[owner]), pa.array(sizes[owner].astype(np.int32)), filters]
                    if signed:
                        columns.append(more.take(pa.array(owner)))
                    out = pa.RecordBatch.from_arrays(columns, names=["key", "side", "id", "n", "filter", "signature"][: len(columns)])
                    for j in range(0, n, 1 << 13):
                        yield out.slice(j, 1 << 13)

    return df.mapInArrow(run, KEYED + (", signature binary" if signed else ""))


class _Rows:
    """Rows of keys as arrays."""

    def __init__(self, batch: pa.RecordBatch, width: int, signed: str | None):
        self.key, self.side, self.id, self.n = (batch.column(i).to_numpy() for i in range(4))
        self.filter = _bytes(batch.column(4)).view(np.uint64).reshape(-1, width)
        self.fold = np.bitwise_or.reduce(self.filter, 1)
        if signed:
            column = batch.column(5)
            lengths = np.asarray(pc.binary_length(column)).astype(np.int64) // np.dtype(signed).itemsize
            data, most = _bytes(column).view(signed), int(lengths.max(initial=0))
            if (lengths == most).all():
                self.signature = data.reshape(-1, most)
            else:
                self.signature = np.zeros((len(lengths), most), signed)
                self.signature[np.arange(most) < lengths[:, None]] = data
            self.places = lengths

    def joined(self, other: _Rows) -> _Rows:
        out = object.__new__(_Rows)
        for name, own in vars(self).items():
            its = getattr(other, name)
            if name == "signature" and own.shape[1] != its.shape[1]:
                most = max(own.shape[1], its.shape[1])
                own, its = (np.pad(x, ((0, 0), (0, most - x.shape[1]))) for x in (own, its))
            setattr(out, name, np.concatenate([own, its]))
        return out

    def at(self, rows: np.ndarray) -> _Rows:
        out = object.__new__(_Rows)
        for name, own in vars(self).items():
            setattr(out, name, own[rows])
        return out


def _bytes(column: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)


def _met(rows: _Rows, i: np.ndarray, j: np.ndarray, t: int, tau: float | None, paired: int, below: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """Which of the pairs of rows (i, j) match and have their rarest common bits in their key: i, j, distance[, similarity]."""
    near = np.bitwise_count(rows.fold[i] ^ rows.fold[j]) <= t
    i, j = i[near], j[near]
    n1, n2 = rows.n[i].astype(np.int64), rows.n[j].astype(np.int64)
    low, high = rows.key[i] >> _RANK & _LOW, rows.key[i] & _LOW
    alone = high == ALONE
    overlap = np.maximum(1, -((t - n1 - n2) // 2))
    by_two = (overlap >= 2) & (np.maximum(n1, n2) - overlap + 2 <= paired)
    ok = (np.abs(n1 - n2) <= t) & (alone != by_two)
    i, j, n1, n2 = i[ok], j[ok], n1[ok], n2[ok]
    common = rows.filter[i] & rows.filter[j]
    distance = n1 + n2 - 2 * np.bitwise_count(common).sum(1, dtype=np.int64)
    ok2 = distance <= t
    i, j, distance, common = i[ok2], j[ok2], distance[ok2], common[ok2]
    alone, low, high = (x[ok][ok2] for x in (alone, low, high))
    before = np.bitwise_count(common & below[np.where(alone, low, high)]).sum(1, dtype=np.int64)
    once = before == np.where(alone, 0, 1)
    i, j, distance = i[once], j[once], distance[once]
    if tau is None:
        return i, j, distance
    same, places, most = rows.places[i] == rows.places[j], rows.places[i], rows.signature.shape[1]
    equal = (rows.signature[i] == rows.signature[j]).sum(1, dtype=np.int64) - (most - places)
    similarity = np.where(same & (places > 0), equal / np.maximum(places, 1), 0.0)
    ok = similarity >= tau
    return i[ok], j[ok], distance[ok], similarity[ok]


def met(rows: DataFrame, width: int, t: int, tau: float | None, paired: int, signed: str | None) -> DataFrame:
    """(id1, id2, distance[, similarity]) of what meets on a key, each pair once; rows of a partition are in order of key and side.

    The first side's rows of a key come first, so they alone are kept while the second side's go by.
    """
    schema = "id1 bigint, id2 bigint, distance int" + (", similarity double" if signed else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = np.arange(64 * width)[:, None] - 64 * np.arange(width)
        below = np.where(ranks >= 64, ~np.uint64(0), (np.uint64(1) << np.clip(ranks, 0, 63).astype(np.uint64)) - np.uint64(1))
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = _Rows(batch, width, signed)
            held = held if carry is None else carry.joined(held)
            starts = np.flatnonzero(np.r_[True, held.key[1:] != held.key[:-1]])
            run_of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(held.key)]))
            firsts = np.bincount(run_of[held.side == 0], minlength=len(starts))
            seconds = np.flatnonzero((held.side == 1) & (firsts[run_of] > 0))
            counts = firsts[run_of[seconds]]
            ends = np.cumsum(counts)
            at = 0
            while at < len(seconds):
                done = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
                c = counts[at:stop]
                j = np.repeat(seconds[at:stop], c)
                i = np.repeat(starts[run_of[seconds[at:stop]]], c) + np.arange(len(j)) - np.repeat(np.cumsum(c) - c, c)
                i, j, distance, *more = _met(held, i, j, t, tau if signed else None, paired, below)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(held.id[i]), pa.array(held.id[j]), pa.array(distance.astype(np.int32)), *map(pa.array, more)], names=names)
                at = stop
            carry = held.at(np.flatnonzero((held.key == held.key[-1]) & (held.side == 0)))

    return rows.mapInArrow(run, schema)
