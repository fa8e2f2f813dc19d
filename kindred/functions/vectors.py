"""Bloom filters and signatures of many records at once, in numpy over Arrow batches.

The same definitions as in `sketch`, which stays the form for single expressions: a lambda expression
takes about a microsecond a byte and hash function, numpy a few nanoseconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from kindred.functions.sketch import PRIME, coefficients

_BASIS, _FACTOR = np.uint64(14695981039346656037), np.uint64(1099511628211)
#: Rows handled together, and bits whose signatures are taken together.
ROWS, BITS = 2048, 1 << 14
#: Values of all bits that are computed ahead at most, and records whose signatures are then taken together.
TABLE, BLOCK = 1 << 21, 256


def _fnv(h: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """FNV-1a going on from h (values x k) over each value's bytes; values in order of descending length."""
    active = len(lengths)
    for j in range(int(lengths[0]) if active else 0):
        while lengths[active - 1] <= j:
            active -= 1
        byte = data[starts[:active] + j].astype(np.uint64)
        h[:active] = (h[:active] ^ byte[:, None]) * _FACTOR
    return h


def indices(values: list[str], m: int, k: int) -> np.ndarray:
    """(len(values), k): the bits that each value sets."""
    coded = [v.encode() for v in values]
    lengths = np.array([len(c) for c in coded], np.int64)
    order = np.argsort(-lengths, kind="stable")
    data = np.frombuffer(b"".join(coded) + b"\0", np.uint8)
    starts, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
    seed = _fnv(np.full((len(values), 1), _BASIS), data, starts, lengths)
    h = np.full((len(values), k), _BASIS)
    mixed = seed ^ np.arange(k, dtype=np.uint64)
    for j in range(8):
        h = (h ^ ((mixed >> np.uint64(8 * j)) & np.uint64(255))) * _FACTOR
    out = np.empty((len(values), k), np.int32)
    out[order] = (_fnv(h, data, starts, lengths) % np.uint64(m)).astype(np.int32)
    return out


def bits(values: list[list[str]], m: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(all set bits, ends): each record's sorted distinct bits, and where they end."""
    counts = np.array([len(v) for v in values], np.int64)
    flat = [x for v in values for x in v]
    if not flat:
        return np.zeros(0, np.int64), np.zeros(len(values), np.int64)
    distinct = list(dict.fromkeys(flat))
    place = {v: i for i, v in enumerate(distinct)}
    hit = indices(distinct, m, k)[np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))]
    row = np.repeat(np.arange(len(values)), counts * k)
    key = np.unique(row * m + hit.ravel())
    return key % m, np.searchsorted(key // m, np.arange(len(values)), side="right")


@lru_cache(maxsize=4)
def _hashes(m: int, pairs: tuple[tuple[int, int], ...]) -> np.ndarray:
    """(m, len(pairs)): (a x + b) mod p of every bit x; below p, so 32 bits hold them."""
    a, b = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    return ((np.arange(m)[:, None] * a + b) % PRIME).astype(np.int32)


def signatures(set_bits: np.ndarray, ends: np.ndarray, pairs: tuple[tuple[int, int], ...], m: int | None = None) -> np.ndarray:
    """(records, len(pairs)) least values of (a x + b) mod p over each record's bits; p for a record without bits.

    m: all bits are below it. Then, unless that takes too much, each bit's values are computed once and looked up.
    """
    starts = np.concatenate([[0], ends[:-1]])
    if m is not None and m * len(pairs) <= TABLE:
        table, counts = _hashes(m, pairs), ends - starts
        order = np.argsort(-counts, kind="stable")
        out = np.full((len(ends), len(pairs)), PRIME, np.int64)
        for i in range(0, len(order), BLOCK):
            own = order[i : i + BLOCK]
            n, at = counts[own], starts[own]
            least = np.full((len(own), len(pairs)), PRIME, np.int32)
            # The j-th bit of all records that have one, those with most bits first.
            for j in range(int(n[0])):
                k = int(np.searchsorted(-n, -j, side="left"))
                np.minimum(least[:k], table[set_bits[at[:k] + j]], out=least[:k])
            out[own] = least
        return out
    a, b = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    out = np.full((len(ends), len(pairs)), PRIME, np.int64)
    some = np.flatnonzero(ends > starts)
    at = 0
    while at < len(some):
        stop = max(at + 1, int(np.searchsorted(ends[some], starts[some[at]] + BITS, side="right")))
        own = some[at:stop]
        lo, hi = starts[own[0]], ends[own[-1]]
        values = (set_bits[lo:hi, None] * a + b) % PRIME
        out[own] = np.minimum.reduceat(values, starts[own] - lo, axis=0)
        at = stop
    return out


def sketched(df: DataFrame, values: str, m: int, k: int, s: int, seed: str) -> DataFrame:
    """df with bits array<int> and signature array<bigint> of the strings in its array column `values`."""
    names, at = df.columns, df.columns.index(values)
    pairs = coefficients(s, seed)
    schema = StructType([*df.schema.fields]).add("bits", ArrayType(IntegerType())).add("signature", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                own, ends = bits(part.column(at).to_pylist(), m, k)
                sig = signatures(own, ends, pairs, m)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(own.astype(np.int32))), pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1, dtype=np.int32) * s), pa.array(sig.ravel()))],
                    names=[*names, "bits", "signature"],
                )

    return df.mapInArrow(run, schema)
