"""Removal of repeated byte strings by suffix arrays in shards.

A byte goes if it lies in a string of `length` bytes that also starts in a document of smaller id.

Which strings can repeat is found first: in every window of `length` bytes the 20-byte gram of least
hash is its anchor. Equal windows have equal anchors, so only anchors that occur in two documents
matter, and all windows of one anchor can meet in one shard. Shards hold the contexts (the bytes of
the windows) of their anchors: ranges of the anchor hash, of bounded size.

In a shard the distinct contexts form one text, or several of bounded size. For each, Larsson-Sadakane
refinement sorts its suffixes: by eight bytes, then by doubling, and only groups that are still tied.
Kasai's algorithm gives the common prefixes; it walks all contexts in step, so it is numpy throughout.
Neighbours with a common prefix of `length` bytes or more are one string, whose least document stays.
Texts of one shard are merged by binary search: each one's sorted strings are looked up in the others'.

What recurs is merged before it is sent. In a slice, equal contexts (by a hash, then by their bytes) send
one; and a task keeps the anchors and contexts that recurred in a slice, and sends no more of them. So a
passage that a third of all documents hold sends one context a task. In a shard, the contexts of all
tasks are sorted and made distinct, and each finds its place by binary search.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import sliced, text_or_empty
from kindred.llm.near_duplicates import _runs
from kindred.llm.shingles import mix

LENGTH, GRAM = 50, 20
#: Bytes of text that a task looks at together, and bytes of the corpus per shard.
SLICE_BYTES, SHARD_BYTES = 1 << 20, 6 << 20
#: Partitions of shards at most: beyond, a task walks several shards one after the other.
PARTS = 1 << 15
#: Bytes of contexts that are sorted together.
TEXT_BYTES = 4 << 20
#: Anchors and bytes of contexts that recurred in a slice, which a task keeps.
HOT_ANCHORS, HOT_BYTES = 1 << 18, 16 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_MAX = _U(0xFFFFFFFFFFFFFFFF)
_LEAST = -(2**63)


def _power(n: int) -> np.uint64:
    return _U(pow(int(_BASE), n, 1 << 64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place (GRAM = 16 + 4); the last GRAM - 1 places have the highest value."""
    n = len(data) - GRAM + 1
    out = np.full(len(data), _MAX)
    if n <= 0:
        return out
    h = data.astype(_U) + _U(1)
    for step in (1, 2, 4, 8):
        h = h[:-step] * _power(step) + h[step:]
        if step == 2:
            four = h
    out[:n] = np.minimum(mix(h[:n] * _power(4) + four[16 : 16 + n]), _MAX - _U(1))
    return out


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick over x[i : i + w] at each i with a full window."""
    got, n = x, 1
    while 2 * n <= w:
        got = pick(got[:-n], got[n:])
        n *= 2
    return pick(got[: len(x) - w + 1], got[w - n : w - n + len(x) - w + 1]) if w > n else got


def anchors(h: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Places whose gram has the least hash of some window that lies in one document. ends: ends of the documents in the text, separators included before the next."""
    w = length - GRAM + 1
    if len(h) < w:
        return np.zeros(0, np.int64)
    least = _sliding(h, w, np.minimum)
    starts = np.concatenate([[0], ends[:-1] + 1])
    ok = np.zeros(len(least) + 1, np.int32)
    fits = ends - length >= starts
    np.add.at(ok, starts[fits], 1)
    np.add.at(ok, np.minimum(ends[fits] - length + 1, len(least)), -1)
    least = np.where(np.cumsum(ok[:-1]) > 0, least, _U(0))
    padded = np.concatenate([np.zeros(w - 1, _U), least, np.zeros(w - 1, _U)])
    most = _sliding(padded, w, np.maximum)[: len(h)]
    return np.flatnonzero((most == h) & (h != _MAX) & (most > 0))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with a separator byte after each, and each one's end."""
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    return data, np.cumsum([len(t) + 1 for t in texts]) - 1


_ROW = "shard long, kind int, block long, a binary, b binary, c binary"
_ROW_SCHEMA = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
#: Kinds of rows: anchors of a block, places known to be shared, and the block's documents.
ANCHORS, KNOWN, TABLE = 0, 1, 2


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    s = shard[order]
    cuts = np.flatnonzero(s[1:] != s[:-1]) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(shard[part[0]]), part


def _find(length: int, shards: int):
    """Documents to anchors by shard, with one row that names the block's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        hot = np.zeros(0, _U)  # anchors that recurred in an earlier slice, which sent them
        for b in batches:
            for part in sliced(b, "text", SLICE_BYTES):
                data, ends = _joined(part.column("text").to_pylist())
                h = gram_hashes(data)
                at = anchors(h, ends, length)
                if not len(at):
                    continue
                value = mix(h[at])
                doc = np.searchsorted(ends, at)
                order = np.argsort(value, kind="stable")
                v, d = value[order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
                several = np.maximum.reduceat(d, first) != np.minimum.reduceat(d, first)
                counts = np.diff(np.append(first, len(v)))
                met = np.isin(v[first], hot)
                known = np.repeat(several | met, counts)
                # Places already met in two documents are told at once; of them one goes on for the others to meet.
                sent = ~known
                sent[first] = ~met
                if len(hot) < HOT_ANCHORS:
                    hot = np.concatenate([hot, v[first[several & ~met]]])
                rows = {"shard": [], "kind": [], "a": [], "b": [], "c": []}

                def add(shard, kind, a, b=b"", c=b"", rows=rows):
                    for k, x in zip(rows, (shard, kind, a, b, c), strict=True):
                        rows[k].append(x)

                place = at[order].astype("<u4")
                add(block % shards, TABLE, part.column("doc_id").to_numpy().tobytes(), part.column("dk").to_numpy().tobytes(), ends.astype("<u4").tobytes())
                if known.any():
                    add(block % shards, KNOWN, place[known].tobytes())
                v, p, k = v[sent], place[sent], known[sent]
                for s, i in _by_shard((v % _U(shards)).astype(np.int64)):
                    add(s, ANCHORS, (v[i] >> _U(32)).astype("<u4").tobytes(), p[i].tobytes(), np.packbits(k[i]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(rows["shard"], pa.int64()), pa.array(rows["kind"], pa.int32()), pa.array([block] * len(rows["kind"]), pa.int64()), *(pa.array(rows[k], pa.binary()) for k in "abc")], schema=_ROW_SCHEMA)
                block += 1

    return run


def _meet(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """A shard's anchors to places, by block, whose anchor two blocks or two documents hold; other rows go through."""
    kind = table.column("kind").to_numpy()
    through = table.filter(pa.array(kind != ANCHORS))
    yield from through.combine_chunks().to_batches()
    own = table.filter(pa.array(kind == ANCHORS))
    if not own.num_rows:
        return
    blocks = own.column("block").to_numpy()
    value = [np.frombuffer(x, "<u4") for x in own.column("a").to_pylist()]
    sizes = np.array([len(x) for x in value])
    place = np.concatenate([np.frombuffer(x, "<u4") for x in own.column("b").to_pylist()])
    known = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(own.column("c").to_pylist(), sizes.tolist(), strict=True)]).astype(bool)
    value, block = np.concatenate(value), np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(value, kind="stable")
    v, b = value[order], blocks[block[order]]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    shared = (np.maximum.reduceat(b, first) != np.minimum.reduceat(b, first)) | np.logical_or.reduceat(known[order], first)
    hit = np.empty(len(v), bool)
    hit[order] = np.repeat(shared, np.diff(np.append(first, len(v))))
    block, place = block[hit], place[hit]
    cuts = np.searchsorted(block, np.arange(len(sizes) + 1))
    found = np.flatnonzero(np.diff(cuts))
    shard = table.column("shard")[0].as_py()
    yield pa.RecordBatch.from_arrays(
        [pa.array([shard] * len(found), pa.int64()), pa.array([KNOWN] * len(found), pa.int32()), pa.array(blocks[found]), pa.array([place[cuts[i] : cuts[i + 1]].tobytes() for i in found], pa.binary()), pa.array([b""] * len(found), pa.binary()), pa.array([b""] * len(found), pa.binary())],
        schema=_ROW_SCHEMA,
    )


def _back(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """A block's shared places to (dk, places) of its documents."""
    kind = table.column("kind").to_pylist()
    a = table.column("a").to_pylist()
    head = kind.index(TABLE)
    dk = np.frombuffer(table.column("b")[head].as_py(), np.int64)
    ends = np.frombuffer(table.column("c")[head].as_py(), "<u4").astype(np.int64)
    place = np.unique(np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(x, "<u4") for x, k in zip(a, kind, strict=True) if k == KNOWN)])).astype(np.int64)
    doc = np.searchsorted(ends, place)
    starts = np.concatenate([[0], ends[:-1] + 1])
    cuts = np.searchsorted(doc, np.arange(len(ends) + 1))
    found = np.flatnonzero(np.diff(cuts))
    yield pa.RecordBatch.from_arrays([pa.array(dk[found]), pa.array([(place[cuts[i] : cuts[i + 1]] - starts[i]).astype("<u4").tobytes() for i in found], pa.binary())], names=["dk", "places"])


def _windows(h: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the windows whose leftmost least gram is at each place (empty if first > last)."""
    w = length - GRAM + 1
    own = h[at]
    lo, hi = np.maximum(at - w + 1, starts), np.minimum(at, ends - length)
    open_lo, open_hi = np.ones(len(at), bool), np.ones(len(at), bool)
    for d in range(1, w):
        left, right = at - d, np.minimum(at + d, len(h) - 1)
        stop = open_lo & (left >= starts) & (h[np.maximum(left, 0)] <= own)
        lo[stop] = np.maximum(lo[stop], left[stop] + 1)
        open_lo &= ~stop
        stop = open_hi & (at + d < ends) & (h[right] < own)
        hi[stop] = np.minimum(hi[stop], at[stop] + d - w)
        open_hi &= ~stop
    return lo, hi


#: Rows of a shard's second visit: contexts, and removed windows (mask of 31 starts from a place on).
CONTEXTS, REMOVED = 0, 1
_OUT = "shard long, kind int, dk long, a binary, b binary"
_OUT_SCHEMA = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("dk", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
_ENTRY = np.dtype([("doc_id", "<i8"), ("dk", "<i8"), ("place", "<u4"), ("size", "u1")])
_HIT = np.dtype([("place", "<u4"), ("mask", "<u8")])


def _told(dk: np.ndarray, place: np.ndarray, mask: np.ndarray, shard: int) -> pa.RecordBatch | None:
    """Removed windows as one row a document."""
    some = np.flatnonzero(mask)
    if not len(some):
        return None
    some = some[np.argsort(dk[some], kind="stable")]
    hits = np.empty(len(some), _HIT)
    hits["place"], hits["mask"] = place[some], mask[some]
    d = dk[some]
    cuts = [0, *(np.flatnonzero(d[1:] != d[:-1]) + 1).tolist(), len(d)]
    n = len(cuts) - 1
    return pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.array([REMOVED] * n, pa.int32()), pa.array(d[cuts[:-1]]), pa.array([hits[s:t].tobytes() for s, t in zip(cuts, cuts[1:], strict=False)], pa.binary()), pa.array([b""] * n, pa.binary())], schema=_OUT_SCHEMA)


def _bits(n: np.ndarray) -> np.ndarray:
    return (_U(1) << n.astype(_U)) - _U(1)


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the n bytes from each place a are the m bytes from b."""
    out = n == m
    for j in range(int(n.max()) if len(n) else 0):
        out &= (j >= n) | (data[np.minimum(a + j, len(data) - 1)] == data[np.minimum(b + j, len(data) - 1)])
    return out


def _cut_contexts(length: int, shards: int):
    """Documents with their shared places to contexts by shard; copies within the task are settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: dict[bytes, int] = {}  # contexts that recurred in an earlier slice, with the least document that was sent
        held = 0
        for b in batches:
            for part in sliced(b, "text", SLICE_BYTES):
                texts = part.column("text").to_pylist()
                data, ends = _joined(texts)
                starts = np.concatenate([[0], ends[:-1] + 1])
                places = [np.frombuffer(x, "<u4").astype(np.int64) for x in part.column("places").to_pylist()]
                doc = np.repeat(np.arange(len(texts)), [len(p) for p in places])
                at = np.concatenate(places) + starts[doc]
                h = gram_hashes(data)
                lo, hi = _windows(h, at, starts[doc], ends[doc], length)
                real = lo <= hi
                at, doc, lo, hi = at[real], doc[real], lo[real], hi[real]
                if not len(at):
                    continue
                ids, dk = part.column("doc_id").to_numpy()[doc], part.column("dk").to_numpy()[doc]
                size = hi - lo + length
                # Equal contexts: equal hash of their bytes, place of the anchor and size.
                sums = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * _powers(len(data)), dtype=_U)])
                content = (sums[hi + length] - sums[lo]) * _inverse_powers(len(data))[lo]
                key = mix(content) + mix(size.astype(_U) * _U(64) + (at - lo).astype(_U))
                order = np.lexsort((ids, key))
                k, i = key[order], ids[order]
                first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                counts = np.diff(np.append(first, len(k)))
                # Later ones of a group, if their bytes are those of its first; another context by the same hash goes on.
                lead = np.repeat(order[first], counts)
                later = np.zeros(len(k), bool)
                after = np.flatnonzero((i > np.repeat(i[first], counts)))
                later[order[after]] = _same_bytes(data, lo[order[after]], lo[lead[after]], size[order[after]], size[lead[after]])
                recurs = np.zeros(len(k), bool)
                recurs[order[first]] = counts > 1
                place = (lo - starts[doc]).astype("<u4")
                if (row := _told(dk[later], place[later], _bits(hi[later] - lo[later] + 1), 0)) is not None:
                    yield row
                kept = np.flatnonzero(~later)
                raw = data.tobytes()
                text = [raw[x:y] for x, y in zip(lo[kept].tolist(), (hi[kept] + length).tolist(), strict=True)]
                again = np.zeros(len(kept), bool)
                for n, (t, d, r) in enumerate(zip(text, ids[kept].tolist(), recurs[kept].tolist(), strict=True)):
                    sent = hot.get(t)
                    if sent is not None:
                        again[n] = d > sent
                        hot[t] = min(d, sent)
                    elif r and held < HOT_BYTES:
                        hot[t] = d
                        held += len(t) + 100
                if (row := _told(dk[kept[again]], place[kept[again]], _bits(hi[kept[again]] - lo[kept[again]] + 1), 0)) is not None:
                    yield row
                fresh = np.flatnonzero(~again)
                kept = kept[fresh]
                entry = np.empty(len(kept), _ENTRY)
                entry["doc_id"], entry["dk"], entry["place"], entry["size"] = ids[kept], dk[kept], place[kept], size[kept]
                # Shards are told apart by other bits than in the first visit, where the low ones were used up.
                for s, j in _by_shard((mix(h[at[kept]]) % _U(shards)).astype(np.int64)):
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([CONTEXTS], pa.int32()), pa.array([0], pa.int64()), pa.array([entry[j].tobytes()], pa.binary()), pa.array([b"".join([text[x] for x in fresh[j].tolist()])], pa.binary())], schema=_OUT_SCHEMA)

    return run


_tables: dict[str, np.ndarray] = {}


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_tables.get(name, ())) < n:
        p = np.full(1 << max(16, int(n).bit_length()), base)
        p[0] = 1
        _tables[name] = np.cumprod(p, dtype=_U)
    return _tables[name][:n]


def _powers(n: int) -> np.ndarray:
    return _power_table("up", _BASE, n)


def _inverse_powers(n: int) -> np.ndarray:
    return _power_table("down", _U(pow(int(_BASE), -1, 1 << 64)), n)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The suffixes of contexts that each end in a 0 byte, in order, by Larsson-Sadakane refinement.

    A suffix ends with its context; equal ones stand in order of their contexts, so the order is total
    and Kasai's inequality holds. Suffixes that agree so far share a rank: the place of their group's
    first member. Each round looks only at groups that are still tied, by the ranks as many bytes
    further on as are sorted already.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key, going = np.zeros(n, _U), np.ones(n, bool)
    for j in range(8):
        byte = padded[j : j + n]
        key = (key << _U(8)) | np.where(going, byte, 0).astype(_U)
        going &= byte != 0
    sa = np.argsort(key)
    k = key[sa]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    sizes = np.diff(np.append(head, n))
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(head, sizes)
    tied = np.repeat(sizes > 1, sizes)
    h = 0
    while True:
        slot = np.flatnonzero(tied)
        if not len(slot):
            return sa
        at = sa[slot]
        # First, those that ended within eight bytes are told apart by place; all later ties go on beyond h.
        further = rank[np.minimum(at + h, n - 1)] if h else np.where(going[at], 0, at)
        both = (rank[at] << 32) | further  # a shard is far below 2**31 bytes
        order = np.argsort(both)
        at, both = at[order], both[order]
        sa[slot] = at
        head = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        sizes = np.diff(np.append(head, len(at)))
        rank[at] = np.repeat(slot[head], sizes)
        tied = np.zeros(n, bool)
        tied[slot] = np.repeat(sizes > 1, sizes)
        h = 2 * h or 8


def common_prefixes(data: np.ndarray, sa: np.ndarray, starts: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Kasai's algorithm: for each slot of `sa` the common prefix with the slot before, up to `most`, at the first counts[c] places of each context; 0 elsewhere.

    The contexts are walked in step: what a place has in common, less one, its next place has at least.
    """
    n = len(data)
    slot = np.empty(n, np.int64)
    slot[sa] = np.arange(n)
    padded = np.concatenate([data, np.zeros(most + 1, np.uint8)])
    out = np.zeros(n, np.int64)
    h = np.zeros(len(starts), np.int64)
    for t in range(int(counts.max()) if len(counts) else 0):
        lane = np.flatnonzero(counts > t)
        i = starts[lane] + t
        r = slot[i]
        j = sa[np.maximum(r - 1, 0)]
        got = np.maximum(h[lane] - 1, 0)
        open_ = np.flatnonzero((r > 0) & (got < most))
        while len(open_):
            x, y, g = i[open_], j[open_], got[open_]
            same = (padded[x + g] == padded[y + g]) & (padded[x + g] != 0) & (y + g < n)
            open_ = open_[same]
            got[open_] += 1
            open_ = open_[got[open_] < most]
        got[r == 0] = 0
        h[lane] = got
        out[r] = got
    return out


def sorted_strings(contexts: list[bytes], documents: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(strings, least, which): the distinct strings of `length` bytes in order, the least document of each, and for each
    context and window which string it is (-1 beyond a context's last window).

    A context ends in a 0 byte, so it must not hold one; `_least_by_zeros` sees to those that do.
    """
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    counts = sizes - length + 1
    sa = suffix_array(data)
    common = common_prefixes(data, sa, starts, counts, length)
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)[sa]
    offset = sa - starts[owner]
    # Suffixes shorter than a string stand among the windows; they belong to none, and begin no string.
    window = np.flatnonzero(offset < counts[owner])
    new = np.zeros(len(sa), bool)
    new[common < length] = True
    number = np.cumsum(new)[window]
    head = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    which = np.full((len(contexts), int(counts.max())), -1, np.int64)
    which[owner[window], offset[window]] = np.cumsum(np.concatenate([[0], number[1:] != number[:-1]]))
    first = sa[window[head]]
    strings = np.lib.stride_tricks.sliding_window_view(data, length)[first]
    return np.ascontiguousarray(strings).view(f"S{length}").ravel(), np.minimum.reduceat(documents[owner[window]], head), which


def merge_least(parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Merge texts' sorted strings: what several hold gets the least document of all, found by binary search in one another."""
    for j, (theirs, other) in enumerate(parts):
        for strings, least in parts[:j]:
            at = np.searchsorted(strings, theirs)
            at[at == len(strings)] = 0
            same = np.flatnonzero(strings[at] == theirs)
            low = np.minimum(least[at[same]], other[same])
            least[at[same]], other[same] = low, low


def least_documents(contexts: list[bytes], documents: np.ndarray, length: int, most: int = TEXT_BYTES) -> np.ndarray:
    """(contexts, windows): for each distinct context and window the least document that holds the window's string.

    Contexts are sorted in texts of about `most` bytes, and the texts merged.
    """
    text = np.cumsum([len(c) + 1 for c in contexts]) // most
    cuts = [0, *(np.flatnonzero(text[1:] != text[:-1]) + 1).tolist(), len(contexts)]
    made = [sorted_strings(contexts[s:t], documents[s:t], length) for s, t in zip(cuts, cuts[1:], strict=False)]
    merge_least([(strings, least) for strings, least, _ in made])
    out = np.full((len(contexts), max(len(c) for c in contexts) - length + 1), np.iinfo(np.int64).max)
    for s, (_, least, which) in zip(cuts, made, strict=False):
        row, column = np.nonzero(which >= 0)
        out[s + row, column] = least[which[row, column]]
    return out


def _settle(length: int):
    """A shard's contexts to the removed windows of their documents; rows of removed windows go through."""

    def of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        kind = table.column("kind").to_numpy()
        yield from table.filter(pa.array(kind == REMOVED)).combine_chunks().to_batches()
        own = table.filter(pa.array(kind == CONTEXTS))
        if not own.num_rows:
            return
        entry = np.concatenate([np.frombuffer(x, _ENTRY) for x in own.column("a").to_pylist()])
        raw = b"".join(own.column("b").to_pylist())
        ends = np.cumsum(entry["size"].astype(np.int64))
        texts = [raw[s:t] for s, t in zip((ends - entry["size"]).tolist(), ends.tolist(), strict=True)]
        # Sorted distinct contexts of all tasks; each entry finds its own among them by binary search.
        distinct, which = _merge(texts)
        least_doc = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least_doc, which, entry["doc_id"])
        least = _least_by_zeros(distinct, least_doc, length)
        gone = least[which] < entry["doc_id"][:, None]
        mask = (gone.astype(_U) << np.arange(gone.shape[1], dtype=_U)).sum(1, dtype=_U)
        if (row := _told(entry["dk"], entry["place"], mask, 0)) is not None:
            yield row

    return of


def _merge(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The sorted distinct contexts of all tasks, and each context's place among them, by binary search."""
    distinct = sorted(set(texts))
    return distinct, np.fromiter((bisect_left(distinct, t) for t in texts), np.int64, len(texts))


def _least_by_zeros(contexts: list[bytes], documents: np.ndarray, length: int) -> np.ndarray:
    """least_documents, with contexts that hold a 0 byte compared window by window (0 ends a context in the shard's text)."""
    odd = np.array([b"\0" in c for c in contexts])
    width = max(len(c) for c in contexts) - length + 1
    out = np.full((len(contexts), width), np.iinfo(np.int64).max)
    plain = np.flatnonzero(~odd)
    if len(plain):
        got = least_documents([contexts[i] for i in plain], documents[plain], length)
        out[plain, : got.shape[1]] = got
    held: dict[bytes, int] = {}
    for i in np.flatnonzero(odd).tolist():
        for s in range(len(contexts[i]) - length + 1):
            w = contexts[i][s : s + length]
            held[w] = min(held.get(w, documents[i]), documents[i])
    for i in np.flatnonzero(odd).tolist():
        for s in range(len(contexts[i]) - length + 1):
            w = contexts[i][s : s + length]
            # A window without a 0 may also lie in a plain context: those are searched too.
            out[i, s] = held[w]
    if odd.any():
        wanted = {w: d for w, d in held.items() if b"\0" not in w}
        seen: dict[bytes, list[tuple[int, int]]] = {}
        for i in plain.tolist() if wanted else ():
            for s in range(len(contexts[i]) - length + 1):
                w = contexts[i][s : s + length]
                if w in wanted:
                    seen.setdefault(w, []).append((i, s))
        for w, places in seen.items():
            low = min(wanted[w], *(int(documents[i]) for i, _ in places))
            for i, s in places:
                out[i, s] = min(out[i, s], low)
            wanted[w] = low
        for i in np.flatnonzero(odd).tolist() if seen else ():
            for s in range(len(contexts[i]) - length + 1):
                w = contexts[i][s : s + length]
                if w in seen:
                    out[i, s] = wanted[w]
    return out


def covered(n: int, hits: list[bytes], length: int) -> np.ndarray:
    """Which of n bytes the removed windows cover."""
    edge = np.zeros(n + 1, np.int32)
    found = np.frombuffer(b"".join(hits), _HIT)
    if len(found):
        bits = (found["mask"][:, None] >> np.arange(64, dtype=_U)) & _U(1)
        which, offset = np.nonzero(bits)
        start = np.unique(found["place"][which].astype(np.int64) + offset)
        edge[start] += 1
        np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def removed_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, kept_sha256) of every row.

    Texts are UTF-8 bytes, null as empty; matches never cross documents. Removed is each byte of a
    string of `length` bytes that also starts in a row of smaller doc_id, judged on the input. Rows of
    one doc_id don't remove from one another. A null doc_id stands below all ids. Texts shorter than
    `length` stay whole; a long text is looked at as a whole, in one slice of its own. An empty table
    gives an empty result; other columns are left aside.
    """
    if not GRAM < length <= GRAM + 63:
        raise ValueError(f"length must be in {GRAM + 1} to {GRAM + 63}")
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc_id"), text_or_empty().cast("binary").alias("text")).withColumn("dk", F.xxhash64("doc_id", "text"))
    total = own.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    shards = max(16, -(-total // SHARD_BYTES))
    parts = min(shards, PARTS)
    # Exact copies: all but the least id go whole, and send nothing.
    keys = own.select("doc_id", "dk", F.md5("text").alias("m"), F.octet_length("text").alias("n"))
    firsts = keys.groupBy("m", "n").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("m", "n", "first")
    copies = keys.join(firsts, ["m", "n"]).where(F.col("doc_id") > F.col("first")).select("dk", F.lit(True).alias("copy")).distinct()
    # Anchors that two documents share.
    long_enough = own.where(F.octet_length("text") >= length)
    met = long_enough.mapInArrow(_find(length, shards), _ROW).repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(_runs(_meet, ["shard"]), _ROW)
    shared = met.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_runs(_back, ["block"]), "dk long, places binary").dropDuplicates(["dk"])
    # Their contexts, settled shard by shard.
    asked = own.join(shared.join(copies, "dk", "left_anti"), "dk").select("doc_id", "dk", "text", "places")
    settled = asked.mapInArrow(_cut_contexts(length, shards), _OUT).repartition(parts, F.when(F.col("kind") == CONTEXTS, F.col("shard")).otherwise(F.pmod("dk", F.lit(shards))))
    hits = settled.sortWithinPartitions("shard").mapInArrow(_runs(_settle(length), ["shard"]), _OUT).groupBy("dk").agg(F.collect_list("a").alias("hits"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in sliced(b, "text", SLICE_BYTES):
                rows = {f.name: [] for f in schema}
                for i, text, copy, found in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "copy", "hits")), strict=True):
                    n = len(text)
                    if copy and n >= length:
                        removed, spans, kept = n, 1, b""
                    elif found:
                        gone = covered(n, found, length)
                        removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    else:
                        removed, spans, kept = 0, 0, text
                    for k, x in zip(rows, (None if i == _LEAST else i, n, removed, spans, kept, hashlib.sha256(kept).hexdigest()), strict=True):
                        rows[k].append(x)
                yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)

    judged = own.join(copies, "dk", "left").join(hits, "dk", "left").select("doc_id", "text", "copy", "hits")
    return judged.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
