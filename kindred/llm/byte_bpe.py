"""Byte-level BPE by numpy matrices: ids of whole texts from a file of ranks, and the texts back from the ids.

A pattern cuts a text into pieces. Distinct pieces of many texts are encoded together: those of one length
in bytes are the rows of one matrix of ids, beside it the ranks of each two neighbours. In a round every row
merges its leftmost pair of least rank, which takes one place from each row, so the matrix is compacted to
one column less; rows without a pair in the ranks leave it. A pair's rank is looked up in a hash table of
arrays. Pieces longer than `LONG` bytes merge all places of their least pair in a round, as far as one merge
after the other would do the same.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from kindred.llm.common import sliced, text_or_empty
from kindred.llm.pieces import LONG_CHARS, safe_cuts

#: Bytes of text whose pieces are encoded at once; pieces of more bytes are merged one by one.
SLICE_BYTES, LONG = 4 << 20, 256

#: Words kept for the next texts, and their bytes; beyond either they are forgotten.
KEPT_WORDS, KEPT_BYTES = 1 << 19, 32 << 20

#: Cells of one matrix.
CELLS = 1 << 20

NONE = np.int32(2**31 - 1)


def default_ranks() -> tuple[str, str]:
    """(file, pattern)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _ranges(own: set[str]) -> str:
    """A character class' inside for the given characters."""
    at = np.array(sorted(map(ord, own)))
    ends = np.flatnonzero(np.diff(at, append=-1) != 1)
    return "".join(rf"\U{s:08x}-\U{t:08x}" for s, t in zip(at[np.concatenate([[0], ends[:-1] + 1])].tolist(), at[ends].tolist(), strict=True))


def library_pattern(pattern: str) -> re.Pattern:
    r"""`pattern` with \s, \S and each \p{..} (no \S inside brackets) as the library's version of Unicode has them, spelt out: Python's differs."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    single = {bytes([i]): i for i in range(256)}

    @lru_cache
    def inside(name: str) -> str:
        return _ranges(set(bytes(tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()))

    named = r"\\s|\\p\{\w+\}"

    def spelt(m: re.Match) -> str:
        if m[0][0] == "[":
            return re.sub(named, lambda n: inside(n[0]), m[0])
        return rf"[^{inside(r'\s')}]" if m[0] == r"\S" else f"[{inside(m[0])}]"

    return re.compile(re.sub(rf"\[(?:\\.|[^\]\\])+\]|\\S|{named}", spelt, pattern))


def _gathered(ids: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of ids at each place, one after the other, and where each begins and the last ends."""
    n = sizes[place]
    ends = np.concatenate([[0], np.cumsum(n)])
    return ids[np.repeat((np.cumsum(sizes) - sizes)[place] - ends[:-1], n) + np.arange(ends[-1])], ends


class PairTable:
    """The id that two neighbouring ids merge to, in a hash table with open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        self.bits = max(4, int(2 * len(found)).bit_length())
        self.keys, self.merged = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        keys = left << 32 | right
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]  # of several with one slot the last stays
            won = self.keys[slots] == keys
            self.merged[slots[won]] = merged[won]
            keys, slots, merged = keys[~won], (slots[~won] + 1) & ((1 << self.bits) - 1), merged[~won]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, which are ranks as well; NONE where two do not merge."""
        keys = np.ascontiguousarray(left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        slots, out = self._slots(keys), np.full(len(keys), NONE, np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            held = self.keys[slots]
            hit = held == keys[open_]
            out[open_[hit]] = self.merged[slots[hit]]
            on = ~hit & (held != -1)
            open_, slots = open_[on], (slots[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)


class ByteBpe:
    """Ids of whole texts by a file of ranks and a pattern, and back."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.pattern, self.pairs = library_pattern(pattern), PairTable(ranks)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.whole = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.tokens[i] = t
        self._forget()

    def _forget(self) -> None:
        self.kept: dict[str, int] = {}
        self.kept_ids, self.kept_sizes, self.kept_bytes = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0

    def merged(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after the other, how many each has) of a matrix whose rows are pieces of one length."""
        rows, width = ids.shape
        out, size = np.zeros((rows, width), np.int32), np.zeros(rows, np.int64)
        at, ranks = np.arange(rows), self.pairs.get(ids[:, :-1], ids[:, 1:])
        while len(at):
            n = ids.shape[1]
            best = ranks.argmin(1) if n > 1 else np.zeros(len(at), np.int64)
            done = ranks[np.arange(len(at)), best] == NONE if n > 1 else np.ones(len(at), bool)
            if done.any():
                out[at[done], :n], size[at[done]] = ids[done], n
                at, ids, ranks, best = at[~done], ids[~done], ranks[~done], best[~done]
                if not len(at):
                    break
            row = np.arange(len(at))
            ids[row, best] = ranks[row, best]
            # Every row loses the second of its pair, and the rank that stood at the pair.
            keep = np.ones(ids.shape, bool)
            keep[row, best + 1] = False
            ids = ids[keep].reshape(len(at), n - 1)
            keep = np.ones(ranks.shape, bool)
            keep[row, best] = False
            ranks = ranks[keep].reshape(len(at), n - 2)
            before, after = best > 0, best < n - 2
            ranks[row[before], best[before] - 1] = self.pairs.get(ids[row[before], best[before] - 1], ids[row[before], best[before]])
            ranks[row[after], best[after]] = self.pairs.get(ids[row[after], best[after]], ids[row[after], best[after] + 1])
        return out[np.arange(width) < size[:, None]], size

    def merged_long(self, ids: np.ndarray) -> np.ndarray:
        """Ids of one long piece. A round merges, from the left, the places of the least pair, up to the first merge that
        makes a pair of lower rank: one merge after the other would take that pair next."""
        ranks = self.pairs.get(ids[:-1], ids[1:])
        while len(ids) > 1 and (least := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == least)
            # Of neighbouring places every other one, from the left of each run.
            run = np.cumsum(np.diff(at, prepend=-2) != 1)
            first = at[np.searchsorted(run, run)]
            at = at[(at - first) % 2 == 0]
            left = np.where(np.diff(at, prepend=-3) == 2, least, ids[at - 1])  # what stands before a place, itself merged or not
            right = ids[np.minimum(at + 2, len(ids) - 1)]
            made = np.full(len(at), least)
            lower = (self.pairs.get(left, made) < least) & (at > 0) | (self.pairs.get(made, right) < least) & (at + 2 < len(ids))
            if lower.any():
                at = at[: int(lower.argmax()) + 1]
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
            rest = ranks[keep[1:]]
            place = at - np.arange(len(at))
            for p in (place - 1, place):
                p = p[(p >= 0) & (p < len(ids) - 1)]
                rest[p] = self.pairs.get(ids[p], ids[p + 1])
            ranks = rest
        return ids

    def _new(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of distinct pieces, in their order: matrices of pieces of one length."""
        data = [n.encode() for n in names]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        sizes, made = np.zeros(len(data), np.int64), {}
        order = np.argsort(lengths, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(lengths[order])) + 1).tolist(), len(order)]
        groups = []
        for s, t in zip(cuts, cuts[1:], strict=False):
            width = int(lengths[order[s]]) if s < t else 0
            step = max(1, CELLS // max(1, width)) if width <= LONG else 1
            for u in range(s, t, step):
                own = order[u : min(t, u + step)]
                ids = self.single[np.frombuffer(b"".join(data[i] for i in own.tolist()), np.uint8)]
                if width <= LONG:
                    got, n = self.merged(ids.reshape(len(own), width))
                else:
                    got = self.merged_long(ids)
                    n = np.array([len(got)])
                sizes[own] = n
                groups.append((own, got, n))
        starts = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.uint32)
        for own, got, n in groups:
            out[np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(len(got))] = got
        return out, sizes

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each): the pattern's pieces, each distinct one encoded once."""
        lists = [[p for part in (safe_cuts(t) if len(t) > LONG_CHARS else (t,)) for p in self.pattern.findall(part)] for t in texts]
        n_pieces = np.fromiter(map(len, lists), np.int64, len(lists))
        number: dict[str, int] = {}
        place = np.fromiter((number.setdefault(p, len(number)) for own in lists for p in own), np.int64, int(n_pieces.sum()))
        ids, sizes = self._new(list(number))
        out, ends = _gathered(ids, sizes, place)
        return out, np.diff(ends[np.concatenate([[0], np.cumsum(n_pieces)])])

    def _words(self, names: list[str], counts: np.ndarray) -> np.ndarray:
        """The place of each name among the kept ids; those met anew are encoded and kept."""
        place = np.fromiter(map(self.kept.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(place < 0)
        place[new] = len(self.kept_sizes) + np.arange(len(new))
        made = [names[i] for i in new.tolist()]
        ids, sizes = self._pieces(made)
        self.kept_ids, self.kept_sizes = np.concatenate([self.kept_ids, ids]), np.concatenate([self.kept_sizes, sizes])
        # Names that occur once are not looked for again, only their ids stay until all are forgotten.
        self.kept.update((names[i], int(place[i])) for i in new[counts[new] > 1].tolist())
        self.kept_bytes += int(sizes.sum()) * 4 + sum(map(len, made))
        return place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); null counts as empty.

        A text falls into words at its spaces. Between two words the pattern always splits before the space, unless
        one begins or ends with white space or is empty: such a text is cut by the pattern alone.
        """
        if len(self.kept_sizes) > KEPT_WORDS or self.kept_bytes > KEPT_BYTES:
            self._forget()
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        words = pc.split_pattern(texts, " ")
        offsets, coded = words.offsets.to_numpy(), words.values.dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary
        starts, n_words = offsets[:-1] - offsets[0], np.diff(offsets)
        head = np.zeros(len(code), bool)
        head[starts] = True
        flag = lambda x: x.to_numpy(zero_copy_only=False)
        odd = flag(pc.or_(pc.not_equal(pc.utf8_trim_whitespace(distinct), distinct), pc.equal(distinct, "")))
        odd_head = flag(pc.not_equal(pc.utf8_rtrim_whitespace(distinct), distinct))
        whole = np.logical_or.reduceat(np.where(head, odd_head[code], odd[code]), starts)
        by_word = np.repeat(~whole, n_words)
        place = np.zeros(len(code), np.int64)
        for mask, before in ((by_word & ~head, " "), (by_word & head, "")):
            counts = np.bincount(code[mask], minlength=len(distinct))
            used = np.flatnonzero(counts)
            number = np.zeros(len(distinct), np.int64)
            number[used] = self._words([before + w for w in distinct.take(pa.array(used)).to_pylist()], counts[used])
            place[mask] = number[code[mask]]
        ids, sizes = self._pieces(texts.filter(pa.array(whole)).to_pylist())
        kept = len(self.kept_sizes)
        place[~by_word] = kept + len(sizes)
        place[starts[whole]] = kept + np.arange(len(sizes))
        out, ends = _gathered(np.concatenate([self.kept_ids, ids]), np.concatenate([self.kept_sizes, sizes, [0]]), place)
        return out, np.diff(ends[np.append(starts, len(code))])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_made: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """One per Python worker, file and pattern."""
    if (path, pattern) not in _made:
        _made[path, pattern] = ByteBpe(path, pattern)
    return _made[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary) of every row: little-endian unsigned 32-bit ids of the whole text, without special tokens.

    path: ranks, one base64 token and its id a line, at the same path on every executor. A null or empty text has
    no ids; a null id stays null. Repeated rows are encoded each. A long text is cut into parts where the pattern
    splits anyhow. Other columns of `docs` are left aside, so their names cannot clash. An empty table gives an
    empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.large_binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            for part in sliced(batch, 1, SLICE_BYTES):
                ids, n = bpe.encode(part.column(1))
                ends = np.concatenate([[0], np.cumsum(n * 4)]).astype(np.int64)
                column = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([part.column(0), column], schema=schema)

    return own.mapInArrow(run, "doc_id long, ids binary")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """tokens (with a column ids, as `encoded` makes it) with the bytes of its ids as `decoded`, in place of any such column.

    Null ids give null. The bytes are those of the text that was encoded; ids of another origin need not be UTF-8.
    """
    kept = tokens.drop("decoded")
    place, names = kept.columns.index("ids"), [*kept.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            for part in sliced(batch, place, SLICE_BYTES):
                texts = [None if x is None else bpe.decode(np.frombuffer(x, "<u4")) for x in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=names)

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("decoded", BinaryType())]))
