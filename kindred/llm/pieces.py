"""Encoding of whole texts by the tokenizers library.

Counts come from the library's batches: texts in lists of about equal bytes, long ones cut at safe
places, between a letter or digit and a space before something that is no white space. There a
byte-level BPE always splits before it merges, so the parts' encodings together are the text's.

Ids for files come by distinct words. A text falls into words at its spaces; most recur, so the distinct
words of many texts are encoded once, in few long texts, and their ids copied to where they occur. Words
that recur are kept for the next texts, in a table of bounded size. Texts with runs of white space next to
spaces, or with an added token's string inside, go to the library whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Encoding, Tokenizer, models, pre_tokenizers

from kindred.llm.common import by_bytes

#: Bytes of one call of the library, and characters from which a text is cut at safe places.
BATCH_BYTES, LONG_CHARS = 1 << 20, 1 << 16

#: Words kept at most, and their bytes; beyond either the table starts anew.
KEPT_WORDS, KEPT_BYTES = 1 << 18, 16 << 20

#: A letter of Latin script before an ASCII digit or mark: there the pre-tokenizer always splits, so words fall in two.
_GLUED = r"^((?s:.*?)[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-@\[-`{-~](?s:.*))$"

#: A space between a letter or digit and something that is no white space.
_SAFE = re.compile(r"(?<=[^\W_]) (?=\S)")


def safe_cuts(text: str, most: int = LONG_CHARS) -> list[str]:
    """`text` in parts of about `most` characters, cut where no pre-token can cross.

    A text without such a place stays whole.
    """
    parts, at = [], 0
    while len(text) - at > most:
        m = _SAFE.search(text, at + most)
        if not m:
            break
        parts.append(text[at : m.start()])
        at = m.start()
    parts.append(text[at:])
    return parts


class PieceEncoder:
    """Ids or counts of whole texts as `Tokenizer.encode(text, add_special_tokens=False)` gives them."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model, pre = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Words are exact for plain byte-level BPE only; other kinds go to the library whole.
        self.by_piece = (
            self.tokenizer.normalizer is None
            and isinstance(pre, pre_tokenizers.ByteLevel)
            and not pre.add_prefix_space
            and getattr(pre, "use_regex", True)
            and isinstance(model, models.BPE)
            and not model.dropout
        )
        self._forget()
        #: Whether a token starts with a space, which byte-level BPE writes as U+0120.
        self.spaced = np.zeros(max(1, self.tokenizer.get_vocab_size()), bool)
        self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("Ġ")]] = True

    def _calls(self, texts: list[str]) -> Iterator[tuple[int, Encoding]]:
        """(text, encoding) of each part of each text, by the library, in calls of balanced bytes."""
        parts = [(i, p) for i, t in enumerate(texts) for p in (safe_cuts(t) if self.by_piece else [t])]
        at = 0
        for call in by_bytes((p for _, p in parts), BATCH_BYTES):
            for e in self.tokenizer.encode_batch_fast(call, add_special_tokens=False):
                yield parts[at][0], e
                at += 1

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        size, ids = np.zeros(len(texts), np.int64), array("I")
        for i, e in self._calls(texts.to_pylist()):
            size[i] += len(e)
            ids.extend(e.ids)
        return np.array(ids, np.uint32), size

    def _forget(self) -> None:
        """No word is kept."""
        self.kept: dict[str, int] = {}
        self.kept_ids, self.kept_sizes, self.kept_bytes = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for a space and each word. Spaces stand only before words, so tokens with one tell words apart."""
        made = [np.zeros(0, np.uint32)]
        call = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(call[1:] != call[:-1]) + 1).tolist(), len(words)]
        for s, t in zip(cuts, cuts[1:], strict=False):
            if s < t:
                text = " " + " ".join(words[s:t])
                made.append(np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate(made)
        first = np.flatnonzero(self.spaced[ids])
        return ids, np.diff(np.append(first, len(ids)))

    def _split(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As `_tails`, with a word's letters and what is glued to them looked up apart: few of either are distinct."""
        parts = pc.extract_regex(words, _GLUED.replace("^(", "^(?P<a>").replace("([!", "(?P<b>[!"))
        lead = pc.fill_null(pc.struct_field(parts, "a"), words).dictionary_encode()
        rest = pc.fill_null(pc.struct_field(parts, "b"), "").dictionary_encode()
        first, second = lead.indices.to_numpy().astype(np.int64), rest.indices.to_numpy().astype(np.int64)
        ids, size, place = self._tails(lead.dictionary, np.bincount(first, counts, len(lead.dictionary)).astype(np.int64))
        glued_ids, glued_size = self._whole(rest.dictionary)
        at, n = place[first], size[place[first]]
        a, b = np.cumsum(size) - size, np.cumsum(glued_size) - glued_size
        m = glued_size[second]
        # Both parts' ids behind one another.
        store, ends = np.concatenate([ids, glued_ids]), np.cumsum(n + m)
        begin = ends - n - m
        out = np.empty(ends[-1] if len(ends) else 0, np.uint32)
        for start, width, to in ((a[at], n, begin), (len(ids) + b[second], m, begin + n)):
            step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            out[np.repeat(to, width) + step] = store[np.repeat(start, width) + step]
        return out, n + m, np.arange(len(words))

    def _tails(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, sizes, the place of each word among the sizes): new words are encoded, those that occur twice are kept."""
        if len(self.kept) > KEPT_WORDS or self.kept_bytes > KEPT_BYTES:
            self._forget()
        names = words.to_pylist()
        place = np.fromiter(map(self.kept.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(place < 0)
        once = counts[new] < 2
        new = new[np.argsort(once, kind="stable")]  # those that are kept come first
        place[new] = len(self.kept) + np.arange(len(new))
        made = [names[i] for i in new.tolist()]
        ids, sizes = self._spaced(made)
        ids, sizes = np.concatenate([self.kept_ids, ids]), np.concatenate([self.kept_sizes, sizes])
        recur = made[: len(new) - int(once.sum())]
        self.kept.update(zip(recur, range(len(self.kept), len(self.kept) + len(recur)), strict=True))
        self.kept_bytes += sum(map(len, recur))
        self.kept_sizes = sizes[: len(self.kept)]
        self.kept_ids = ids[: int(self.kept_sizes.sum())]
        return ids, sizes, place

    def _heads(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return *self._whole(words), np.arange(len(words))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text) of a string column; null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.by_piece:
            return self._whole(texts)
        words = pc.split_pattern(texts, " ")
        offsets = words.offsets.to_numpy()
        coded = words.values.dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary
        starts, n_words = offsets[:-1], np.diff(offsets)
        head = np.zeros(len(code), bool)
        head[starts] = True
        # White space that could join with the space before or after it; a head has none before.
        flag = lambda x: x.to_numpy(zero_copy_only=False)
        odd = flag(pc.or_(pc.not_equal(pc.utf8_trim_whitespace(distinct), distinct), pc.equal(distinct, "")))
        odd_head = flag(pc.not_equal(pc.utf8_rtrim_whitespace(distinct), distinct))
        whole = np.logical_or.reduceat(np.where(head, odd_head[code], odd[code]), starts)
        for a in self.added:
            whole |= flag(pc.match_substring(texts, a))
        by_word = np.repeat(~whole, n_words)
        # Pieces: distinct words after a space, distinct first words, whole texts, and nothing.
        lists, sizes, piece, at = [], [], np.zeros(len(code), np.int32), 0
        for mask, encode in ((by_word & ~head, self._split), (by_word & head, self._heads)):
            counts = np.bincount(code[mask], minlength=len(distinct))
            used = np.flatnonzero(counts)
            ids, size, place = encode(distinct.take(pa.array(used)), counts[used])
            number = np.zeros(len(distinct), np.int32)
            number[used] = at + place
            piece[mask] = number[code[mask]]
            lists.append(ids), sizes.append(size)
            at += len(size)
        ids, size = self._whole(texts.filter(pa.array(whole)))
        piece[~by_word] = at + len(size)
        piece[starts[whole]] = at + np.arange(len(size))
        store, size = np.concatenate([*lists, ids]), np.concatenate([*sizes, size, [0]])
        n = size[piece]
        ends = np.cumsum(n)
        return store[np.repeat((np.cumsum(size) - size)[piece] - (ends - n), n) + np.arange(ends[-1])], np.add.reduceat(n, starts)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; None counts as empty."""
        ids, n = self.encode_column(pa.array(texts, pa.large_string()))
        ends = np.cumsum(n).tolist()
        return [ids[s:t].astype("<u4").tobytes() for s, t in zip([0, *ends], ends, strict=False)]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Lengths only, of each text: the library encodes batches balanced by bytes, long texts cut at safe places."""
        out = np.zeros(len(texts), np.int64)
        for i, e in self._calls([t or "" for t in texts]):
            out[i] += len(e)
        return out


_made: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One per Python worker and vocabulary."""
    if path not in _made:
        _made[path] = PieceEncoder(path)
    return _made[path]
