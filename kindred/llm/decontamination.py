"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of e edits is split into e + 1 pieces: an occurrence with at most e edits
leaves at least one piece as it is. One pass of an Aho-Corasick automaton over a text finds all exact
piece hits; around each, Myers' bit-parallel algorithm gives the item's least edit distance to a part
of the text. Items come in blocks of bounded size; each block is one pass over the documents, and is gone
from the driver before the next.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from kindred.llm.common import cut, fresh, sliced, text_or_empty

#: One edit is allowed for so many characters of an item.
CHARS_PER_EDIT = 16
#: Items shorter than this (after normalization) count as matched by equality of words only.
LEAST_CHARS = 16
#: Characters of items that one pass takes; more items take more passes.
BLOCK_CHARS = 4 << 20

_WORDS = re.compile(r"[^\W_]+")


#: ASCII characters that are neither letter nor digit, to a space: the same rule, faster for plain texts.
_PLAIN = {i: " " for i in range(128) if not chr(i).isalnum()}


def normalized(text: str) -> str:
    """Lower case, words of letters and digits, single spaces."""
    low = text.lower()
    return " ".join(low.translate(_PLAIN).split() if low.isascii() else _WORDS.findall(low))


def budget(item: str, chars_per_edit: int = CHARS_PER_EDIT) -> int:
    return 0 if len(item) < LEAST_CHARS else max(1, len(item) // chars_per_edit)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """`errors` + 1 pieces of almost equal length, with their places."""
    cuts = [i * len(item) // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' bit vectors for one item."""

    def __init__(self, item: str):
        self.item, self.m = item, len(item)
        self.eq: dict[str, int] = {}
        for i, c in enumerate(item):
            self.eq[c] = self.eq.get(c, 0) | 1 << i

    def least(self, text: str, most: int) -> tuple[int, int]:
        """(least edit distance of the item to a part of `text`, that part's end); (most + 1, -1) beyond `most`."""
        m, eq = self.m, self.eq
        mask, high = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score = mask, 0, m
        best, end = (m, 0) if m <= most else (most + 1, -1)
        for j, c in enumerate(text):
            x = eq.get(c, 0) | mv
            d = ((((x & pv) + pv) ^ pv) | x) & mask
            ph, mh = (mv | ~(d | pv)) & mask, pv & d
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
            ph, mh = ph << 1 & mask, mh << 1 & mask
            pv, mv = (mh | ~(d | ph)) & mask, ph & d
            if score < best:
                best, end = score, j + 1
                if not best:
                    break
        return best, end


class Matcher:
    """All items of a block against one text at a time."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int = CHARS_PER_EDIT):
        self.items: list[tuple[int, Pattern, int]] = []
        owners: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            item = normalized(text or "")
            if not item:
                continue
            e = budget(item, chars_per_edit)
            k = len(self.items)
            self.items.append((item_id, Pattern(item), e))
            for at, piece in pieces(item, e):
                owners.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.automaton.add_word(piece, (len(piece), own))
        if owners:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) in the normalized text: for each item its best occurrence; start is the window's."""
        if not self.items:
            return []
        t = normalized(text)
        found: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, set[int]] = {}
        for last, (n, own) in self.automaton.iter(t):
            start = last + 1 - n
            for k, at in own:
                item_id, pattern, e = self.items[k]
                place = start - at
                if k in found and found[k][0] == 0:
                    continue
                # Hits of one occurrence differ in place by the budget at most: windows by steps of it cover each once.
                step = place // (e + 1)
                done = tried.setdefault(k, set())
                if step in done:
                    continue
                done.add(step)
                if not e and pattern.m < LEAST_CHARS and not self._whole_words(t, start, last + 1):
                    done.discard(step)
                    continue
                lo = max(0, step * (e + 1) - e)
                distance, end = pattern.least(t[lo : step * (e + 1) + e + pattern.m + e + 1], e)
                if distance <= e and (k not in found or distance < found[k][0]):
                    found[k] = (distance, lo, lo + end)
        return sorted((self.items[k][0], *x) for k, x in found.items())

    @staticmethod
    def _whole_words(t: str, start: int, end: int) -> bool:
        return (start == 0 or t[start - 1] == " ") and (end == len(t) or t[end] == " ")


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()


_HIT = ArrayType(StructType().add("item_id", "long").add("distance", "integer").add("start", "long").add("end", "long"))
_HIT_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
#: Bytes of texts that a task matches at once.
SLICE_BYTES = 8 << 20


def _matched(own: DataFrame, names: list[str], schema: StructType, items: list[tuple[int, str]], chars_per_edit: int) -> DataFrame:
    """own, whose last column is the text, with hits instead of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, chars_per_edit)
        for b in batches:
            for part in sliced(b, b.num_columns - 1, SLICE_BYTES):
                texts = part.column(part.num_columns - 1).to_pylist()
                hits = [[{"item_id": i, "distance": d, "start": s, "end": e} for i, d, s, e in matcher.hits(t)] for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(hits, _HIT_ARROW)], names=[*names, "hits"])

    return own.mapInArrow(run, StructType(list(schema.fields)).add("hits", _HIT))


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None, chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with hits array<struct<item_id, distance, start, end>>: every item that occurs in the text within its budget.

    Text and items are normalized first (lower case, words, single spaces); start and end count
    characters of the normalized text. keep: the columns of `docs` that are kept, all by default, whatever
    their names; a column hits in `docs` is replaced. Null or empty texts and items have no hits. Texts
    are read whole, whatever their length. Repeated rows are matched each; equal items under several ids
    are all named. An empty benchmark leaves every list empty, an empty table gives an empty result.

    The items go to every task, if they have no more than `block_chars` characters together (their sum is
    taken first). A larger benchmark is cut into blocks of about that size: each is a pass over the texts,
    whose hits are written to the shared folder before the next block is read, so the driver holds one
    block at a time; the hits of all passes are joined to the documents by a hash of the text.
    """
    docs = docs.drop("hits")
    kept = docs.select(*(keep if keep is not None else docs.columns))
    own = docs.select(*kept.columns, text_or_empty(text_col).alias(fresh(kept, "match_text")))
    name = own.columns[-1]
    items = _items(benchmark)
    total = items.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    if blocks == 1:
        return _matched(own, kept.columns, kept.schema, sorted(map(tuple, items.collect())), chars_per_edit)
    key = [F.sha2(F.col(name), 256).alias("key")]
    texts = own.select(*key, name)
    found = None
    for i in range(blocks):
        block = sorted(map(tuple, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect()))
        part = _matched(texts, ["key"], texts.select("key").schema, block, chars_per_edit).where(F.size("hits") > 0)
        part = cut(part.dropDuplicates(["key"]))
        found = part if found is None else found.unionByName(part)
    # A text has one row here, however many documents hold it; a hot one is split by the optimiser.
    hits = found.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    place = fresh(own, "match_key")
    joined = own.withColumn(place, F.sha2(F.col(name), 256)).join(hits.withColumnRenamed("key", place), place, "left")
    return joined.select(*kept.columns, F.coalesce("hits", F.lit([]).cast(_HIT)).alias("hits"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit, with their own columns, whatever their names; null and empty texts stay."""
    name = fresh(docs, "row")
    text = options.pop("text_col", "text")
    held = docs.select(F.struct(*docs.columns).alias(name), F.col(text).alias(fresh(docs, "match_text")))
    out = matches(held, benchmark, text_col=held.columns[1], keep=[name], **options)
    return out.where(F.size("hits") == 0).select(f"{name}.*")
