"""Token ids in files, compressed by a Re-Pair grammar.

Documents lie in ascending id order in blocks of bounded size, the shards of the grammar. In each block
the frequent pairs of symbols are replaced by nonterminals again and again, counted over the whole
block each time, until no pair occurs as often as its rule costs. A block's record holds the rules (a
pair of symbols each), the length that every nonterminal expands to, the remaining symbols, and for
each document the place of its first symbol, so that one document is decoded without the others.

Where Re-Pair replaces one pair at a time, a round here replaces all pairs that are not much rarer than
the most frequent one; of overlapping occurrences the more frequent pair's are replaced. Once a round
has taken every pair that pays, only pairs with a symbol made since can come to pay, so later rounds
look at those alone.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm.common import shared_folder, sliced, text_or_empty
from kindred.llm.pieces import encoder

#: Id that ends each document.
END = 0
#: Ids of one block at about; bytes of text of one file at about, and files at most before they grow.
BLOCK_IDS, FILE_BYTES, FILES = 1 << 20, 32 << 20, 1 << 16
#: Bytes of text encoded at once.
SLICE_BYTES = 10 << 20
#: A rule costs two symbols and a length, and saves a symbol for each occurrence. Files, compressed as they are
#: written, are smallest at this count (4 to 32 were tried): the rules of rarer pairs take more than they save.
LEAST = 8
#: A round replaces pairs down to this share of the most frequent pair's count.
SHARE = 32

FORMAT = "file long, block int, vocabulary int, n_ids long, doc_ids binary, first_symbol binary, n_tokens binary, rules binary, lengths binary, symbols binary"


def _every_second(at: np.ndarray) -> np.ndarray:
    """Marks, in runs of neighbouring places, the first, third, fifth and so on."""
    begins = np.concatenate([[True], at[1:] != at[:-1] + 1])
    first = np.flatnonzero(begins)
    return (np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left symbol << its bits | right symbol."""
    wide = np.uint32 if left.dtype == np.uint16 else np.uint64
    return (left.astype(wide) << wide(8 * left.dtype.itemsize)) | right


def _hashed(pairs: np.ndarray, bits: int) -> np.ndarray:
    """`bits` bits of a product with an odd constant."""
    wide = pairs.dtype.type
    return (pairs * wide(0x9E3779B1 if wide is np.uint32 else 0x9E3779B97F4A7C15)) >> wide(8 * pairs.dtype.itemsize - bits)


def counted_pairs(seq: np.ndarray, closed: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, counts): the pairs that a rule may replace, each with its occurrences that don't overlap.

    Pairs are numbers as `_pairs` makes them; those whose left symbol is `closed` are no candidates.
    at: the places of the pairs that are counted, all by default.
    """
    left, right = (seq[:-1], seq[1:]) if at is None else (seq[at], seq[at + 1])
    ok = ~closed[left]
    same = np.flatnonzero(left == right)
    if len(same):
        ok[same[~_every_second(same if at is None else at[same])]] = False
    keys = _pairs(left, right)[ok]
    keys.sort()
    starts = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]]))
    return keys[starts], np.diff(np.append(starts, len(keys)))


def _settled(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Marks occurrences (ascending places, no neighbours of equal rank) so that none overlap, lower ranks first."""
    keep = np.zeros(len(at), bool)
    live = np.arange(len(at))
    while len(live):
        a, r = at[live], rank[live]
        touch = np.flatnonzero(a[1:] == a[:-1] + 1)
        wins = np.ones(len(live), bool)
        left = r[touch] < r[touch + 1]
        wins[touch[~left]] = False
        wins[touch[left] + 1] = False
        keep[live[wins]] = True
        gone = wins.copy()
        gone[touch[wins[touch]] + 1] = True
        gone[touch[wins[touch + 1]]] = True
        live = live[~gone]
    return keep


def compress(ids: np.ndarray, vocabulary: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, lengths): rules[i] is the pair that symbol vocabulary + i stands for, lengths[i] its length in ids.

    No pair that a rule may replace is left with `least` occurrences or more. A pair never starts with
    END or what ends in it, so no symbol crosses the end of a document.
    """
    # The ids of the block are numbered anew: its symbols mostly fit 16 bits, their pairs 32.
    here = np.flatnonzero(np.bincount(ids, minlength=vocabulary))
    number = np.zeros(vocabulary, np.uint32)
    number[here] = np.arange(len(here))
    seq = number[ids].astype(np.uint16 if len(here) <= 1 << 16 else np.uint32)
    rules: list[np.ndarray] = []
    lengths = np.ones(len(here), np.int64)
    closed = here == END
    used = len(here)
    near: np.ndarray | None = None  # symbols whose pairs may pay; None: all
    while len(seq) > 1:
        at = None
        if near is not None:
            marked = near[seq]
            at = np.flatnonzero(marked[:-1] | marked[1:])
        pairs, counts = counted_pairs(seq, closed, at)
        if not len(counts) or counts.max() < least:
            if near is None:
                break
            near = None  # one last look at all pairs
            continue
        floor = max(least, counts.max() // SHARE)
        often = np.flatnonzero(counts >= floor)
        chosen = pairs[often]
        bits = 8 * seq.dtype.itemsize
        left, right = (chosen >> chosen.dtype.type(bits)).astype(np.int64), (chosen & chosen.dtype.type((1 << bits) - 1)).astype(np.int64)
        rank = np.empty(len(chosen), np.int64)
        rank[np.argsort(-counts[often], kind="stable")] = np.arange(len(chosen))
        is_left, is_right = np.zeros(used, bool), np.zeros(used, bool)
        is_left[left], is_right[right] = True, True
        if at is None:
            at = np.flatnonzero(is_left[seq[:-1]] & is_right[seq[1:]])
        else:
            at = at[is_left[seq[at]] & is_right[seq[at + 1]]]
        # A table by a hash of the pair: of pairs with one place the most frequent has it, the others wait for a later round.
        pair = _pairs(seq[at], seq[at + 1])
        place = max(12, 2 + int(len(chosen)).bit_length())
        table = np.zeros(1 << place, np.int32)
        falling = np.argsort(-rank)
        table[_hashed(chosen[falling], place)] = falling
        rule = table[_hashed(pair, place)]
        hit = chosen[rule] == pair
        at, rule = at[hit], rule[hit]
        same = np.flatnonzero(left[rule] == right[rule])
        if len(same):
            stays = np.ones(len(at), bool)
            stays[same[~_every_second(at[same])]] = False
            at, rule = at[stays], rule[stays]
        kept = _settled(at, rank[rule])
        at, rule = at[kept], rule[kept]
        # Rules that lost too many occurrences to more frequent ones wait for a later round.
        pays = np.bincount(rule, minlength=len(chosen)) >= least
        number = np.cumsum(pays) - 1
        kept = pays[rule]
        at, rule = at[kept], number[rule[kept]]
        if floor == least or near is not None:
            # Symbols whose pairs may still pay: new ones, those of rules that wait, and of runs that shifted.
            kept_near = np.zeros(used + int(pays.sum()), bool)
            kept_near[used:] = True
            kept_near[left[~pays | (left == right)]] = True
            if near is not None and floor > least:
                kept_near[:used] |= near
            near = kept_near
        left, right = left[pays], right[pays]
        if used + len(left) > 1 << 16:
            seq = seq.astype(np.uint32)
        seq[at] = used + rule
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        seq = seq[stays]
        rules.append(np.stack([left, right], 1))
        lengths = np.concatenate([lengths, lengths[left] + lengths[right]])
        closed = np.concatenate([closed, closed[right]])
        used += len(left)
    made = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    symbol = np.concatenate([here, vocabulary + np.arange(len(made))]).astype(np.uint32)
    return symbol[seq], symbol[made], lengths[len(here) :].astype(np.uint32)


class Block:
    """A block read back; `ids(i)` decodes one document, `all_ids()` every one."""

    def __init__(self, vocabulary: int, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, first: np.ndarray, n_tokens: np.ndarray):
        self.symbols, self.first, self.n_tokens = symbols, first, n_tokens
        self.lengths = np.concatenate([np.ones(vocabulary, np.int64), lengths.astype(np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        flat = np.empty(self.starts[-1], np.uint32)
        flat[:vocabulary] = np.arange(vocabulary)
        done = np.arange(len(self.lengths)) < vocabulary
        pair, waiting = rules.astype(np.int64), np.arange(len(rules))
        # Level by level: the rules whose two symbols are expanded already.
        while len(waiting):
            ready = done[pair[waiting]].all(1)
            own = waiting[ready]
            to = self.starts[vocabulary + own]
            for symbol in pair[own].T:
                n = self.lengths[symbol]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                flat[np.repeat(to, n) + step] = flat[np.repeat(self.starts[symbol], n) + step]
                to = to + n
            done[vocabulary + own] = True
            waiting = waiting[~ready]
        self.flat = flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        n = self.lengths[symbols]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[symbols] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def ids(self, i: int) -> np.ndarray:
        end = self.first[i + 1] if i + 1 < len(self.first) else len(self.symbols)
        return self.expand(self.symbols[self.first[i] : end])

    def all_ids(self) -> np.ndarray:
        return self.expand(self.symbols)


def ended(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ids of documents of n ids each, with END after each document."""
    out = np.full(len(ids) + len(n), END, np.uint32)
    body = np.ones(len(out), bool)
    body[np.cumsum(n + 1) - 1] = False
    out[body] = ids
    return out


def _packed(file: int, block: int, vocabulary: int, doc_ids: np.ndarray, n_tokens: np.ndarray, ids: np.ndarray) -> dict:
    """The record of a block: `ids` of all its documents, n_tokens of each, ends counted."""
    symbols, rules, lengths = compress(ids, vocabulary)
    # A document starts where the expansions so far reach the sum of the documents before it.
    reached = np.cumsum(np.concatenate([np.ones(vocabulary, np.int64), lengths.astype(np.int64)])[symbols])
    first = np.concatenate([[0], np.searchsorted(reached, np.cumsum(n_tokens.astype(np.int64))[:-1]) + 1])
    return {
        "file": file, "block": block, "vocabulary": vocabulary, "n_ids": len(ids), "doc_ids": doc_ids.astype("<i8").tobytes(),
        "first_symbol": first.astype("<u4").tobytes(), "n_tokens": n_tokens.astype("<u4").tobytes(), "rules": rules.astype("<u4").tobytes(),
        "lengths": lengths.astype("<u4").tobytes(), "symbols": symbols.astype("<u4").tobytes(),
    }


_SCHEMA = pa.schema([("file", pa.int64()), ("block", pa.int32()), ("vocabulary", pa.int32()), ("n_ids", pa.int64()), *((n, pa.binary()) for n in ("doc_ids", "first_symbol", "n_tokens", "rules", "lengths", "symbols"))])


def write(docs: DataFrame, path: str, vocabulary_file: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every whole text, END after each, in ascending id order.

    Null texts count as empty and have END alone. Rows of one id lie side by side in order of their
    text; rows with a null id come first, under the least id. Files hold ranges of ids, numbered in
    their order. Other columns are left aside. An empty table writes no block. A text is encoded whole,
    whatever its length; one longer than BLOCK_IDS is a block of its own length.
    """
    least = -(2**63)
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("doc_id"), text_or_empty(text_col).alias("text"))
    total = own.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    file_bytes = max(FILE_BYTES, total // FILES)
    files = max(1, -(-total // file_bytes), min(2 * docs.sparkSession.sparkContext.defaultParallelism, total >> 21))
    ranged = own.repartitionByRange(files, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text").withColumn("file", F.spark_partition_id().cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        e = encoder(vocabulary_file)
        vocabulary = max(e.tokenizer.get_vocab_size(), 1)
        block, held, parts, file = 0, 0, [], None

        def out() -> pa.RecordBatch:
            doc_ids, n, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            return pa.RecordBatch.from_pylist([_packed(file, block, vocabulary, doc_ids, n, ids)], schema=_SCHEMA)

        for b in batches:
            for part in sliced(b, 1, SLICE_BYTES):
                file = part.column(2)[0].as_py()
                ids, n = e.encode_column(part.column(1))
                doc_ids, ids, n = part.column(0).to_numpy(zero_copy_only=False), ended(ids, n), n + 1
                # A block ends with the document that fills it.
                while len(n):
                    reached = held + np.cumsum(n)
                    stop = int(np.searchsorted(reached, BLOCK_IDS)) + 1
                    m = int(n[:stop].sum())
                    parts.append((doc_ids[:stop], n[:stop], ids[:m]))
                    held += m
                    doc_ids, n, ids = doc_ids[stop:], n[stop:], ids[m:]
                    if held >= BLOCK_IDS:
                        yield out()
                        block, held = block + 1, 0
        if parts:
            yield out()

    ranged.mapInArrow(run, FORMAT).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_block(row: dict) -> tuple[np.ndarray, Block]:
    u4 = lambda name: np.frombuffer(row[name], "<u4")
    block = Block(row["vocabulary"], u4("rules").reshape(-1, 2), u4("lengths"), u4("symbols"), u4("first_symbol").astype(np.int64), u4("n_tokens").astype(np.int64))
    return np.frombuffer(row["doc_ids"], "<i8"), block


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary, ids_crc32) of every document in the files; `ids` may be left out.

    start: ids of all documents before it. ids: little-endian unsigned 32-bit, with the end id. Files
    of an empty table give no row. Rows that were written with a null id have the least id.
    """
    blocks = spark.read.parquet(path)
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    # One narrow row a block.
    bases = blocks.select("file", "block", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    names = ["doc_id", "start", "n_tokens", *["ids"] * ids, "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                doc_ids, block = read_block(row)
                decoded = memoryview(np.ascontiguousarray(block.all_ids(), "<u4")).cast("B")
                ends = np.cumsum(block.n_tokens)
                starts = ends - block.n_tokens
                each = [decoded[4 * s : 4 * t] for s, t in zip(starts.tolist(), ends.tolist(), strict=True)]
                bodies = [pa.array([bytes(x) for x in each], pa.binary())] if ids else []
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids), pa.array(starts + row["base"]), pa.array(block.n_tokens), *bodies, pa.array([zlib.crc32(x) for x in each], pa.int64())], names=names)

    columns = ["vocabulary", "doc_ids", "first_symbol", "n_tokens", "rules", "lengths", "symbols", "base"]
    return blocks.join(F.broadcast(bases) if _few(blocks) else bases, ["file", "block"]).select(columns).mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids binary, ' * ids}ids_crc32 long")


#: Blocks up to which their bases (24 bytes each) are broadcast.
BROADCAST_BLOCKS = 1 << 18


def _few(blocks: DataFrame) -> bool:
    return blocks.count() <= BROADCAST_BLOCKS


def round_trip(docs: DataFrame, vocabulary_file: str, ids: bool = True) -> DataFrame:
    """The documents' ids written to files in the shared folder and read back from them, as `read` gives them."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write(docs, path, vocabulary_file)
    return read(spark, path, ids)
