import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kindred.llm import pieces, token_counts, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "Hello world, it's 12,345!", "a   b \n\n c\t d ", "<|endoftext|> in <|endoftext|>x", " lead", "trail ", "\n", "é ß  漢字 и", "x" * 3000, "  " * 50 + "z", "they'll  'ves don't go   on"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_pieces_equal_library(library):
    texts = [*TEXTS, None, ("Word, wörd 12\n" * 9000), "a b" + "c" * 200_000 + " d e"]
    got = pieces.PieceEncoder(PATH).encode(texts)
    for t, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == ids_of(library, t)


_ENCODER = pieces.PieceEncoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z9'\n\t.,!é漢 \x1c<|endoftext|>"), max_size=40))
def test_pieces_equal_library_on_odd_texts(text):
    assert np.frombuffer(_ENCODER.encode([text])[0], "<u4").tolist() == ids_of(_ENCODER.tokenizer, text)


def test_other_vocabulary_goes_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    e = pieces.PieceEncoder(path)
    assert not e.by_piece
    want = Tokenizer.from_file(path).encode_batch(TEXTS, add_special_tokens=False)
    assert e.count(TEXTS).tolist() == [len(w.ids) for w in want]


def test_counts_equal_ids_and_long_texts(library):
    texts = [*TEXTS, None, "word one, two " * 20000, "漢字" * 40_000, "ab" * 70_000]
    e = pieces.PieceEncoder(PATH)
    assert e.count(texts).tolist() == [len(ids_of(library, t)) for t in texts]


def test_kept_words_stay_bounded(monkeypatch, library):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 50)
    e = pieces.PieceEncoder(PATH)
    for k in range(6):
        texts = [f"{k} " + " ".join(f"w{j}x{j % (k + 2)} again again" for j in range(40)), "one again", None]
        got = e.encode(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(library, t) for t in texts]
        assert len(e.kept) == len(e.kept_sizes) <= 50 + 45 and e.kept_sizes.sum() == len(e.kept_ids)


def test_safe_cuts_rejoin():
    text = "word one, two " * 20000
    parts = pieces.safe_cuts(text, 1000)
    assert "".join(parts) == text and len(parts) > 100
    assert pieces.safe_cuts("x" * 5000, 1000) == ["x" * 5000]


def frame(spark, texts):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_counts(spark, library):
    texts = [*TEXTS, None, "same", "same"]
    got = {r["doc_id"]: r for r in token_counts.token_counts(frame(spark, texts), PATH, limit=5).collect()}
    for i, t in enumerate(texts):
        n = len(ids_of(library, t))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 5)
    assert token_counts.token_counts(frame(spark, texts).limit(0), PATH).count() == 0


def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.zeros(50, np.uint32), rng.integers(0, 5, 40_000).astype(np.uint32), np.tile(np.arange(1, 9), 4000).astype(np.uint32), rng.integers(0, 50257, 3000).astype(np.uint32)):
        symbols, rules, lengths = token_files.compress(ids, 50257)
        block = token_files.Block(50257, rules, lengths, symbols, np.zeros(0, np.int64), np.zeros(0, np.int64))
        assert (block.all_ids() == ids).all() and len(symbols) <= len(ids)
    assert len(token_files.compress(np.tile(np.arange(1, 9), 4000).astype(np.uint32), 50257)[0]) < 32000 / 8


def test_files_round_trip_and_random_access(spark, library):
    texts = ["the cat sat on the mat, " * 300, *TEXTS, None, "!", "!!! " * 500]
    df = frame(spark, texts).unionByName(frame(spark, texts[:1]))  # a repeated row
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in token_files.round_trip(df, PATH).collect())
    start = 0
    for (i, s, n, crc, ids), (want_i, t) in zip(got, sorted([*enumerate(texts), (0, texts[0])]), strict=True):
        want = np.array([*ids_of(library, t), 0], "<u4")
        assert (i, s, n, crc, ids) == (want_i, start, len(want), zlib.crc32(want.tobytes()), want.tobytes())
        start += n
    coded = pieces.PieceEncoder(PATH).encode(texts)
    n = np.array([len(c) // 4 for c in coded])
    ids = token_files.ended(np.frombuffer(b"".join(coded), "<u4"), n)
    doc_ids, block = token_files.read_block(token_files._packed(0, 0, 50257, np.arange(len(texts)), n + 1, ids))
    for i, c in enumerate(coded):
        assert block.ids(i).astype("<u4").tobytes() == c + b"\0\0\0\0"
    assert token_files.round_trip(df.limit(0), PATH).count() == 0


def test_vocabulary_is_plain_byte_level():
    j = json.load(open(PATH))
    assert j["normalizer"] is None and not j["pre_tokenizer"]["add_prefix_space"]
