import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import byte_bpe, queries
from kindred.llm.common import table

PATH, PATTERN = byte_bpe.default_ranks()
BPE = byte_bpe.coder(PATH, PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def check(texts, bpe=BPE, library=LIBRARY):
    ids, n = bpe.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(n)
    for t, s, e in zip(texts, [0, *ends], ends, strict=False):
        assert ids[s:e].tolist() == library.encode_ordinary(t or "")
        assert bpe.decode(ids[s:e]) == (t or "").encode()


def test_as_the_library_on_odd_and_long_texts():
    rng = random.Random(3)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    anything = "".join(chr(rng.choice((rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x32000)))) for _ in range(20_000))
    check([None, "", "a" * 5000, "abab" * 700, draw("aab", 4000), draw("abcdefé", 5000), "漢字" * 3000, " " * 3000, "\n" * 700 + "z", "the" * 400 + "ing" * 300, anything])
    check([draw("abcde  \n.,'1", 200_000), "<|endoftext|> in a text", "  lead", "trail  ", "a \x1c b\x85 c\u00a0 d \u2028 e"])


def test_letters_and_numbers_are_those_of_the_librarys_unicode():
    """Characters that `regex` or Python count otherwise: each beside letters, digits and marks."""
    check([f"ab{chr(c)}cd 1{chr(c)}2 !{chr(c)}? {chr(c)}" for c in (0x558, 0x88F, 0xC5C, 0x208F, 0x11DE0, 0x11DE9, 0x1C89, 0xA7CB, 0x323B0, 0x1C, 0x85, 0x180E, 0x200B)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab Z9'stl\n\t.,!é漢 \x1c\u00a0<|endoftext|>"), max_size=60), max_size=5))
def test_as_the_library_on_small_texts(texts):
    check(texts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abc"), min_size=2, max_size=60))
def test_long_pieces_merge_as_short_ones(text):
    single = BPE.single[np.frombuffer(text.encode(), np.uint8)]
    assert BPE.merged_long(single.copy()).tolist() == BPE.merged(single[None].copy())[0].tolist() == LIBRARY.encode_ordinary(text)


def test_another_file_and_forgetting(monkeypatch):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own, library = byte_bpe.ByteBpe(path, PATTERN), tiktoken.Encoding("multi", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    monkeypatch.setattr(byte_bpe, "KEPT_WORDS", 20)
    for k in range(5):
        check([f"{k} " + " ".join(f"wörd{j}x{j % (k + 2)} again again" for j in range(40)), "über 漢字 नमस्ते", None], own, library)


def test_query_of_a_whole_table_as_the_library(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    got = queries.op12_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize("rows", [[], [(None, None, "x"), (1, None, "y"), (2, "", None), (3, "same text", "s"), (3, "same text", "s"), (4, "long " * 50_000, "l")]])
def test_nulls_repeats_empty_tables_and_clashing_names(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumnRenamed("ids", "decoded")
    tokens = byte_bpe.encoded(docs, PATH, PATTERN)
    got = [(r[0], bytes(r[1]), bytes(r[2])) for r in byte_bpe.decoded(tokens, PATH, PATTERN).collect()]
    want = [(i, np.array(LIBRARY.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, _ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_null_ids_decode_to_null(spark):
    tokens = spark.createDataFrame([(1, None), (2, bytearray(b""))], "doc_id long, ids binary")
    assert {r[0]: r["decoded"] for r in byte_bpe.decoded(tokens, PATH, PATTERN).collect()} == {1: None, 2: b""}
