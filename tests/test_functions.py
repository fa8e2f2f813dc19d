import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from kindred.functions import codec, normalize, sketch, tokens


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()[0]


@pytest.mark.parametrize("f, cases", [
    (normalize.name, {"Mary-Jane O'Connor": "maryjane oconnor", "  A\tB ": "a b", "José": "jos", "---": "", None: "", "": "", "a\x0bb": "ab"}),
    (normalize.date, {"12/25/2023": "2023-12-25", "2023-12-25": "2023-12-25", "12-25-2023": "2023-12-25", "2023/12/25": "2023-12-25", "1/2/85": "1985-01-02", "1/2/68": "2068-01-02", "1/2/69": "1969-01-02", "02/30/2020": "02/30/2020", " 01/02/2020 ": "01/02/2020", "Jan 5": "jan 5", "001/2/2020": "001/2/2020", None: ""}),
    (normalize.gender, {"Male": "m", "Enby": "nb", "prefer not to say": "u", "fem": "f", "x": "u", "   ": "u", "": "", None: "", " Woman ": "f"}),
    (normalize.zip_code, {"12345-6789": "12345", "12345 6789": "12345", "123": "123", "abc": "", None: ""}),
    (normalize.bloom_text, {"2020-01-02": "2020 01 02", "  A--b!": "a b", None: ""}),
    (normalize.packed, {"A b  C": "abc", None: ""}),
    (lambda c: normalize.basic(c), {"  Ab\u0085": "ab", None: ""}),
])
def test_normalization(spark, f, cases):
    for value, want in cases.items():
        assert one(spark, value, f) == want, value


def test_field_specs():
    assert normalize.parse_field("name:first") == ("first", "name")
    assert normalize.parse_field("odd:first") == ("first", None)
    assert normalize.parse_field("first") == ("first", None)
    assert normalize.parse_field("a:b:c") == ("a:b:c", None)
    assert normalize.parse_config(["name:a", "b", "odd:c"]) == {"a": "name"}


def fnv(data, h=14695981039346656037):
    for b in data:
        h = (h ^ b) * 1099511628211 % 2**64
    return h


def bits_of(value, m, k):
    data = value.encode()
    seed = fnv(data)
    return {fnv((seed ^ i).to_bytes(8, "little") + data) % m for i in range(k)}


def test_fnv_and_bloom(spark):
    assert one(spark, "a", sketch.fnv1a_hex) == "af63dc4c8601ec8c"
    assert one(spark, "person 0", sketch.fnv1a_hex) == "21b4cf2567003950"
    random.seed(1)
    values = ["person 0", "", "é", *("".join(random.choice("abc 019ß") for _ in range(random.randint(1, 20))) for _ in range(40))]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    for m, k in ((1000, 5), (100, 3), (64, 1)):
        got = {r[0]: set(r[1]) for r in rows.select("v", sketch.bloom(F.array("v"), m, k)).collect()}
        assert got == {v: bits_of(v, m, k) for v in values}
    assert one(spark, "person 0", lambda c: sketch.bloom(F.array(c))) == [165, 358, 391, 652, 809]


def test_vectors_equal_expressions(spark):
    from kindred.functions.vectors import sketched

    random.seed(6)
    word = lambda: "".join(random.choice("ab 01é") for _ in range(random.randint(0, 30)))
    rows = [(i, [word() for _ in range(random.randint(0, 5))]) for i in range(60)] + [(60, []), (61, [""])]
    df = spark.createDataFrame(rows, "id long, v array<string>")
    for m, k, s in ((1000, 5, 20), (97, 3, 5)):
        got = {r["id"]: (r["bits"], r["signature"]) for r in sketched(df, "v", m, k, s, "x").collect()}
        native = df.select("id", sketch.bloom(F.col("v"), m, k).alias("bits")).select("id", "bits", sketch.minhash(F.col("bits"), s, "x").alias("signature"))
        assert got == {r["id"]: (r["bits"], r["signature"]) for r in native.collect()}


def test_membership_and_hamming(spark):
    df = spark.createDataFrame([("ab", "cd")], "a string, b string").select("*", sketch.bloom(F.array("a", "b")).alias("both"), sketch.bloom(F.array("a")).alias("one"))
    r = df.select(sketch.bloom_test(F.col("both"), F.col("b")), sketch.bloom_test(F.col("one"), F.col("b")), sketch.hamming(F.col("both"), F.col("one")), F.size("both") - F.size("one")).first()
    assert r[0] and not r[1] and r[2] == r[3]


def test_noise_is_seeded(spark):
    df = spark.createDataFrame([("k", [1, 5, 9])], "key string, bits array<int>")
    a = df.select(sketch.flipped(F.col("bits"), F.col("key"), 0.05, 100)).first()[0]
    b = df.select(sketch.flipped(F.col("bits"), F.col("key"), 0.05, 100)).first()[0]
    assert a == b and a != [1, 5, 9]
    up = df.select(sketch.random_bits(F.col("key"), 0.1, 100)).first()[0]
    assert 0 < len(up) <= 10 and all(0 <= x < 100 for x in up)


def test_minhash(spark):
    df = spark.createDataFrame([([],), ([3, 700],)], "bits array<int>").select("bits", sketch.minhash(F.col("bits"), 10, "s").alias("sig"))
    got = {tuple(r[0]): r[1] for r in df.collect()}
    pairs = sketch.coefficients(10, "s")
    assert got[()] == [2147483647] * 10
    assert got[(3, 700)] == [min((a * x + b) % (2**31 - 1) for x in (3, 700)) for a, b in pairs]
    sim = spark.createDataFrame([([1, 2], [1, 3]), ([1], [1, 2]), ([], [])], "a array<bigint>, b array<bigint>").select(sketch.signature_jaccard(F.col("a"), F.col("b")))
    assert [r[0] for r in sim.collect()] == [0.5, 0.0, 0.0]


def test_qgrams(spark):
    assert one(spark, "aa", lambda c: sketch.qgram_counts(c, 2, "$")) == {"$a": 1, "aa": 1, "a$": 1}
    assert one(spark, "", lambda c: sketch.qgram_counts(c, 2, "$")) == {"$$": 1}
    df = spark.createDataFrame([({"a": 2, "b": 1}, {"a": 1, "c": 1})], "x map<string,int>, y map<string,int>")
    r = df.select(sketch.qgram_similarity(F.col("x"), F.col("y")), sketch.qgram_distance(F.col("x"), F.col("y")), sketch.qgram_similarity(F.col("x"), F.col("y"), False), sketch.qgram_distance(F.col("x"), F.col("y"), False)).first()
    assert list(r) == [0.25, 3, 0.0, -1]
    assert one(spark, "a", lambda c: sketch.gram_set(c, 2)) == ["a"]
    assert one(spark, "abc", sketch.ngram_bag) == ["abc", "ab", "bc", "abc"]


def test_codecs(spark):
    import base64

    df = spark.createDataFrame([([0, 63, 64, 999],)], "bits array<int>")
    code = df.select(codec.bloom_encode(F.col("bits"), 1000, 5)).first()[0]
    raw = base64.b64decode(code)
    assert raw[:8] == (1000).to_bytes(4, "little") + (5).to_bytes(4, "little") and len(raw) == 136
    words = int.from_bytes(raw[8:], "little")
    assert {i for i in range(1024) if words >> i & 1} == {0, 63, 64, 999}
    back = one(spark, code, codec.bloom_decode)
    assert (back["m"], back["k"], back["bits"]) == (1000, 5, [0, 63, 64, 999])
    assert one(spark, base64.b64encode(raw[:-1]).decode(), codec.bloom_decode) is None
    assert one(spark, "not base64!", codec.bloom_decode) is None
    pairs = [(3, 4), (5, 6)]
    sig = spark.createDataFrame([([7, 2147483647],)], "s array<bigint>")
    obj = sig.select(codec.minhash_encode(F.col("s"), pairs)).first()[0]
    assert len(base64.b64decode(obj)) == 8 + 12 * 2
    assert one(spark, obj, codec.signature_decode) == [7, 2147483647]
    assert [tuple(x) for x in one(spark, obj, codec.coefficients_decode)] == pairs
    bare = sig.select(codec.signature_encode(F.col("s"))).first()[0]
    assert base64.b64decode(bare) == (7).to_bytes(4, "big") + (2147483647).to_bytes(4, "big")
    assert one(spark, bare, codec.signature_decode) == [7, 2147483647]
    grams = spark.createDataFrame([({"ab": 2},)], "g map<string,int>").select(codec.qgram_decode(codec.qgram_encode(F.col("g"), 2, "$")).alias("d")).first()[0]
    assert grams["q"] == 2 and grams["grams"] == {"ab": 2} and grams["padding"] == "$"


def test_tokens(spark):
    for key in (b"salt", b"x" * 100):
        want = hmac.new(key, b"Hello", hashlib.sha256).hexdigest()
        assert one(spark, "Hello", lambda c: tokens.hmac_sha256(c, key)) == want
    key, other = "ab" * 32, "cd" * 32
    df = spark.createDataFrame([("text",)], "v string").select(tokens.encrypted(F.encode("v", "UTF-8"), key).alias("c"))
    r = df.select(F.length("c"), F.decode(tokens.decrypted(F.col("c"), key), "UTF-8"), tokens.decrypted(F.col("c"), other)).first()
    assert list(r) == [12 + 4 + 16, "text", None]


def test_codecs_read_numbers_at_their_place_in_the_bytes(spark):
    """Plans of the decoders take parts of the binary, never of its text, whose places are counted from the start each time."""
    import base64 as b64
    import struct

    from pyspark.sql import functions as F

    from kindred.functions import codec

    values, pairs = [0, 1, 255, 256, 65535, 2**31 - 1], [(7, 2**31 - 2), (2**24, 0), (3, 4), (5, 6), (8, 9), (10, 11)]
    words = bytearray(24)
    for b in (0, 7, 8, 63, 64, 129):
        words[b // 8] |= 1 << b % 8
    bloom = b64.b64encode(struct.pack("<II", 130, 3) + bytes(words)).decode()
    whole = b64.b64encode(struct.pack("<I", 6) + b"".join(struct.pack("<I", x) for x in (*(a for a, _ in pairs), *(b for _, b in pairs), 2**31 - 1, *values))).decode()
    df = spark.createDataFrame([(bloom, whole, values, [0, 7, 8, 63, 64, 129]), ("!", "AAA=", None, None)], "f string, s string, v array<long>, b array<int>")
    out = df.select(codec.bloom_decode(F.col("f")).alias("f"), codec.signature_decode(F.col("s")).alias("s"), codec.coefficients_decode(F.col("s")).alias("c"), codec.minhash_encode(F.col("v"), pairs).alias("e"), codec.bloom_encode(F.col("b"), 130, 3).alias("g"))
    one, two = out.collect()
    assert (tuple(one["f"]), one["s"], list(map(tuple, one["c"])), one["e"], one["g"]) == ((130, 3, [0, 7, 8, 63, 64, 129]), values, pairs, whole, bloom)
    assert two["f"] is None and two["s"] is None and two["c"] is None
    assert "hex(substr" in out._jdf.queryExecution().optimizedPlan().toString().replace(" ", "")


def test_signatures_by_a_table_are_those_computed_anew():
    import numpy as np

    from kindred.functions import sketch, vectors

    rng = np.random.default_rng(3)
    for m, s in ((100, 1000), (1000, 100), (7, 3)):
        pairs = sketch.coefficients(s, "kindred")
        held = [np.sort(rng.choice(m, min(m, int(n)), replace=False)) for n in rng.integers(0, 70, 600)] + [np.zeros(0, np.int64)] * 2
        ends = np.cumsum([len(x) for x in held])
        own = np.concatenate(held).astype(np.int64)
        want = vectors.signatures(own, ends, pairs)
        got = vectors.signatures(own, ends, pairs, m)
        assert got.dtype == want.dtype and (got == want).all()
        plain = [min([(a * int(x) + b) % sketch.PRIME for x in held[0]], default=sketch.PRIME) for a, b in pairs]
        assert got[0].tolist() == plain
    assert vectors.signatures(np.zeros(0, np.int64), np.zeros(2, np.int64), pairs, 7).min() == sketch.PRIME


def test_grams_are_compared_in_one_walk(spark):
    from kindred.functions import sketch

    rows = [("banana", "bandana"), ("", ""), ("aa", "zz"), ("same", "same")]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", *[sketch.qgram_counts(F.col(c), 2, "$").alias(f"{c}_") for c in "ab"])
    both = df.select("a", "b", "a_", "b_", sketch.qgram_compared(F.col("a_"), F.col("b_")).alias("c"), sketch.qgram_similarity(F.col("a_"), F.col("b_")).alias("s"), sketch.qgram_distance(F.col("a_"), F.col("b_")).alias("d"))
    for r in both.collect():
        grams = set(r["a_"]) | set(r["b_"])
        x, y = ([m.get(g, 0) for g in grams] for m in (r["a_"], r["b_"]))
        low, high = sum(map(min, x, y)), sum(map(max, x, y))
        assert (r["c"]["similarity"], r["c"]["distance"]) == (r["s"], r["d"]) == (low / high, high - low)
