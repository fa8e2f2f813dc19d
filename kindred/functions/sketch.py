"""q-grams, Bloom filters and MinHash signatures as Catalyst expressions.

A Bloom filter is its sorted array<int> of set bits; words and base64 only appear at the codecs.
FNV-1a of 64 bits runs on two 32-bit limbs, as 64-bit products overflow under ANSI rules.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a 64: offset basis in two limbs; the prime is 2**40 + 435.
FNV_HI, FNV_LO, FNV_PRIME_LOW = 3421674724, 2216829733, 435
#: Modulus of the MinHash functions.
PRIME = 2**31 - 1
_LIMB = 4294967295


def once(value: Column, f) -> Column:
    """f(value) with `value` computed once a row, also where f uses it in a lambda: the optimiser may inline it there otherwise."""
    return F.element_at(F.transform(F.array(value), lambda v: f(v)), 1)


def utf8_bytes(c: Column) -> Column:
    """The bytes of a string as array<bigint>."""
    latin = F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    places = F.filter(F.sequence(F.lit(0), F.length(latin)), lambda i: i > 0)
    return F.transform(places, lambda i: F.ascii(F.substr(latin, i, F.lit(1))).cast("bigint"))


def fnv1a(data: Column, start: Column | None = None) -> Column:
    """FNV-1a of an array of bytes as struct(hi, lo)."""
    start = F.struct(F.lit(FNV_HI).cast("bigint").alias("hi"), F.lit(FNV_LO).cast("bigint").alias("lo")) if start is None else start

    def step(h: Column, b: Column) -> Column:
        low = h["lo"].bitwiseXOR(b)
        product = low * FNV_PRIME_LOW
        high = h["hi"] * FNV_PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(F.lit(_LIMB)).alias("hi"), product.bitwiseAND(F.lit(_LIMB)).alias("lo"))

    return F.aggregate(data, start, step)


def fnv1a_hex(c: Column) -> Column:
    h = fnv1a(utf8_bytes(c))
    return F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0")))


def _limb_bytes(limb: Column) -> list[Column]:
    return [F.shiftright(limb, 8 * i).bitwiseAND(F.lit(255).cast("bigint")) for i in range(4)]


def bloom_indices(c: Column, m: int, k: int) -> Column:
    """The k bits that a value sets: FNV-1a of the little-endian (seed xor i) before the value, modulo m."""
    scale = 2**32 % m

    def of(data: Column) -> Column:
        return once(fnv1a(data), lambda seed: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: _index(seed, i, data, m, scale)))

    return once(utf8_bytes(c), of)


def _index(seed: Column, i: Column, data: Column, m: int, scale: int) -> Column:
    head = F.array(*_limb_bytes(seed["lo"].bitwiseXOR(i.cast("bigint"))), *_limb_bytes(seed["hi"]))
    return once(fnv1a(F.concat(head, data)), lambda s: (((s["hi"] % m) * scale + s["lo"]) % m).cast("int"))


def bloom(values: Column, m: int = 1000, k: int = 5) -> Column:
    """Set bits of the filter that holds all strings of the array `values`."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.array_distinct(values), lambda v: bloom_indices(v, m, k)))))


def bloom_test(bits: Column, value: Column, m: int = 1000, k: int = 5) -> Column:
    return F.forall(bloom_indices(value, m, k), lambda i: F.array_contains(bits, i))


def bloom_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def seeded_bits(key: Column, n: int, m: int) -> Column:
    """n bit places that the key decides, with repeats."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: F.conv(F.substr(F.sha2(F.concat_ws("|", key, j.cast("string")), 256), F.lit(1), F.lit(12)), 16, 10).cast("bigint") % m) if n else F.array().cast("array<bigint>")


def random_bits(key: Column, share: float, m: int) -> Column:
    """floor(m * share) seeded places to set up front."""
    return F.array_sort(F.array_distinct(seeded_bits(key, int(m * share), m).cast("array<int>")))


def flipped(bits: Column, key: Column, share: float, m: int) -> Column:
    """`bits` after floor(m * share) seeded flips, a place flipped twice staying as it was."""
    n = int(m * share)
    if not n:
        return bits
    places = seeded_bits(key, n, m).cast("array<int>")

    def odd(drawn: Column) -> Column:
        return F.filter(F.array_distinct(drawn), lambda p: F.size(F.filter(drawn, lambda q: q == p)) % 2 == 1)

    def flip(own: Column) -> Column:
        return once(once(places, odd), lambda flips: F.array_sort(F.concat(F.array_except(own, flips), F.array_except(flips, own))))

    return once(bits, flip)


def hamming(a: Column, b: Column) -> Column:
    return F.size(a) + F.size(b) - 2 * F.size(F.array_intersect(a, b))


def compatible(a: Column, b: Column) -> Column:
    """Whether two decoded filters, struct(m, k, bits), have the same size and number of hash functions."""
    return (a["m"] == b["m"]) & (a["k"] == b["k"])


def filter_distance(a: Column, b: Column) -> Column:
    """Hamming distance of two decoded filters; null if their size or number of hash functions differs."""
    return F.when(compatible(a, b), hamming(a["bits"], b["bits"]))


def filter_distance_strict(a: Column, b: Column) -> Column:
    """The same, but filters that cannot be compared are an error."""
    shape = lambda x: F.concat(x["m"].cast("string"), F.lit(" bits and "), x["k"].cast("string"), F.lit(" hash functions"))
    wrong = F.raise_error(F.concat(F.lit("incompatible filters: "), shape(a), F.lit(", "), shape(b)))
    return F.when(compatible(a, b), hamming(a["bits"], b["bits"])).otherwise(wrong.cast("int"))


@lru_cache
def coefficients(s: int, seed: str) -> tuple[tuple[int, int], ...]:
    """s pairs (a in 1..p-2, b in 0..p-1) from SHA-256 of the seed and their number."""

    def draw(tag: str, i: int, n: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{seed}|{tag}|{i}".encode()).digest()[:8], "big") % n

    return tuple((1 + draw("a", i, PRIME - 2), draw("b", i, PRIME)) for i in range(s))


def minhash(bits: Column, s: int = 100, seed: str = "kindred", pairs: list[tuple[int, int]] | None = None) -> Column:
    """sig_i = min over set bits of (a_i x + b_i) mod p; p throughout for an empty filter."""
    pairs = pairs or coefficients(s, seed)
    literal = F.expr(f"array({', '.join(f"named_struct('a', {a}L, 'b', {b}L)" for a, b in pairs)})")
    return once(bits, lambda own: F.transform(literal, lambda c: F.coalesce(F.array_min(F.transform(own, lambda x: (c["a"] * x + c["b"]) % F.lit(PRIME))), F.lit(PRIME).cast("bigint"))))


def signature_jaccard(a: Column, b: Column) -> Column:
    """Share of equal places; 0 if the lengths differ or are 0."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), equal / F.size(a)).otherwise(F.lit(0.0))


def signature_jaccard_strict(a: Column, b: Column) -> Column:
    """Share of equal places; different lengths are an error, no places at all give NaN."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    wrong = F.raise_error(F.concat(F.lit("signatures of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"), F.lit(" places")))
    return F.when(F.size(a) != F.size(b), wrong.cast("double")).when(F.size(a) == 0, F.lit(float("nan"))).otherwise(same / F.size(a))


def qgrams(c: Column, q: int = 2, pad: str = "#") -> Column:
    """All q-grams of the value padded by q - 1 on both sides, in order."""
    q, pad = (2 if q < 1 else q), (pad or "#")
    full = F.concat(F.lit(pad * (q - 1)), c, F.lit(pad * (q - 1)))
    return F.transform(F.filter(F.sequence(F.lit(0), F.length(full) - (q - 1)), lambda i: i > 0), lambda i: F.substr(full, i, F.lit(q)))


def qgram_counts(c: Column, q: int = 2, pad: str = "#") -> Column:
    """map gram -> count."""
    return once(qgrams(c, q, pad), lambda grams: F.map_from_entries(F.transform(F.array_distinct(grams), lambda g: F.struct(g, F.size(grams) - F.size(F.array_remove(grams, g))))))


def qgram_frequency(counts: Column, gram: Column) -> Column:
    """How often a gram occurs; 0 if it does not."""
    return F.coalesce(F.try_element_at(counts, gram), F.lit(0))


def _least_and_greatest(a: Column, b: Column) -> Column:
    """struct(low, high): sums of the minima and maxima of both counts of every gram, in one walk over the grams of both."""
    zipped = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.struct(F.coalesce(x, F.lit(0)).alias("x"), F.coalesce(y, F.lit(0)).alias("y"))))
    none = F.struct(F.lit(0).alias("low"), F.lit(0).alias("high"))
    return F.aggregate(zipped, none, lambda s, p: F.struct((s["low"] + F.least(p["x"], p["y"])).alias("low"), (s["high"] + F.greatest(p["x"], p["y"])).alias("high")))


def _share(s: Column) -> Column:
    return F.when(s["high"] > 0, s["low"] / s["high"]).otherwise(F.lit(0.0))


def qgram_compared(a: Column, b: Column) -> Column:
    """struct(similarity, distance) of grams of one q, as `qgram_similarity` and `qgram_distance`, from one walk."""
    return once(_least_and_greatest(a, b), lambda s: F.struct(_share(s).alias("similarity"), (s["high"] - s["low"]).alias("distance")))


def qgram_similarity(a: Column, b: Column, same_q: bool = True) -> Column:
    """Weighted Jaccard: sum of minima over sum of maxima; 0 for different q or no grams."""
    return once(_least_and_greatest(a, b), _share) if same_q else F.lit(0.0)


def qgram_distance(a: Column, b: Column, same_q: bool = True) -> Column:
    """Sum of absolute differences; -1 for different q."""
    return once(_least_and_greatest(a, b), lambda s: s["high"] - s["low"]) if same_q else F.lit(-1)


def gram_set(c: Column, q: int = 2) -> Column:
    """Distinct q-grams padded by '_'; a value shorter than q stands for itself."""
    return F.when(F.length(c) < q, F.array(c)).otherwise(F.array_distinct(qgrams(c, q, "_")))


def ngram_bag(c: Column) -> Column:
    """The whole value, its 2-grams and its 3-grams, unpadded."""

    def grams(n: int) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.length(c) - (n - 1), F.lit(0))), lambda i: i > 0), lambda i: F.substr(c, i, F.lit(n)))

    return F.concat(F.array(c), grams(2), grams(3))
