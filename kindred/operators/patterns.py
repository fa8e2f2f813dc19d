"""Similarity patterns of filters and signatures, and their salted hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.codec import base64, bloom_words

#: Segments of a filter, bytes of one that count, tolerance levels; buckets of a signature, their places and levels.
SEGMENTS, SEGMENT_BYTES, BLOOM_LEVELS = 4, 8, 4
BUCKETS, BUCKET_PLACES, SIGNATURE_LEVELS = 5, 8, 5
SALT = "PSI_SALT"


def _small_hex(h: Column) -> Column:
    """Lower-case hex without leading zeros, '0' for zero."""
    short = F.regexp_replace(F.lower(h), "^0+", "")
    return F.when(short == "", F.lit("0")).otherwise(short)


def _little(bytes_: list[Column]) -> Column:
    return F.concat(*[F.lpad(F.hex(b), 2, "0") for b in reversed(bytes_)])


def bloom_patterns(bits: Column, m: int) -> list[Column]:
    """Segments of the filter's bytes at several tolerances, and one global pattern."""
    n = (m + 63) // 64 * 8
    words = bloom_words(bits, m)
    byte = lambda i: F.conv(F.substring(words, 2 * i + 1, 2), 16, 10).cast("bigint")
    size = n // SEGMENTS
    out = []
    for i in range(SEGMENTS):
        for level in range(BLOOM_LEVELS):
            mask = 0xFF << (2 * level) & 0xFF
            held = [byte(i * size + j).bitwiseAND(F.lit(mask).cast("bigint")) for j in range(min(size, SEGMENT_BYTES))]
            out.append(F.concat(F.lit(f"bloom_seg_{i}_tol_{level}:"), _small_hex(_little(held))))
    folded = [byte(j).bitwiseXOR(byte(j + 8)) if j + 8 < min(n, 16) else byte(j) for j in range(8)]
    out.append(F.concat(F.lit("bloom_global:"), _small_hex(_little(folded[2:]))))
    return out


def signature_patterns(signature: Column, s: int) -> list[Column]:
    """Folded buckets of the signature at several tolerances, and one global pattern."""

    def folded(start: int, n: int, shift: int) -> Column:
        return F.aggregate(F.slice(signature, start + 1, n), F.lit(0).cast("bigint"), lambda x, v: x.bitwiseXOR(F.shiftright(v, shift)))

    out = []
    for b in range(min(BUCKETS, s // BUCKET_PLACES)):
        value = folded(b * BUCKET_PLACES, BUCKET_PLACES, 4)
        for level in range(SIGNATURE_LEVELS):
            masked = value.bitwiseAND(F.lit(0xFFFFFFFF >> (4 * level)).cast("bigint"))
            out.append(F.concat(F.lit(f"mh_bucket_{b}_tol_{level}:"), _small_hex(F.hex(masked))))
    out.append(F.concat(F.lit("mh_global:"), _small_hex(F.hex(F.shiftright(folded(0, min(32, s), 12), 8)))))
    return out


def salted_hash(c: Column) -> Column:
    return base64(F.unhex(F.substring(F.sha2(F.concat(F.lit(SALT), c), 256), 1, 32)))


def pattern_hashes(records: DataFrame, m: int, s: int) -> DataFrame:
    """(id, hash): the salted hash of all of a record's patterns in order, signature first."""
    patterns = signature_patterns(F.col("signature"), s) + bloom_patterns(F.col("bits"), m)
    return records.select("id", salted_hash(F.concat_ws("||", *patterns)).alias("hash"))
