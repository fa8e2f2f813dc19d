"""Keyed tokens and encrypted payloads as Catalyst expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.normalize import token_text


def hmac_sha256(message: Column, key: bytes) -> Column:
    """hex(HMAC-SHA256) of a string, by two native SHA-256 over literal pads."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ p for b in key).hex())) for p in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def token(df: DataFrame, fields: list[str], salt: str) -> Column:
    """HMAC of the fields' token texts joined by '|'; missing fields count as ''."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = [token_text(F.col(c), c, kinds[c]) if c in kinds else F.lit("") for c in fields]
    return hmac_sha256(F.concat_ws("|", *parts), salt.encode())


def encrypted(payload: Column, key_hex: str, bound: Column | None = None) -> Column:
    """AES-256-GCM: nonce (12), ciphertext, tag (16). bound: a string that the tag covers, and that is not in the message."""
    if len(key_hex) != 64:
        raise ValueError("a key has 64 hexadecimal digits")
    more = [] if bound is None else [F.lit("DEFAULT"), F.lit(b""), F.encode(bound, "UTF-8")]
    return F.aes_encrypt(payload, F.unhex(F.lit(key_hex)), F.lit("GCM"), *more)


def decrypted(payload: Column, key_hex: str, bound: Column | None = None) -> Column:
    """The payload, or null for a wrong key, damaged bytes or another bound string."""
    if len(key_hex) != 64:
        raise ValueError("a key has 64 hexadecimal digits")
    more = [] if bound is None else [F.lit("DEFAULT"), F.encode(bound, "UTF-8")]
    return F.try_aes_decrypt(payload, F.unhex(F.lit(key_hex)), F.lit("GCM"), *more)
