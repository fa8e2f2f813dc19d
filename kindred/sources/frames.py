"""Encrypted files of several messages that belong together.

A line is a frame: 'file.number.count.message'. The file's random name, the frame's number and the count of all
frames are covered by each message's tag, so a frame fits one place of one file. A reader takes a file with every
number once, no other: a dropped, repeated, swapped or foreign frame fails it, as a changed one does.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import codec, tokens
from kindred.functions.lineage import cut


def _bound(file: Column, number: Column, count: Column) -> Column:
    return F.concat_ws("|", F.lit("frame"), file, number.cast("string"), count.cast("string"))


def sealed(texts: DataFrame, key_hex: str) -> DataFrame:
    """(value): the frames of (part, text), one a row; parts are distinct numbers."""
    held = cut(texts)
    places = held.select("part").withColumn("number", F.row_number().over(Window.orderBy("part")) - 1)  # small rows, one a message
    count, file = held.count(), F.lit(secrets.token_hex(16))
    numbered = held.join(places, "part")
    payload = tokens.encrypted(F.encode("text", "UTF-8"), key_hex, _bound(file, F.col("number"), F.lit(count)))
    return numbered.select(F.concat_ws(".", file, F.col("number").cast("string"), F.lit(str(count)), codec.base64(payload)).alias("value"))


def opened(frames: DataFrame, key_hex: str) -> DataFrame:
    """(text) of every message of one file's frames (value). What is missing, twice there or of another file is an error at
    once, a wrong key or a changed message when the text is read."""
    parts = F.split("value", r"\.", 4)
    held = frames.select(F.get(parts, F.lit(0)).alias("file"), F.expr("try_cast(get(split(value, '[.]', 4), 1) as long)").alias("number"), F.expr("try_cast(get(split(value, '[.]', 4), 2) as long)").alias("count"), F.get(parts, F.lit(3)).alias("message"))
    n = F.count(F.lit(1))
    seen = held.agg(n.alias("n"), F.count("message").alias("whole"), F.min("file").alias("f0"), F.max("file").alias("f1"), F.min("count").alias("c0"), F.max("count").alias("c1"), F.count_distinct("number").alias("numbers"), F.min("number").alias("first"), F.max("number").alias("last")).first()
    if not (seen["n"] and seen["n"] == seen["whole"] == seen["c0"] == seen["c1"] == seen["numbers"] and seen["f0"] == seen["f1"] and seen["first"] == 0 and seen["last"] == seen["n"] - 1):
        raise ValueError(f"frames missing, repeated or of other files: {seen['numbers']} numbers in {seen['n']} frames of a file of {seen['c1']}")
    payload = tokens.decrypted(F.unbase64("message"), key_hex, _bound(F.col("file"), F.col("number"), F.col("count")))
    return held.select(F.coalesce(F.decode(payload, "UTF-8"), F.raise_error(F.lit("decryption failed"))).alias("text"))
