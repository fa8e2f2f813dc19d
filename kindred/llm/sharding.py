"""Two-pass external shuffle into shards, with DataFrame operations only.

Pass one scatters the records by a seeded hash into buckets of a size that fits a task's memory.
Pass two shuffles each bucket (Spark's `shuffle` is the Fisher-Yates algorithm) and deals the
shuffled order out. A record's place in the whole order is the number of records in the buckets
before its own plus its place in the bucket; shard = place mod shards, slot = place div shards.
A bucket's task writes its part of every shard; the parts of a shard, in order of their slots, are
the shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import fresh

#: Bytes of records that one bucket holds in the mean.
BUCKET_BYTES = 16 << 20
#: Buckets that one task shuffles, one after the other, once there are more than PARTS of them.
PARTS, HELD = 1 << 14, 8


def sharded(records: DataFrame, key: list[str], size: Column, shards: int = 16, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The records with their columns and shard int, slot long; law `rows`: counts at most one apart.

    key: columns that tell records apart; they decide the bucket, so equal texts with different
    keys are spread. Records equal in all key columns share a bucket and are shuffled in it.
    size: bytes of a record, which set the number of buckets. Nulls in any column are kept (a null
    key hashes like any value). Columns named shard or slot in `records` are replaced, all other names
    are free. A record longer than a bucket makes its bucket as long. An empty table gives an empty
    result. Reruns with the same partition count of the buckets agree.
    """
    records = records.drop("shard", "slot")
    total = records.agg(F.sum(size.cast("long"))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    parts = math.ceil(buckets / min(HELD, math.ceil(buckets / PARTS)))
    bucket = F.pmod(F.xxhash64(F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in key]), F.lit(buckets)).cast("int")
    rest = [c for c in records.columns if c not in key]
    inner = F.struct(F.struct(*key).alias("key"), F.struct(F.lit(0).alias("none"), *[F.col(c) for c in rest]).alias("rest"))
    # From here on the records' columns are inside one, so that no name can clash.
    scattered = records.select(bucket.alias("bucket"), inner.alias("record"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row a bucket.
    offsets = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    dealt = (
        scattered.repartition(parts, "bucket")
        .groupBy("bucket")
        .agg(F.collect_list("record").alias("held"))
        # A fixed order before the shuffle, whatever order the records arrived in.
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle(F.array_sort("held"), seed).alias("held"))
    )
    place = dealt.join(offsets, "bucket").select("offset", F.posexplode("held").alias("i", "record")).withColumn("place", F.col("offset") + F.col("i"))
    columns = [F.col("record")["key" if c in key else "rest"][c].alias(c) for c in records.columns]
    return place.select(*columns, (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"))


def document_shards(docs: DataFrame, shards: int = 16, seed: int = 7, **options) -> DataFrame:
    """Documents (doc_id, text and other columns) in shards: equal ids with different texts are told apart, equal texts spread.

    A document's size is the UTF-8 bytes of its text (null: none) plus 1.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = fresh(docs, "text_crc")
    keyed = docs.withColumn(name, F.crc32(text.cast("binary")))
    return sharded(keyed, ["doc_id", name], F.octet_length(text) + 1, shards, seed, **options).drop(name)


def write_shards(records: DataFrame, path: str, **options) -> None:
    """What `sharded` returns, as shard folders under `path`, without another shuffle.

    Each task writes the parts that its buckets have in every shard, in slot order; columns other than shard stay.
    """
    records.sortWithinPartitions("shard", "slot").write.mode("overwrite").options(**options).partitionBy("shard").parquet(path)
