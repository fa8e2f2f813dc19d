"""From rows of strings to encoded records (id, bits, signature, qgrams)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import normalize as N
from kindred.functions import sketch as S
from kindred.functions.lineage import cut
from kindred.functions.vectors import sketched
from kindred.plans.profiles import Profile


def _bloom_values(value: Column, profile: Profile) -> Column:
    if profile.grams == "padded":
        return S.gram_set(N.packed(value), profile.q)
    if profile.grams == "bag":
        return S.ngram_bag(F.lower(value))
    return F.array(N.bloom_text(value))


def records(df: DataFrame, fields: list[str], profile: Profile, id_col: str | None = "id", order: list[str] | None = None, anonymous: bool = False) -> DataFrame:
    """Encode `fields` ('method:column' or 'column') of every row.

    Null and empty values are skipped, rows without any value dropped. The id is `id_col`, or, without
    one, record_N (anonymous_N if `anonymous`) with N counted over the kept rows in the given order.
    """
    return encoded(_valued(df, fields, profile, id_col, order, anonymous), profile)


def _valued(df: DataFrame, fields: list[str], profile: Profile, id_col: str | None = "id", order: list[str] | None = None, anonymous: bool = False) -> DataFrame:
    """(id, values array<string>) of the rows that have any value."""
    kinds = {f.name.lower(): f for f in df.schema.fields}
    values = []
    for column, method in map(N.parse_field, fields):
        field = kinds.get(column.lower())
        if field is None:
            continue
        raw = F.col(f"`{field.name}`")
        values.append(N.normalized(raw, method, field.dataType) if profile.methods else N.text(raw))
    have = F.filter(F.array(*values), lambda v: v != "") if values else F.array().cast("array<string>")
    numbered = df.withColumn("_values", have).where(F.size("_values") > 0)
    if id_col and id_col in df.columns and not anonymous:
        key = F.col(id_col).cast("string")
    else:
        prefix = "anonymous_" if anonymous else "record_"
        numbered = _numbered(numbered, order)
        key = F.concat(F.lit(prefix), F.col("_n").cast("string"))
    return numbered.select(key.alias("id"), F.col("_values").alias("values"))


#: Distinct values that one task encodes, at about.
DISTINCT_ROWS = 25_000


def distinct_records(df: DataFrame, fields: list[str], profile: Profile, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """`records` of rows of equal values encoded once: (id, bits, signature) of each, by number, and (member, id), whose they are.
    Noise differs from row to row, so a profile with any is an error."""
    if profile.noise or profile.random_bits:
        raise ValueError("noise differs from row to row")
    own = cut(_valued(df, fields, profile, id_col))
    held = cut(own.select("values").distinct().withColumn("n", F.monotonically_increasing_id()))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-held.count() // DISTINCT_ROWS))
    coded = encoded(held.select(F.col("n").alias("id"), "values").repartition(tasks, "id"), profile)
    return coded.select("id", "bits", "signature"), own.join(held, "values").select(F.col("id").alias("member"), F.col("n").alias("id"))


def _numbered(df: DataFrame, order: list[str] | None) -> DataFrame:
    """df with _n from 1 in the given order, by counts of sorted partitions: no task sees all rows."""
    order = order or [F.monotonically_increasing_id()]
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    # The id counts rows within a partition in its low 33 bits.
    return placed.join(F.broadcast(offsets), "_p").withColumn("_n", F.col("_before") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)) + 1)


def encoded(df: DataFrame, profile: Profile) -> DataFrame:
    """(id, values array<string>) to (id, bits, signature, qgrams); qgrams are those of the last value."""
    last = N.bloom_text(F.element_at("values", -1))
    parts = F.flatten(F.transform("values", lambda v: _bloom_values(v, profile)))
    own = df.select("id", F.size("values").alias("_n"), last.alias("_last"), parts.alias("_parts"))
    # Grams are counted after the sketches, so that who does not read them does not pay for them.
    out = sketched(own, "_parts", profile.m, profile.k, profile.s, profile.seed).withColumn("qgrams", S.qgram_counts(F.col("_last"), profile.q, profile.pad))
    if profile.random_bits or profile.noise:
        bits = F.col("bits")
        if profile.random_bits:
            bits = S.bloom_union(bits, S.random_bits(F.concat_ws("|", F.lit(profile.noise_seed), "id"), profile.random_bits, profile.m))
        if profile.noise:
            # One round of flips for every value added.
            for j in range(_most_values(df)):
                key = F.concat_ws("|", F.lit(profile.noise_seed), F.col("id"), F.lit(str(j)))
                bits = F.when(F.col("_n") > j, S.flipped(bits, key, profile.noise, profile.m)).otherwise(bits)
        out = out.withColumn("bits", bits).withColumn("signature", S.minhash(F.col("bits"), profile.s, profile.seed))
    return out.select("id", "bits", "signature", "qgrams")


def _most_values(df: DataFrame) -> int:
    return df.agg(F.max(F.size("values"))).first()[0] or 0


def updated(have: DataFrame, more: DataFrame, profile: Profile) -> DataFrame:
    """Records of `have` with the values of `more` (id, values) added; the signature is computed anew."""
    new = encoded(more, profile).select("id", F.col("bits").alias("_new"), F.col("qgrams").alias("_grams"))
    joined = have.join(new, "id", "left").withColumn("bits", F.when(F.col("_new").isNull(), F.col("bits")).otherwise(S.bloom_union(F.col("bits"), F.col("_new"))))
    return joined.select("id", "bits", S.minhash(F.col("bits"), profile.s, profile.seed).alias("signature"), F.coalesce("_grams", "qgrams").alias("qgrams"))
