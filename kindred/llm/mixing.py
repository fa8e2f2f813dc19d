"""Mixing sources to target weights, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import fresh

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the hash that make a uniform number.
DIGITS = 13


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that the seed and the key decide."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """sizes: one row per source (source, source_size). Adds weight and target.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes. A
    target stops at `most` times its source's size; what is above is shared by weight among the rest
    until none is above. In order of cap per weight the stopped sources come first, so running sums
    find the level at which the others stand.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", ((F.row_number().over(in_order) - 1) % 3 + 1).cast("long")).withColumn("cap", most * F.col("source_size"))
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    earlier, every = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    levels = weighed.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    found = levels.withColumn("level", F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("c"), F.col("level").alias("l")))).over(every)["l"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return found.select("source", "source_size", "weight", target.alias("target"))


def mix_plan(docs: DataFrame, seed: int = 11, most: int = 3) -> DataFrame:
    """docs with size, source_size, target and copies: floor(rate) plus one with probability rate - floor(rate).

    size: the words of the text (null: 0). rate: target over size of the source, at most `most`.
    The extra copy is a Bernoulli draw seeded by doc_id, so reruns agree; rows of equal doc_id draw
    alike. Null sources are one source. A source without words has rate 0. Words are counted in whole
    texts, whatever their length. Columns of `docs` named as the new ones are replaced, all others
    stay. An empty table gives an empty result.
    """
    own = docs.drop("size", "source_size", "target", "copies").withColumn("size", words(F.col("text")))
    sizes = own.groupBy("source").agg(F.sum("size").alias("source_size"))
    name = fresh(own, "goal_source")
    goals = targets(sizes, most).select(F.col("source").alias(name), "source_size", "target")
    # Few rows a source are left of the sizes; the optimiser sees their size and broadcasts or splits the hot source.
    joined = own.join(goals, own["source"].eqNullSafe(goals[name])).drop(name)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (uniform(seed, F.col("doc_id")) < rate - F.floor(rate)).cast("int")
    return joined.withColumn("copies", (F.floor(rate) + extra).cast("int"))


def mixed(docs: DataFrame, seed: int = 11, most: int = 3) -> DataFrame:
    """The mix itself: every document as often as its source's rate says, with the columns of `docs`, whatever their names."""
    held = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text")
    return mix_plan(held, seed, most).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")
