"""The registered queries of the linkage engine over the driver's tables, and their DuckDB equivalents."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import codec, normalize, sketch, tokens
from kindred.functions.lineage import cut, new_path
from kindred.operators import blocking, curve, evaluate, patterns, synth
from kindred.operators.assign import best_pairs, one_to_one_classes
from kindred.operators.encode import encoded, records, updated
from kindred.operators.match import candidates, compared, exact_link, expanded, fuzzy_link, linked_classes, record_classes
from kindred.plans import oracles as O
from kindred.plans import workflows
from kindred.plans.profiles import HARNESS, SERVER, VALIDATE, WORKFLOW, Profile, Thresholds
from kindred.sources import audit, config, embedded, sinks, tables
from kindred.streaming import limits, matching

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FIELDS = ["name", "nation", "segment", "balance"]
#: Rows of one file of a replayed stream, at about.
SLICE_ROWS = 250_000
#: Customers that one task encodes, at about.
TASK_ROWS = 25_000


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def residents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation."""
    customers = table(spark, sf_dir, "customer")
    # Encoding is costly for a row's size: a small file is dealt out first, to all cores and to tasks of bounded rows.
    tasks = max(spark.sparkContext.defaultParallelism, -(-customers.count() // TASK_ROWS))
    if customers.rdd.getNumPartitions() < tasks:
        customers = customers.repartition(tasks)
    return customers.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))


def party(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Customers with their nation as one party (a), and as the other (b) with errors, some as other people."""
    return residents(spark, sf_dir).selectExpr(*O.PARTIES[side])


def encoded_party(spark: SparkSession, sf_dir: str, side: str, profile: Profile = VALIDATE) -> DataFrame:
    return records(party(spark, sf_dir, side), FIELDS, profile)


def bands(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    return blocking.buckets(encoded_party(spark, sf_dir, side), places=VALIDATE.s)


def mixed_party(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """A party whose records' filters have several shapes, written to token rows and read from them, as their m and k are."""
    rows = residents(spark, sf_dir).selectExpr(*O.PARTIES[side], f"{O.SHAPE_OF[side]} as kind")
    out = None
    for i, (m, k) in enumerate(O.SHAPES):
        profile = replace(VALIDATE, m=m, k=k)
        part = tables.token_records(sinks.token_rows(records(rows.where(f"kind = {i}"), FIELDS, profile), profile, "t"))
        out = part if out is None else out.unionByName(part)
    return out


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both parties' records, written to the shared folder, as plans read them several times."""
    return tuple(cut(encoded_party(spark, sf_dir, side).select("id", "bits", "signature")) for side in "ab")


def own_classes(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The first party's classes of equal records, by `columns` if any are given, and their members."""
    return record_classes(party(spark, sf_dir, "a"), FIELDS, VALIDATE, columns or ("bits", "signature"))


def both_classes(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, DataFrame]]:
    """Both parties' classes of records with equal filters and signatures, and their members; rows of equal values are encoded once."""
    return [record_classes(party(spark, sf_dir, side), FIELDS, VALIDATE) for side in "ab"]


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").where(O.SAME_PERSON)
    return own.selectExpr("concat('a', cast(c_custkey as string)) as id1", "concat('b', cast(c_custkey as string)) as id2")


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.col("distance").cast("long")) if "distance" in df.columns else df


# --- normalization


@query(O.NORMALIZE_NAME)
def normalize_name(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{O.RAW_NAME} as raw").select("c_custkey", normalize.name(F.col("raw")).alias("name"))


@query(O.NORMALIZE_DATE)
def normalize_date(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{O.RAW_DATE} as raw")
    return raw.select("o_orderkey", normalize.date(F.col("raw")).alias("date"))


@query(O.NORMALIZE_GENDER)
def normalize_gender(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{O.RAW_GENDER} as raw")
    return raw.select("c_custkey", normalize.gender(F.col("raw")).alias("gender"))


@query(O.NORMALIZE_ZIP)
def normalize_zip(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{O.RAW_ZIP} as raw")
    return raw.select("c_custkey", normalize.zip_code(F.col("raw")).alias("zip"))


@query(O.NORMALIZE_BASIC)
def normalize_basic(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select("o_orderkey", normalize.basic(F.col("o_orderdate"), kinds["o_orderdate"]).alias("date"), normalize.basic(F.concat(F.lit("  "), "o_orderpriority", F.lit(" "))).alias("priority"))


@query(O.NORMALIZE_STRING)
def normalize_string(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return df.select("p_partkey", normalize.bloom_text(F.concat_ws("--", "p_name", "p_brand", "p_type")).alias("bloom_text"), normalize.packed(F.col("p_type")).alias("packed"))


@query(O.HMAC_TOKEN)
def hmac_token(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("zip"))
    return df.select("c_custkey", tokens.token(df, ["c_name", "zip", "missing"], "pepper").alias("token"))


# --- q-grams, Bloom filters, MinHash


@query(O.QGRAM_EXTRACT)
def qgram_extract(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.explode(sketch.qgram_counts(normalize.bloom_text(F.col("p_name")), 2, "$")).alias("gram", "n"))
    return df.select("p_partkey", "gram", F.col("n").cast("long").alias("n"))


@query(O.QGRAM_COMPARE)
def qgram_compare(spark, sf_dir):
    own = table(spark, sf_dir, "part").select("p_partkey", "p_size", sketch.qgram_counts(normalize.bloom_text(F.col("p_name")), 2, "$").alias("g"))
    other = own.select(F.col("p_partkey").alias("other"), F.col("g").alias("h"))
    pairs = own.withColumn("other", F.col("p_partkey") + F.col("p_size")).join(other, "other")
    both = pairs.select("p_partkey", "other", sketch.qgram_compared(F.col("g"), F.col("h")).alias("c"))
    return both.select("p_partkey", "other", F.round("c.similarity", 9).alias("similarity"), F.col("c.distance").cast("long").alias("distance"))


@query(O.GRAM_SETS)
def gram_sets(spark, sf_dir):
    v = F.lower(F.col("p_brand"))
    df = table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(sketch.gram_set(v, 2)), "|").alias("gram_set"), F.array_join(F.array_sort(sketch.ngram_bag(v)), "|").alias("gram_bag"))
    return df


@query(O.QGRAM_FREQUENCY)
def qgram_frequency(spark, sf_dir):
    text = normalize.bloom_text(F.col("p_name"))
    counts = sketch.qgram_counts(text, 2, "$")
    first = sketch.qgram_frequency(counts, F.concat(F.lit("$"), F.substring(text, 1, 1)))
    return table(spark, sf_dir, "part").select("p_partkey", first.cast("long").alias("n_first"), sketch.qgram_frequency(counts, F.lit("??")).cast("long").alias("n_absent"))


@query(O.QGRAM_CODEC)
def qgram_codec(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", sketch.qgram_counts(normalize.bloom_text(F.col("p_name")), 2, "$").alias("g"))
    coded = df.withColumn("code", codec.qgram_encode(F.col("g"), 2, "$"))
    back = codec.qgram_decode(F.col("code"))
    entries = lambda g: F.array_sort(F.map_entries(g))
    return coded.select("p_partkey", "code", (entries(back["grams"]) == entries(F.col("g"))).alias("same"))


@query(O.BLOOM_ENCODE)
def bloom_encode(spark, sf_dir):
    return encoded_party(spark, sf_dir, "a").select("id", F.array_join("bits", ",").alias("bits"))


@query(O.BLOOM_TEST)
def bloom_test(spark, sf_dir):
    df = records(party(spark, sf_dir, "a"), FIELDS, VALIDATE).join(party(spark, sf_dir, "a").select("id", "name"), "id")
    return df.select("id", sketch.bloom_test(F.col("bits"), normalize.bloom_text(F.col("name"))).alias("has_name"), sketch.bloom_test(F.col("bits"), F.lit("absent value")).alias("has_absent"))


@query(O.BLOOM_HAMMING)
def bloom_hamming(spark, sf_dir):
    a, b = (encoded_party(spark, sf_dir, side).select(F.substring("id", 2, 20).alias("k"), F.col("bits").alias(side)) for side in "ab")
    return a.join(b, "k").select("k", sketch.hamming(F.col("a"), F.col("b")).cast("long").alias("distance"))


@query(O.BLOOM_CODEC)
def bloom_codec(spark, sf_dir):
    df = encoded_party(spark, sf_dir, "a").select("id", "bits", codec.bloom_encode(F.col("bits"), 1000, 5).alias("code"))
    back = codec.bloom_decode(F.col("code"))
    return df.select("id", "code", (back["bits"] == F.col("bits")).alias("same"))


@query(O.BLOOM_NOISE)
def bloom_noise(spark, sf_dir):
    noisy = Profile(methods=False, noise=0.01, random_bits=0.02, noise_seed="7")
    return encoded_party(spark, sf_dir, "a", noisy).select("id", F.array_join("bits", ",").alias("bits"))


@query(O.MINHASH_SIGNATURE)
def minhash_signature(spark, sf_dir):
    return encoded_party(spark, sf_dir, "a").select("id", F.array_join("signature", ",").alias("signature"))


@query(O.MINHASH_JACCARD)
def minhash_jaccard(spark, sf_dir):
    a, b = (encoded_party(spark, sf_dir, side).select(F.substring("id", 2, 20).alias("k"), F.col("signature").alias(side)) for side in "ab")
    return a.join(b, "k").select("k", F.round(sketch.signature_jaccard(F.col("a"), F.col("b")), 9).alias("similarity"))


@query(O.MINHASH_STRICT)
def minhash_jaccard_strict(spark, sf_dir):
    a, b = (encoded_party(spark, sf_dir, side).select(F.substring("id", 2, 20).alias("k"), F.col("signature").alias(side)) for side in "ab")
    return a.join(b, "k").select("k", F.round(sketch.signature_jaccard_strict(F.col("a"), F.col("b")), 9).alias("similarity"))


@query(O.MINHASH_LENGTHS)
def minhash_lengths(spark, sf_dir):
    """Signatures of which a third are cut to half their length: different lengths have nothing in common."""
    a, b = (encoded_party(spark, sf_dir, side).select(F.substring("id", 2, 20).alias("k"), F.col("signature").alias(side)) for side in "ab")
    short = F.when(F.col("k").cast("long") % 3 == 0, F.slice("a", 1, 50)).otherwise(F.col("a"))
    return a.join(b, "k").select("k", F.round(sketch.signature_jaccard(short, F.col("b")), 9).alias("similarity"))


@query(O.MINHASH_CODEC)
def minhash_codec(spark, sf_dir):
    pairs = list(sketch.coefficients(100, "kindred"))
    df = encoded_party(spark, sf_dir, "a").select("id", "signature", codec.minhash_encode(F.col("signature"), pairs).alias("code"), codec.signature_encode(F.col("signature")).alias("bare"))
    same = (codec.signature_decode(F.col("code")) == F.col("signature")) & (codec.signature_decode(F.col("bare")) == F.col("signature"))
    return df.select("id", F.md5("code").alias("code_md5"), "bare", same.alias("same"))


# --- records


def _zipped(spark, sf_dir):
    return party(spark, sf_dir, "b").withColumn("zipped", F.lit("12345-678")).drop("id")


@query(O.RECORDS_WORKFLOW)
def records_workflow(spark, sf_dir):
    out = records(_zipped(spark, sf_dir), ["name:name", "zip:zipped", "segment"], WORKFLOW, order=["name", "segment", "balance"])
    return out.select("id", F.array_join("bits", ",").alias("bits"), F.array_join("signature", ",").alias("signature"))


@query(O.RECORDS_ANONYMOUS)
def records_anonymous(spark, sf_dir):
    return records(_zipped(spark, sf_dir), ["name"], WORKFLOW, order=["name", "segment", "balance"], anonymous=True).select("id")


@query(O.RECORDS_SERVER)
def records_server(spark, sf_dir):
    out = records(party(spark, sf_dir, "a"), ["name", "segment"], SERVER)
    return out.select("id", F.array_join("bits", ",").alias("bits"), F.md5(F.array_join("signature", ",")).alias("signature_md5"))


@query(O.RECORD_UPDATE)
def record_update(spark, sf_dir):
    own = party(spark, sf_dir, "a")
    have = records(own, ["name", "nation"], VALIDATE)
    more = own.select("id", F.array(F.col("segment"), F.col("balance")).alias("values"))
    out = updated(have, more, VALIDATE)
    return out.select("id", F.array_join("bits", ",").alias("bits"), F.array_join("signature", ",").alias("signature"))


# --- linkage


@query(O.EXACT_LINK)
def exact_linkage(spark, sf_dir):
    a, b = (encoded_party(spark, sf_dir, side) for side in "ab")
    return exact_link(a, b)


@query(O.FUZZY_LINK)
def fuzzy_linkage(spark, sf_dir):
    (a, of_a), (b, of_b) = both_classes(spark, sf_dir)
    out = expanded(linked_classes(a, b), of_a, of_b)
    return out.select("id1", "id2", F.col("distance").cast("long").alias("distance"), F.round("similarity", 9).alias("similarity"))


@query(O.COMPATIBLE)
def compatible_link(spark, sf_dir):
    """Parties whose filters differ in size and hash functions, as files of several settings do: only those of one shape are
    compared, by the fuzzy link, the exact link, and for given pairs."""
    a, b = (cut(mixed_party(spark, sf_dir, side)) for side in "ab")
    fuzzy = fuzzy_link(a, b).select(F.lit("fuzzy").alias("kind"), "id1", "id2", "distance", "similarity")
    exact = exact_link(a, b).select(F.lit("exact").alias("kind"), "id1", "id2", F.lit(0).alias("distance"), F.lit(1.0).alias("similarity"))
    same = a.select(F.col("id").alias("id1"), F.substring("id", 2, 20).alias("n")).join(b.select(F.col("id").alias("id2"), F.substring("id", 2, 20).alias("n")), "n").select("id1", "id2")
    given = compared(same, a, b).select(F.lit("given").alias("kind"), "id1", "id2", "distance", "similarity")
    out = fuzzy.unionByName(exact).unionByName(given)
    return out.select("kind", "id1", "id2", F.col("distance").cast("long").alias("distance"), F.round("similarity", 9).alias("similarity"))


@query(O.CANDIDATES)
def link_candidates(spark, sf_dir):
    a, b = both(spark, sf_dir)
    return candidates(a, b, 10).select("id1", "id2", F.col("distance").cast("long").alias("distance"))


@query(O.PAIR_MATCH)
def pair_match(spark, sf_dir):
    a, b = both(spark, sf_dir)
    out = compared(expected(spark, sf_dir), a, b)
    return out.select("id1", "id2", F.col("distance").cast("long").alias("distance"), F.round("similarity", 9).alias("similarity"))


@query(O.ONE_TO_ONE)
def one_to_one_link(spark, sf_dir):
    (a, of_a), (b, of_b) = both_classes(spark, sf_dir)
    return one_to_one_classes(linked_classes(a, b), of_a, of_b)


@query(O.ONE_TO_ONE)
def assignment_rounds(spark, sf_dir):
    """The assignment by rounds alone: nothing is left to the driver."""
    (a, of_a), (b, of_b) = both_classes(spark, sf_dir)
    return one_to_one_classes(linked_classes(a, b), of_a, of_b, settled=0)


@query(O.PRIORITY_FIRST)
def assignment_first_round(spark, sf_dir):
    """Pairs that are the best of both their ids: the first round of the assignment."""
    return best_pairs(*_matched_classes(spark, sf_dir))


# --- blocking


@query(O.LSH_BUCKETS)
def lsh_buckets(spark, sf_dir):
    return bands(spark, sf_dir, "a").select("id", F.col("band").cast("long").alias("band"), "bucket_id")


@query(O.LSH_CANDIDATES)
def lsh_candidates(spark, sf_dir):
    return workflows.class_candidates(*own_classes(spark, sf_dir, "signature"))


@query(O.BLOCKING_STATS)
def blocking_stats(spark, sf_dir):
    out = blocking.statistics(bands(spark, sf_dir, "a"))
    return out.withColumn("avg_bucket_size", F.round("avg_bucket_size", 9))


@query(O.TWO_PARTY)
def two_party_lsh(spark, sf_dir):
    return workflows.class_blocks(*both_classes(spark, sf_dir)).select("id1", "id2", "n_shared", F.col("distance").cast("long").alias("distance"), F.round("similarity", 9).alias("similarity"))


@query(O.MATCHING_BUCKETS)
def matching_buckets(spark, sf_dir):
    a, b = (bands(spark, sf_dir, side) for side in "ab")
    return blocking.matching_buckets(a, b, multiplicity=True)


@query(O.BUCKET_JOIN)
def encrypted_bucket_join(spark, sf_dir):
    """Buckets of both parties met under two keys: the join on plain buckets must find the same rows."""
    one, two = b"\x11" * 32, b"\x22" * 32
    # Buckets and points are read twice each, for their distinct values and for the join: written, they are made once.
    a, b = (cut(bands(spark, sf_dir, side).select("id", "bucket_id")) for side in "ab")
    a2 = curve.doubly_encrypted(cut(curve.encrypted_buckets(a, one)), two)
    b2 = curve.doubly_encrypted(cut(curve.encrypted_buckets(b, two)), one)
    return a2.select("double", F.col("id").alias("id1")).join(b2.select("double", F.col("id").alias("id2")), "double").select("id1", "id2").distinct()


@query(O.WITHIN)
def within_duplicates(spark, sf_dir):
    out = workflows.class_within(*own_classes(spark, sf_dir))
    return out.select("id1", "id2", F.col("distance").cast("long").alias("distance"), F.round("similarity", 9).alias("similarity"))


@query(O.HOT_BUCKETS)
def hot_buckets(spark, sf_dir):
    """Pairs within and across buckets of which one holds a third of all rows, in tiles of small chunks."""
    c, s = (table(spark, sf_dir, name).selectExpr(f"{i} as id", f"{k} as bucket_id") for name, (i, k) in O.SKEWED.items())
    within = blocking.candidate_pairs(c, tile=64).select(F.lit("within").alias("kind"), "id1", "id2", "bucket_id")
    return within.unionByName(blocking.matching_buckets(c, s, tile=64).select(F.lit("across").alias("kind"), "id1", "id2", "bucket_id"))


@query(O.CANDIDATE_CAP)
def candidate_cap(spark, sf_dir):
    """The option that caps candidate pairs, in order of ids."""
    return blocking.candidate_pairs(blocking.buckets(cut(encoded_party(spark, sf_dir, "a").select("id", "signature")), places=VALIDATE.s), 100)


@query(O.PIPELINE_COUNTS)
def pipeline_counts(spark, sf_dir):
    out = workflows.class_within_counted(*own_classes(spark, sf_dir))[1]
    return out.withColumn("avg_bucket_size", F.round("avg_bucket_size", 9)).drop("processing_ms")


@query(O.TWO_PARTY_COUNTS)
def two_party_counts(spark, sf_dir):
    return workflows.class_blocks_counted(*both_classes(spark, sf_dir))[1]


@query(O.PATTERN_HASHES)
def pattern_hashes(spark, sf_dir):
    return patterns.pattern_hashes(encoded_party(spark, sf_dir, "a"), 1000, 100)


# --- evaluation


def _matches(spark, sf_dir):
    """Matches of parties, those with few differing fields, not assigned."""
    return expanded(*_matched_classes(spark, sf_dir)).select("id1", "id2")


def _matched_classes(spark, sf_dir):
    """The same by classes of equal records, with the members of both parties' classes."""
    (a, of_a), (b, of_b) = both_classes(spark, sf_dir)
    return linked_classes(a, b, Thresholds(10, 0.32)), of_a, of_b


@query(O.LINK_EVALUATE)
def link_evaluate(spark, sf_dir):
    return _rounded(evaluate.evaluate_classes(*_matched_classes(spark, sf_dir), expected(spark, sf_dir)))


@query(O.LINK_EVALUATE_BOTH)
def harness_evaluate(spark, sf_dir):
    return _rounded(evaluate.evaluate_classes(*_matched_classes(spark, sf_dir), expected(spark, sf_dir), both_ways=True))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("true_positives", "false_positives", "false_negatives", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(O.REPEATED_MATCHES)
def repeated_matches(spark, sf_dir):
    """Both evaluations of matches of which a half occurs twice and a third the wrong way round."""
    found = cut(_matches(spark, sf_dir)).withColumn("n", F.regexp_replace("id1", "[^0-9]", "").cast("long"))
    twice = found.where("n % 3 <> 0").select("id1", "id2").unionByName(found.where("n % 2 = 0").select("id1", "id2"))
    given = twice.unionByName(found.where("n % 3 = 0").selectExpr("id2 as id1", "id1 as id2"))
    given, truth = cut(given), expected(spark, sf_dir)
    kinds = (("pairs", evaluate.evaluate), ("both ways", evaluate.evaluate_bidirectional))
    one, two = (_rounded(f(given, truth)).withColumn("kind", F.lit(kind)) for kind, f in kinds)
    return one.unionByName(two)


@query(O.LABELLED)
def labelled_pairs(spark, sf_dir):
    return evaluate.labelled(_matches(spark, sf_dir), expected(spark, sf_dir))


@query(O.DIFFERENCE)
def intersection_diff(spark, sf_dir):
    other = expected(spark, sf_dir).selectExpr("id2 as id1", "id1 as id2")
    return evaluate.difference_classes(*_matched_classes(spark, sf_dir), other)


@query(O.DIFFERENCE_SUMMARY)
def diff_summary(spark, sf_dir):
    other = expected(spark, sf_dir).selectExpr("id2 as id1", "id1 as id2")
    return evaluate.difference_summary_classes(*_matched_classes(spark, sf_dir), other)


@query(O.ALL_NAMED)
def match_stats(spark, sf_dir):
    return evaluate.all_named(expected(spark, sf_dir))


@query(O.REPORT)
def validation_report(spark, sf_dir):
    return evaluate.report(_matches(spark, sf_dir), expected(spark, sf_dir))[0]


@query(O.REPORT_DETAIL)
def report_file(spark, sf_dir):
    """The labelled pairs of a report that was written and read back."""
    path = new_path(spark, "report")
    sinks.write_report(evaluate.report(cut(_matches(spark, sf_dir)), expected(spark, sf_dir)), path)
    return tables.report_file(spark, path)[1]


@query(O.SAMPLES)
def report_samples(spark, sf_dir):
    return evaluate.samples(evaluate.labelled(_matches(spark, sf_dir), expected(spark, sf_dir)))


# --- sources, sinks, streams


@query(O.LAST_OF_KEY)
def last_of_key(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias(tables.POSITION))
    return tables.last_of_key(own, "key").select("key", "status", F.col(tables.POSITION).alias("position"))


@query(O.PAGE)
def page(spark, sf_dir):
    return tables.page(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 20, 15, "c_custkey")


@query(O.GROUND_TRUTH)
def ground_truth(spark, sf_dir):
    own = table(spark, sf_dir, "orders").selectExpr("concat(' ', cast(o_custkey as string)) as id1", "case when o_orderkey % 9 = 0 then ' ' else concat(cast(o_orderkey as string), ' ') end as id2", f"o_orderkey as {tables.POSITION}")
    return evaluate.truth(own)


@query()
def token_round_trip(spark, sf_dir):
    own = encoded_party(spark, sf_dir, "a")
    rows = sinks.token_rows(own, VALIDATE, "2024-01-01T00:00:00Z")
    back = tables.token_records(rows, recompute=True)
    return back.select("id", F.array_join("bits", ",").alias("bits"), F.array_join("signature", ",").alias("signature"))


ORACLES["token_round_trip"] = O.RECORDS


@query()
def encrypted_round_trip(spark, sf_dir):
    key = "00112233445566778899aabbccddeeff" * 2
    own = table(spark, sf_dir, "nation").select("n_name", tokens.encrypted(F.encode("n_name", "UTF-8"), key).alias("c"))
    return own.select("n_name", F.decode(tokens.decrypted(F.col("c"), key), "UTF-8").alias("back"), tokens.decrypted(F.col("c"), "0" * 64).isNull().alias("wrong_key_fails"))


ORACLES["encrypted_round_trip"] = "select n_name, n_name as back, true as wrong_key_fails from nation"


@query("select concat('a', c_custkey) as id, true as same, true as wrong_key_fails from customer")
def encrypted_token_round_trip(spark, sf_dir):
    """The round trip over the token rows of a whole party."""
    key = "00112233445566778899aabbccddeeff" * 2
    rows = sinks.token_rows(encoded_party(spark, sf_dir, "a"), VALIDATE, "2024-01-01T00:00:00Z")
    own = rows.select("id", F.concat_ws(",", *rows.columns).alias("line")).withColumn("c", tokens.encrypted(F.encode("line", "UTF-8"), key))
    back = F.decode(tokens.decrypted(F.col("c"), key), "UTF-8")
    return own.select("id", back.eqNullSafe(F.col("line")).alias("same"), tokens.decrypted(F.col("c"), "0" * 64).isNull().alias("wrong_key_fails"))


@query(O.RATE_LIMIT)
def rate_limit(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return limits.rate_limited(own, "user_id", "ts", "event_id", limit=2, seconds=86400).select("event_id", "user_id", "allowed")


@query(O.CONNECTIONS)
def connection_count(spark, sf_dir):
    own = table(spark, sf_dir, "events").selectExpr("event_id", "ts", "user_id", "case when event_id % 3 = 0 then 1 else -1 end as delta")
    return limits.connections(own, "user_id", "ts", "event_id", "delta").select("event_id", F.col("open").cast("long").alias("open"))


@query(O.SYNTHETIC_LINK)
def synthetic_link(spark, sf_dir):
    n1, n2, base, noise = O.SYNTHETIC
    first, second, true = synth.patients(spark, n1, n2, base / n1, noise / 1000)
    fields = ["first_name", "last_name", "dob", "ssn", "address", "phone"]
    a, b = (encoded(df.select("id", F.array(*fields).alias("values")), HARNESS) for df in (first, second))
    return evaluate.evaluate_bidirectional(workflows.two_party_blocks(a, b, Thresholds(100, 0.32)).select("id1", "id2"), true)


def _replayed(spark, own: DataFrame, decide, parts: int = 3) -> DataFrame:
    """What a stream makes of rows that arrive in order of ts, a slice of time a micro-batch, read back from what it wrote."""
    folder, out = new_path(spark, "events"), new_path(spark, "decided")
    own = cut(own)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = own.select(micros.cast("double").alias("t")).approxQuantile("t", [i / parts for i in range(1, parts)], 0.01)
    bounds = [None, *sorted(set(cuts)), None]
    # Each slice of time is as many files, written by as many tasks, and read as one micro-batch.
    files = max(1, own.count() // parts // SLICE_ROWS)
    for i, (low, high) in enumerate(zip(bounds, bounds[1:]), 1):
        within = (F.lit(True) if low is None else micros > low) & (F.lit(True) if high is None else micros <= high)
        part = own.where(within)
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(folder)
        if len(spark.read.parquet(folder).inputFiles()) != i * files:
            raise RuntimeError("a slice of time has too few rows for its files")
    stream = matching.read_rows(spark, folder, own.schema, files)
    decide(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query(O.RATE_LIMIT)
def rate_limit_stream(spark, sf_dir):
    """The rate limit over a stream whose state ends with each key's window."""
    own = table(spark, sf_dir, "events").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id")
    decide = lambda stream: limits.rate_limited_stream(stream.withWatermark("ts", "0 seconds"), "user_id", "ts", "event_id", limit=2, seconds=86400)
    return _replayed(spark, own, decide).select("event_id", "user_id", "allowed")


@query(O.CONNECTIONS)
def connection_stream(spark, sf_dir):
    """The count of open connections over a stream."""
    own = table(spark, sf_dir, "events").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "case when event_id % 3 = 0 then 1 else -1 end as delta")
    return _replayed(spark, own, lambda stream: limits.connections_stream(stream, "user_id", "ts", "event_id", "delta")).select("event_id", "open")


@query(O.NULLS)
def normalize_null(spark, sf_dir):
    """A null is '' under every method."""
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", *[f(none).alias(n) for n, f in (*normalize.METHODS.items(), ("basic", normalize.basic))])


# --- files, databases and streams: written to the shared folder, read back from it


def _csv_customers(spark, sf_dir) -> str:
    path = new_path(spark, "customers.csv")
    own = table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as string) as custkey", f"{O.ODD_TEXT} as text", "case when c_custkey % 5 = 0 then null else c_mktsegment end as segment")
    own.write.options(**sinks.CSV_OPTIONS).csv(path, header=True)
    return path


@query(O.CSV_SOURCE)
def csv_source(spark, sf_dir):
    """A configured CSV source whose fields hold commas, quotes and line breaks."""
    return tables.load(spark, config.load({"database": {"type": "csv", "filename": _csv_customers(spark, sf_dir)}}).database).select("custkey", "text", "segment")


@query(O.CSV_GET)
def csv_get(spark, sf_dir):
    return tables.get(tables.rows(spark, _csv_customers(spark, sf_dir)), "custkey", "7").select("custkey", "text", "segment")


@query(O.TOKEN_FILES)
def token_files(spark, sf_dir):
    """A party's tokens through files of every kind."""
    rows, key = cut(sinks.token_rows(encoded_party(spark, sf_dir, "a"), VALIDATE, "2024-01-01T00:00:00Z")), "00112233445566778899aabbccddeeff" * 2
    out = None
    for kind in O.TOKEN_KINDS:
        path = new_path(spark, f"tokens.{'json' if kind.startswith('json') else 'csv'}")
        if kind == "one_message":
            back = tables.decrypted_tokens(cut(sinks.encrypted_messages(rows, key)), key)
        elif kind == "frames":
            path = new_path(spark, "tokens.enc")
            sinks.write_encrypted(rows, path, key, most=500, one=0)
            back = tables.encrypted_tokens(spark, path, key)
        else:
            sinks.write_tokens(rows, path, kind)
            back = tables.workflow_tokens(spark, path) if kind == "csv" else tables.tokens_file(spark, path)
        part = tables.token_records(back).select(F.lit(kind).alias("kind"), "id", F.array_join("bits", ",").alias("bits"), F.array_join("signature", ",").alias("signature"))
        out = part if out is None else out.unionByName(part)
    return out


@query(O.TOKEN_STATISTICS)
def token_statistics(spark, sf_dir):
    return tables.token_statistics(sinks.token_rows(encoded_party(spark, sf_dir, "a"), VALIDATE, "t")).drop("sample_id")


@query(O.TOKEN_PAGE)
def token_page(spark, sf_dir):
    return tables.token_page(sinks.token_rows(encoded_party(spark, sf_dir, "a"), VALIDATE, "t"), 20, 15).select("id")


@query(O.RECORDS)
def record_lines(spark, sf_dir):
    """A party's records as JSON lines."""
    path = new_path(spark, "records")
    sinks.write_record_lines(encoded_party(spark, sf_dir, "a"), path, VALIDATE)
    return tables.record_lines(spark, path).select("id", F.array_join("bits", ",").alias("bits"), F.array_join("signature", ",").alias("signature"))


@query(O.MATCH_FILES)
def match_files(spark, sf_dir):
    """Matches through files of every kind; ids hold commas and quotes."""
    own = table(spark, sf_dir, "customer").selectExpr("concat('a', cast(c_custkey as string), ', \"x\"') as id1", "concat('b', cast(c_custkey as string)) as id2")
    out = None
    for kind in O.MATCH_KINDS:
        path = new_path(spark, kind)
        if kind == "intersection":
            sinks.write_intersection(own, path)
        elif kind == "export":
            sinks.export(own, path, "json")
        else:
            sinks.write_matches(own, path, kind)
        part = tables.matches_file(spark, path).select(F.lit(kind).alias("kind"), "id1", "id2")
        out = part if out is None else out.unionByName(part)
    return out


@query(O.STREAM_LINK)
def stream_link(spark, sf_dir):
    """The second party's rows as a stream of files, each micro-batch matched with the first party, from the files it writes."""
    rows, out = new_path(spark, "rows"), new_path(spark, "matched")
    own = party(spark, sf_dir, "b")
    own.repartition(3).write.parquet(rows)
    peer = cut(encoded_party(spark, sf_dir, "a").select("id", "bits", "signature"))
    matching.start(matching.read_rows(spark, rows, own.schema), peer, FIELDS, out, new_path(spark, "progress"), VALIDATE, Thresholds(), time="2024-01-01T00:00:00Z").awaitTermination()
    found = spark.read.schema("Local_ID string, Peer_ID string, Timestamp string").options(**sinks.CSV_OPTIONS).csv(f"{out}/csv", header=True)
    return found.select(F.col("Peer_ID").alias("id1"), F.col("Local_ID").alias("id2"), F.col("Timestamp").alias("timestamp"))


@query(O.EXCHANGE)
def exchange_summary(spark, sf_dir):
    """Both parties link from token files, exchange their results as files, and compare them."""
    folder = new_path(spark, "exchange")
    for side in "ab":
        sinks.write_tokens(sinks.token_rows(encoded_party(spark, sf_dir, side), VALIDATE, "t"), f"{folder}/{side}.csv")
    return workflows.exchange(spark, f"{folder}/a.csv", f"{folder}/b.csv", folder, Thresholds(10, 0.32))


@query(O.AUDIT_LINES)
def audit_lines(spark, sf_dir):
    own = table(spark, sf_dir, "events")
    return own.select("event_id", audit.audit_lines(own, F.col("event_type"), F.col("ts"), "s1", ["user_id", "event_id"]).alias("line"))


def database(spark: SparkSession, rows: DataFrame, types: str) -> tuple[str, dict]:
    """(url, options) of a new embedded database with the rows as table PEOPLE: in a local session one in memory, which Spark's
    tasks have written, else an archive in the shared folder, as executors have processes of their own."""
    options = {"driver": embedded.DRIVER}
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return embedded.archived(rows, "PEOPLE", types), options
    url = f"jdbc:derby:memory:kindred{uuid.uuid4().hex};create=true"
    rows.write.option("createTableColumnTypes", types).jdbc(url, "PEOPLE", properties=options)
    return url, options


@query(O.DATABASE)
def database_source(spark, sf_dir):
    """A database table in ranges of keys, a row of it by key, a page of it by number and the one after a key."""
    people = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "case when c_custkey % 3 = 0 then null else c_name end as name")
    url, options = database(spark, people, "id BIGINT")
    every = tables.jdbc(spark, url, "PEOPLE", parts=4, **options)
    parts = [("all", every), ("get", tables.jdbc_get(spark, url, "PEOPLE", "7", **options)), ("page", tables.jdbc_page(spark, url, "PEOPLE", 40, 25, **options)), ("after", tables.jdbc_after(spark, url, "PEOPLE", 60, 25, **options))]
    named = [df.toDF("id", "name").select(F.lit(kind).alias("kind"), "id", "name") for kind, df in parts]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])
