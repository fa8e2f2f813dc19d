"""The registered queries of this subpackage: thin, each through its operator, over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import byte_bpe, decontamination, html_text, mixing, near_duplicates, prefix_trie, ranked_search, sharding, suffix_dedup, token_counts, token_files, topk, toxicity
from kindred.llm.common import shared_folder, table, text_or_empty


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.default_vocabulary())


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_strings(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.round_trip(docs, token_counts.default_vocabulary(), ids=False)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = toxicity.fit(toxicity.sample(docs, table(spark, sf_dir, "labels")))
    out = toxicity.scored(docs, grammar, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    sharding.write_shards(sharding.document_shards(docs), path)
    text = text_or_empty()
    return spark.read.schema("doc_id long, text string, slot long, shard int").parquet(path).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    plan = mixing.mix_plan(docs)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.matches(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hits = F.col("hits")
    return out.select(
        "doc_id",
        (F.size(hits) > 0).cast("int").alias("contaminated"),
        F.array_sort(F.transform(hits, lambda h: h["item_id"])).alias("item_ids"),
        F.array_min(F.transform(hits, lambda h: h["distance"])).alias("least_distance"),
    )


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = byte_bpe.default_ranks()
    tokens = byte_bpe.encoded(table(spark, sf_dir, "documents"), path, pattern)
    return byte_bpe.decoded(tokens, path, pattern).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prefix_trie.sequences(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.branched(own)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_suffix_array, op3_token_files, op4_toxicity, op5_sharding, op6_ngram_jaccard, op7_mixing, op8_decontamination, op9_html_text, op10_top_k, op11_ranked_search, op12_byte_bpe, op13_prefix_trie)}

_OP7 = rf"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) as bigint) as size from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size from d group by source
), w as (
  select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight, 3 * source_size as cap from s
), l as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over e, 0))::double
            / (sum(weight) over () - coalesce(sum(weight) over e, 0))::double as level
  from w window e as (order by cap::double / weight, source nulls last rows between unbounded preceding and 1 preceding)
), f as (
  select *, min_by(level, cap::double / weight) filter (level * weight <= cap) over () as found from l
), t as (
  select source, source_size, least(cap::double, coalesce(found * weight, cap::double)) as target from f
), r as (
  select d.doc_id, d.size, cast(t.source_size as bigint) as source_size, t.target,
         case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
         ('0x' || substr(md5('11|' || d.doc_id), 1, {mixing.DIGITS}))::bigint::double / {float(16**mixing.DIGITS)!r} as u
  from d join t on d.source is not distinct from t.source
), c as (
  select *, cast(floor(rate) as integer) + (u < rate - floor(rate))::integer as copies from r
)
select doc_id, size, source_size, target, size * copies as taken, copies from c
"""

_OP10 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * x::double) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_OP11 = f"""
with d as (
  select row_number() over () as r, doc_id, {_TERMS} as terms from documents
), i as (
  select row_number() over () as q, item_id, list_distinct({_TERMS}) as terms from benchmark
), l as (
  select r, doc_id, len(terms) as n, terms from d where len(terms) > 0
), s as (
  select count(*) as docs, cast(sum(n) as bigint) as words from l
), a as (
  select q, item_id, unnest(terms) as term from i
), t as (
  select r, term, count(*) as tf from (select r, unnest(terms) as term from l) where term in (select term from a) group by r, term
), w as (
  select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as w from (select term, count(*) as df from t group by term), s
), g as (
  select q, item_id, doc_id, r, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words)))) as bigint) as score
  from a join t using (term) join w using (term) join l using (r), s group by q, item_id, doc_id, r
)
select item_id, cast(row_number() over (partition by q order by score desc, doc_id) as integer) as rank, doc_id, score from g where score > 0
qualify row_number() over (partition by q order by score desc, doc_id) <= 50
"""

_CRC = "xor(list_reduce(list_transform(range(1, length({c}) + 1), lambda i: ascii(substr({c}, i, 1))::bigint), lambda h, b: list_reduce(range(8), lambda y, i: case when y % 2 = 1 then xor(y // 2, 3988292384) else y // 2 end, xor(h, b)), 4294967295), 4294967295)"

_OP13 = rf"""
with s as (
  select conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} order by turn nulls first) as own from conversations where conv_id is not null group by conv_id
), h as (
  select *, {_CRC.format(c="conv_id::varchar")} % 4 as h from s
), x as (
  select h.conv_id, list_concat(coalesce(p.own[1:h.h], []), h.own[h.h + 1:]) as path from h left join s p on p.conv_id = h.conv_id - h.conv_id % 20
), d as (
  select conv_id, path, unnest(range(0, len(path) + 1)) as depth from x
), g as (
  select path[1:depth] as path, depth, min(conv_id) as conv_id, count(*) as n_convs,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (depth = len(path)), '')) as ends_sha256
  from d group by path[1:depth], depth
), c as (
  select g.*, p.conv_id as parent_conv_id, (select count(*) from g k where k.depth = g.depth + 1 and k.path[1:g.depth] = g.path) as n_children,
         case when g.depth > 0 then len(regexp_extract_all(g.path[g.depth].text, '{mixing.WORD}')) else 0 end as words
  from g left join g p on g.depth > 0 and p.depth = g.depth - 1 and p.path = g.path[1:g.depth - 1]
)
select a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, cast(count(*) filter (b.n_children = 0) as bigint) as n_leaves,
       cast(sum((b.n_convs - 1) * b.words) as bigint) as saved_tokens, a.ends_sha256
from c a join c b on b.depth >= a.depth and b.path[1:a.depth] = a.path
group by a.path, a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256
"""

ORACLES = {"op7_mixing": _OP7, "op10_top_k": _OP10, "op11_ranked_search": _OP11, "op13_prefix_trie": _OP13}
