"""DuckDB equivalents of the registered queries, and the raw values that both sides share."""

from __future__ import annotations

from kindred.functions.normalize import GENDERS
from kindred.functions.sketch import PRIME, coefficients
from kindred.operators.synth import FIRST, LAST, STREETS

# Expressions that Spark and DuckDB read alike.
RAW_NAME = "case when c_custkey % 4 = 0 then concat('  ', upper(c_name), ' O''Connor-Smith ') when c_custkey % 4 = 1 then concat(c_mktsegment, ' ', c_name) when c_custkey % 4 = 2 then '---' else concat('José  ', c_mktsegment) end"
_D = "substr(cast(o_orderdate as string), 1, 10)"
_Y, _M, _DAY = f"substr({_D}, 1, 4)", f"substr({_D}, 6, 2)", f"substr({_D}, 9, 2)"
_INT = lambda x: f"cast(cast({x} as int) as string)"
RAW_DATE = f"""case o_orderkey % 8 when 0 then {_D} when 1 then concat({_M}, '/', {_DAY}, '/', {_Y}) when 2 then concat({_INT(_M)}, '/', {_INT(_DAY)}, '/', {_Y})
 when 3 then concat({_M}, '-', {_DAY}, '-', {_Y}) when 4 then concat({_Y}, '/', {_M}, '/', {_DAY}) when 5 then concat({_INT(_M)}, '/', {_INT(_DAY)}, '/', substr({_Y}, 3, 2))
 when 6 then concat(' Day ', {_D}) else '02/30/2020' end"""
_WORDS = ["Male", "f", "Enby", "prefer not to say", "fem", "x", "   ", "", "woman", " O ", "non-binary", "unknown"]
RAW_GENDER = "case c_custkey % 12 " + " ".join(f"when {i} then '{w}'" for i, w in enumerate(_WORDS)) + " end"
RAW_ZIP = "case when c_custkey % 3 = 0 then concat(cast(10000 + c_custkey as string), '-6789') when c_custkey % 3 = 1 then concat('a', cast(c_custkey as string), ' b') else 'abc' end"

_BALANCE = "cast(cast(c_acctbal as decimal(15,2)) as string)"
#: Every customer is in both parties; a fifth of the second's are other people: other ids and other names.
PARTIES = {
    "a": ["concat('a', cast(c_custkey as string)) as id", "c_name as name", "n_name as nation", "c_mktsegment as segment", f"{_BALANCE} as balance"],
    "b": [
        "case when c_custkey % 10 < 8 then concat('b', cast(c_custkey as string)) else concat('x', cast(c_custkey as string)) end as id",
        "case when c_custkey % 10 >= 8 then concat('stranger ', cast(c_custkey * 7 as string)) when c_custkey % 4 = 1 then upper(c_name) when c_custkey % 7 = 3 then substr(c_name, 1, length(c_name) - 1) else c_name end as name",
        "n_name as nation",
        "case when c_custkey % 11 = 5 then 'OTHER' else lower(c_mktsegment) end as segment",
        f"case when c_custkey % 10 >= 8 then concat('-', {_BALANCE}, '5') when c_custkey % 6 = 2 then '0.00' else {_BALANCE} end as balance",
    ],
}
#: The pairs of one person: those whose second row kept its id.
SAME_PERSON = "c_custkey % 10 < 8"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x0B\x{{85}}\p{{Z}}]+|[\s\x0B\x{{85}}\p{{Z}}]+$', '', 'g')"


def _bloom_text(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def _fnv(data: str) -> str:
    return f"list_reduce({data}, lambda h, b: (xor(h, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint, 14695981039346656037::uhugeint)"


def _party(side: str) -> str:
    return f"{side}_raw as (select {', '.join(PARTIES[side])} from customer join nation on c_nationkey = n_nationkey)"


_LITTLE = "[(s // p) % 256 for p in [1::uhugeint, 256::uhugeint, 65536::uhugeint, 16777216::uhugeint, 4294967296::uhugeint, 1099511627776::uhugeint, 281474976710656::uhugeint, 72057594037927936::uhugeint]]"


def _sketched(s: str, values: str, m: int = 1000, places: int = 100, k: int = 5) -> str:
    """CTEs from `values` (id, v), rows of strings, to <s>(id, bits, signature)."""
    literal = "[" + ", ".join(f"{{'a': {a}, 'b': {b}}}" for a, b in coefficients(places, "kindred")) + "]"
    return f"""{s}_v as ({values}),
{s}_d as (select v, list_transform(range(1, length(v) + 1), lambda i: ascii(substr(v, i, 1))::uhugeint) as b from (select distinct v from {s}_v)),
{s}_s as (select v, b, {_fnv('b')} as seed from {s}_d),
{s}_x as (select v, b, xor(seed, i::uhugeint) as s from {s}_s, range({k}) r(i)),
{s}_y as (select v, b, s, {_LITTLE} as le from {s}_x),
{s}_i as (select distinct v, ({_fnv('list_concat(le, b)')} % {m})::bigint as bit from {s}_y),
{s}_b as (select id, list_sort(list(distinct bit)) as bits from {s}_v join {s}_i using (v) group by id),
{s} as (select id, bits, list_transform({literal}, lambda c: list_min(list_transform(bits, lambda x: (c.a::bigint * x + c.b::bigint) % {PRIME}))) as signature from {s}_b)"""


def _encoded(side: str) -> str:
    """CTEs up to <side>(id, bits, signature)."""
    return f"{_party(side)}, {_sketched(side, f'select id, {_bloom_text("v")} as v from (select id, unnest([name, nation, segment, balance]) as v from {side}_raw) where v <> {chr(39) * 2}')}"


_H = "(len(a.bits) + len(b.bits) - 2 * len(list_intersect(a.bits, b.bits)))::bigint"
_J = "len(list_filter(list_zip(a.signature, b.signature), lambda z: z[1] = z[2])) / 100.0"
_AB = f"with {_encoded('a')}, {_encoded('b')}"
_A = f"with {_encoded('a')}"


def _linked(t: int) -> str:
    return f"""{_AB}, h as (select a.id as id1, b.id as id2, {_H} as distance, a.signature as s1, b.signature as s2 from a, b),
m as (select id1, id2, distance, round(len(list_filter(list_zip(s1, s2), lambda z: z[1] = z[2])) / 100.0, 9)::double as similarity from h where distance <= {t}),
f as (select * from m where similarity >= 0.32)"""


_EXPECTED = "e as (select 'a' || c_custkey as id1, 'b' || c_custkey as id2 from customer where " + SAME_PERSON + ")"

NORMALIZE_NAME = f"select c_custkey, trim(regexp_replace(regexp_replace(lower({_trim('raw')}), '[^a-z\\t\\n\\f\\r ]', '', 'g'), '[\\t\\n\\f\\r ]+', ' ', 'g')) as name from (select c_custkey, {RAW_NAME} as raw from customer)"

_FORMS = [(r"^\d{4}-\d{2}-\d{2}$", "%Y-%m-%d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "%m/%d/%Y"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "%m-%d-%Y"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "%Y/%m/%d")]
NORMALIZE_DATE = (
    "select o_orderkey, coalesce("
    + ", ".join(f"case when regexp_matches(raw, '{shape}') then strftime(try_strptime(raw, '{form}'), '%Y-%m-%d') end" for shape, form in _FORMS)
    + r", case when regexp_matches(raw, '^\d{1,2}/\d{1,2}/\d{2}$') then strftime(try_strptime(regexp_replace(raw, '(\d{2})$', case when right(raw, 2)::int >= 69 then '19' else '20' end || '\1'), '%m/%d/%Y'), '%Y-%m-%d') end"
    + f", lower({_trim('raw')})) as date from (select o_orderkey, {RAW_DATE} as raw from orders)"
)
_CASES = " ".join(f"when g in ({', '.join(repr(w) for w in words)}) then '{code}'" for code, words in GENDERS.items())
NORMALIZE_GENDER = f"select c_custkey, case when raw = '' then '' {_CASES} when g[1] in ('m', 'f', 'o', 'u') then g[1] else 'u' end as gender from (select c_custkey, raw, lower({_trim('raw')}) as g from (select c_custkey, {RAW_GENDER} as raw from customer))"
NORMALIZE_ZIP = f"select c_custkey, substr(regexp_replace({RAW_ZIP}, '[^0-9]', '', 'g'), 1, 5) as zip from customer"
NORMALIZE_BASIC = "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as date, lower(trim(o_orderpriority)) as priority from orders"
NORMALIZE_STRING = f"select p_partkey, {_bloom_text("concat_ws('--', p_name, p_brand, p_type)")} as bloom_text, lower(replace(p_type, ' ', '')) as packed from part"

_KEY = b"pepper".ljust(64, b"\0")
_PADS = ["".join(f"\\x{b ^ p:02X}" for b in _KEY) for p in (0x36, 0x5C)]
HMAC_TOKEN = f"select c_custkey, sha256('{_PADS[1]}'::blob || unhex(sha256('{_PADS[0]}'::blob || encode(lower(trim(c_name)) || '|' || replace(lower(trim(c_mktsegment)), ' ', '') || '|')))) as token from customer"

_GRAMS = f"g as (select p_partkey, p_size, substr(p, i, 2) as gram from (select p_partkey, p_size, '$' || {_bloom_text('p_name')} || '$' as p from part), range(1, length(p)) r(i)), c as (select p_partkey, p_size, gram, count(*) as n from g group by all)"
QGRAM_EXTRACT = f"with {_GRAMS} select p_partkey, gram, n from c"
QGRAM_COMPARE = f"""with {_GRAMS}, k as (select p.p_partkey, p.p_partkey + p.p_size as other from part p join part q on q.p_partkey = p.p_partkey + p.p_size),
u as (select k.p_partkey, k.other, c.gram, c.n as x, 0 as y from k join c using (p_partkey) union all select k.p_partkey, k.other, c.gram, 0, c.n from k join c on c.p_partkey = k.other),
s as (select p_partkey, other, gram, sum(x) as x, sum(y) as y from u group by all)
select p_partkey, other, round(sum(least(x, y)) / sum(greatest(x, y)), 9) as similarity, sum(abs(x - y))::bigint as distance from s group by all"""
GRAM_SETS = """with v as (select p_partkey, lower(p_brand) as v from part), s as (select p_partkey, v, '_' || v || '_' as p from v)
select p_partkey, (select string_agg(distinct substr(p, i, 2), '|' order by substr(p, i, 2)) from range(1, length(p)) r(i)) as gram_set,
array_to_string(list_sort(list_concat([v], list_transform(range(1, length(v)), lambda i: substr(v, i, 2)), list_transform(range(1, length(v) - 1), lambda i: substr(v, i, 3)))), '|') as gram_bag from s"""

BLOOM_ENCODE = f"{_A} select id, array_to_string(bits, ',') as bits from a"
BLOOM_TEST = f"""{_A}, x as (select 'absent value' as v), xd as (select v, list_transform(range(1, length(v) + 1), lambda i: ascii(substr(v, i, 1))::uhugeint) as b from x),
xs as (select v, b, {_fnv('b')} as seed from xd), xx as (select b, xor(seed, i::uhugeint) as s from xs, range(5) r(i)),
xy as (select b, [(s // p) % 256 for p in [1::uhugeint, 256::uhugeint, 65536::uhugeint, 16777216::uhugeint, 4294967296::uhugeint, 1099511627776::uhugeint, 281474976710656::uhugeint, 72057594037927936::uhugeint]] as le from xx),
xi as (select list(({_fnv('list_concat(le, b)')} % 1000)::bigint) as bits from xy)
select id, true as has_name, list_has_all(a.bits, xi.bits) as has_absent from a, xi"""
BLOOM_HAMMING = f"{_AB} select substr(a.id, 2) as k, {_H} as distance from a join b on substr(a.id, 2) = substr(b.id, 2)"
BLOOM_CODEC = f"""{_A}, w as (select id, bits, [list_sum([case when list_contains(bits, i * 8 + j) then (1 << j) else 0 end for j in range(8)])::int for i in range(128)] as bytes from a)
select id, to_base64(unhex('E803000005000000' || array_to_string([printf('%02X', x) for x in bytes], ''))) as code, true as same from w"""
MINHASH_SIGNATURE = f"{_A} select id, array_to_string(signature, ',') as signature from a"
MINHASH_JACCARD = f"{_AB} select substr(a.id, 2) as k, round({_J}, 9)::double as similarity from a join b on substr(a.id, 2) = substr(b.id, 2)"
MINHASH_LENGTHS = f"{_AB} select substr(a.id, 2) as k, case when substr(a.id, 2)::bigint % 3 = 0 then 0 else round({_J}, 9)::double end as similarity from a join b on substr(a.id, 2) = substr(b.id, 2)"
RECORDS = f"{_A} select id, array_to_string(bits, ',') as bits, array_to_string(signature, ',') as signature from a"
RECORD_UPDATE = RECORDS

EXACT_LINK = f"{_AB} select a.id as id1, b.id as id2 from a join b on a.bits = b.bits"
FUZZY_LINK = f"{_linked(20)} select * from f"
CANDIDATES = f"{_AB} select a.id as id1, b.id as id2, {_H} as distance from a, b where {_H} <= 10 and len(list_intersect(a.bits, b.bits)) > 0"
PAIR_MATCH = f"{_AB}, {_EXPECTED}, p as (select e.id1, e.id2, {_H} as distance, round({_J}, 9)::double as similarity from e join a on a.id = e.id1 join b on b.id = e.id2) select * from p where distance <= 20 and similarity >= 0.32"

#: Shapes (m, k) of filters, and which one a customer's filter has in each party: a fourth of the second party is shifted.
SHAPES = [(1000, 5), (1000, 5), (2000, 5), (1000, 7)]
SHAPE_OF = {"a": "c_custkey % 4", "b": "(c_custkey + case when c_custkey % 16 < 4 then 1 else 0 end) % 4"}


def _shaped(side: str) -> str:
    raw = f"{side}_raw as (select {', '.join(PARTIES[side])}, {SHAPE_OF[side]} as kind from customer join nation on c_nationkey = n_nationkey)"
    text = _bloom_text("v")
    parts = [(f"{side}{i}", m, k, _sketched(f"{side}{i}", f"select id, {text} as v from (select id, unnest([name, nation, segment, balance]) as v from {side}_raw where kind = {i}) where v <> ''", m, 100, k)) for i, (m, k) in enumerate(SHAPES)]
    union = " union all ".join(f"select *, {m} as m, {k} as k from {name}" for name, m, k, _ in parts)
    return f"{raw}, {', '.join(sql for *_, sql in parts)}, {side} as ({union})"


COMPATIBLE = f"""with {_shaped('a')}, {_shaped('b')}, h as (select a.id as id1, b.id as id2, a.m::bigint as m, a.k::bigint as k, {_H} as distance, round({_J}, 9)::double as similarity, a.bits = b.bits as same from a, b where a.m = b.m and a.k = b.k)
select 'fuzzy' as kind, id1, id2, distance, similarity from h where distance <= 20 and similarity >= 0.32
union all select 'exact', id1, id2, 0, 1.0 from h where same
union all select 'given', a.id, b.id, {_H}, round({_J}, 9)::double from a join b on substr(a.id, 2) = substr(b.id, 2) and a.m = b.m and a.k = b.k where {_H} <= 20 and {_J} >= 0.32"""
PRIORITY_FIRST = f"{_linked(10)}, q as (select id1, id2, sha256(id1 || '|' || id2) as h from f), r as (select id1, id2, array_to_string([substr(h, 2 * i + 1, 2) for i in [7, 6, 5, 4, 3, 2, 1, 0]], '') as p from q) select id1, id2 from r qualify p = max(p) over (partition by id1) and p = max(p) over (partition by id2)"



def _buckets(side: str) -> str:
    le = lambda x: f"printf('%02X%02X%02X%02X', {x} % 256, ({x} // 256) % 256, ({x} // 65536) % 256, {x} // 16777216)"
    s = side
    return f"{s}_k as (select id, band::bigint as band, 'block_' || substr(sha256(unhex({le('band')} || {le(f'signature[4 * band + 1]')} || {le(f'signature[4 * band + 2]')} || {le(f'signature[4 * band + 3]')} || {le(f'signature[4 * band + 4]')})), 1, 32) as bucket_id from {s}, range(25) r(band))"


LSH_BUCKETS = f"{_A}, {_buckets('a')} select id, band, bucket_id from a_k"
LSH_CANDIDATES = f"{_A}, {_buckets('a')} select x.id as id1, y.id as id2, min(x.bucket_id) as bucket_id from a_k x join a_k y on x.bucket_id = y.bucket_id and x.id < y.id group by all"
BLOCKING_STATS = f"""{_A}, {_buckets('a')}, z as (select bucket_id, count(*) as size from a_k group by bucket_id), o as (select list_sort(list(size)) as l from z)
select len(l) as total_buckets, list_sum(l)::bigint as total_records, round(list_sum(l) / len(l), 9) as avg_bucket_size, l[len(l) // 2 + 1] as median_bucket_size, l[len(l)] as max_bucket_size, l[1] as min_bucket_size from o"""
TWO_PARTY = f"""{_AB}, {_buckets('a')}, {_buckets('b')}, p as (select x.id as id1, y.id as id2, count(*) as n_shared from a_k x join b_k y using (bucket_id) group by x.id, y.id),
q as (select id1, id2, n_shared, {_H} as distance, round({_J}, 9)::double as similarity from p join a on a.id = id1 join b on b.id = id2) select * from q where distance <= 20 and similarity >= 0.32"""
MATCHING_BUCKETS = f"{_AB}, {_buckets('a')}, {_buckets('b')} select bucket_id, id as id1 from a_k where bucket_id in (select bucket_id from b_k)"

_COUNTS = "n as (select (select count(*) from f join e using (id1, id2)) as tp, (select count(*) from f) as all_, (select count(*) from e) as exp)"
_SCORES = "s as (select tp as true_positives, all_ - tp as false_positives, exp - tp as false_negatives, case when all_ > 0 then tp / all_ else 0 end as p, case when exp > 0 then tp / exp else 0 end as r from n)"
LINK_EVALUATE = f"{_linked(10)}, {_EXPECTED}, {_COUNTS}, {_SCORES} select true_positives, false_positives, false_negatives, round(p, 9) as precision, round(r, 9) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 9) as f1 from s"
LINK_EVALUATE_BOTH = LINK_EVALUATE
_PRF = "*, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0 end as r"
REPEATED_MATCHES = f"""{_linked(10)}, {_EXPECTED}, k as (select id1, id2, substr(id1, 2)::bigint as n from f),
g as (select id1, id2 from k where n % 3 <> 0 union all select id1, id2 from k where n % 2 = 0 union all select id2, id1 from k where n % 3 = 0),
o as (select count(*) filter (e.id1 is not null) as tp, count(*) filter (e.id1 is null) as fp from g left join e on g.id1 = e.id1 and g.id2 = e.id2),
w as (select count(*) filter (e.id1 is not null) as tp, count(*) filter (e.id1 is null) as fp from g left join e on (g.id1 = e.id1 and g.id2 = e.id2) or (g.id1 = e.id2 and g.id2 = e.id1)),
c as (select 'pairs' as kind, tp, fp, (select count(*) from (select id1, id2 from e except select id1, id2 from g)) as fn from o
  union all select 'both ways', tp, fp, greatest(0, (select count(*) from e) - tp) from w),
s as (select {_PRF} from c)
select kind, tp as true_positives, fp as false_positives, fn as false_negatives, round(p, 9) as precision, round(r, 9) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 9) as f1 from s"""
LABELLED = f"{_linked(10)}, {_EXPECTED} select case when e.id1 is null then 'FP' else 'TP' end as match_type, f.id1, f.id2 from f left join e on f.id1 = e.id1 and f.id2 = e.id2 union all select 'FN', id1, id2 from (select id1, id2 from e except select id1, id2 from f)"
DIFFERENCE = f"{_linked(10)}, {_EXPECTED} select 'local_only' as side, id1, id2 from f anti join e using (id1, id2) union all select 'peer_only', id2, id1 from e anti join f using (id1, id2)"
DIFFERENCE_SUMMARY = f"{_linked(10)}, {_EXPECTED}, {_COUNTS} select all_ as local_count, exp as peer_count, all_ - tp as local_only, exp - tp as peer_only, all_ = tp and exp = tp as equal from n"
ALL_NAMED = f"select count(*) as matches, true as all_named from customer where {SAME_PERSON}"

LAST_OF_KEY = "select cast(o_custkey as string) as key, last_value(o_orderstatus) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and unbounded following) as status, o_orderkey as position from orders"
PAGE = "select c_custkey, c_name from customer order by c_custkey limit 15 offset 20"
GROUND_TRUTH = "select cast(o_custkey as string) as id1, cast(max(o_orderkey) as string) as id2 from orders where o_orderkey % 9 <> 0 group by o_custkey"
CONNECTIONS = """with d as (select event_id, ts, user_id, sum(case when event_id % 3 = 0 then 1 else -1 end) over w as s from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)),
m as (select event_id, s, min(s) over (partition by user_id order by ts, event_id rows unbounded preceding) as low from d) select event_id, (s - least(0, low))::bigint as open from m"""

# --- codecs, noise and other profiles

QGRAM_FREQUENCY = f"with {_GRAMS} select p.p_partkey, coalesce(c.n, 0)::bigint as n_first, 0::bigint as n_absent from part p left join c on c.p_partkey = p.p_partkey and c.gram = '$' || substr({_bloom_text('p_name')}, 1, 1)"
QGRAM_CODEC = f"""with g as (select p_partkey, substr(p, i, 2) as gram, i from (select p_partkey, '$' || {_bloom_text('p_name')} || '$' as p from part), range(1, length(p)) r(i)),
c as (select p_partkey, gram, count(*) as n, min(i) as first from g group by all)
select p_partkey, to_base64(encode('{{"q":2,"grams":{{' || string_agg('"' || gram || '":' || n, ',' order by first) || '}},"padding":"$"}}')) as code, true as same from c group by p_partkey"""
_PAIRS = coefficients(100, "kindred")
_HEAD = "".join(x.to_bytes(4, "little").hex() for x in (100, *(a for a, _ in _PAIRS), *(b for _, b in _PAIRS), PRIME))
_LE = "printf('%02x%02x%02x%02x', x % 256, (x // 256) % 256, (x // 65536) % 256, x // 16777216)"
MINHASH_CODEC = f"""{_A} select id, md5(to_base64(unhex('{_HEAD}' || array_to_string(list_transform(signature, lambda x: {_LE}), '')))) as code_md5,
to_base64(unhex(array_to_string(list_transform(signature, lambda x: printf('%08x', x)), ''))) as bare, true as same from a"""


def _seeded(key: str, n: int) -> str:
    return f"list_transform(range(1, {n + 1}), lambda j: ('0x' || substr(sha256({key} || '|' || j), 1, 12))::bigint % 1000)"


BLOOM_NOISE = f"""{_A}, n as (select id, count(*) as n from a_v group by id),
u as (select id, bit from (select id, unnest(bits) as bit from a) union select id, unnest({_seeded("'7|' || id", 20)}) from a),
d as (select id, unnest({_seeded("'7|' || id || '|' || k", 10)}) as bit from n, range(0, 9) r(k) where k < n.n),
f as (select id, bit from d group by id, bit having count(*) % 2 = 1),
x as ((select * from u except select * from f) union (select * from f except select * from u))
select id, array_to_string(list_sort(list(bit)), ',') as bits from x group by id"""

_NAME = "trim(regexp_replace(regexp_replace(lower(name), '[^a-z ]', '', 'g'), ' +', ' ', 'g'))"
_WORKFLOW = f"w as (select 'record_' || row_number() over (order by name, segment, balance) as id, {_NAME} as name, segment from b_raw)"
RECORDS_WORKFLOW = f"""with {_party('b')}, {_WORKFLOW}, {_sketched('q', f"select id, {_bloom_text('v')} as v from (select id, unnest([name, '12345', lower(segment)]) as v from w) where v <> ''")}
select id, array_to_string(bits, ',') as bits, array_to_string(signature, ',') as signature from q"""
RECORDS_ANONYMOUS = f"with {_party('b')} select 'anonymous_' || row_number() over (order by name, segment, balance) as id from b_raw"
RECORDS_SERVER = f"""with {_party('a')}, p as (select id, replace(lower(v), ' ', '') as v from (select id, unnest([name, segment]) as v from a_raw) where v <> ''),
{_sketched('q', "select distinct id, substr('_' || v || '_', i, 2) as v from p, range(1, length(v) + 2) r(i)", 100, 1000)}
select id, array_to_string(bits, ',') as bits, md5(array_to_string(signature, ',')) as signature_md5 from q"""
MINHASH_STRICT = MINHASH_JACCARD

_BYTES = "[list_sum([case when list_contains(bits, i * 8 + j) then (1 << j) else 0 end for j in range(8)])::bigint for i in range(128)]"
_SMALL = lambda x: f"case when regexp_replace({x}, '^0+', '') = '' then '0' else regexp_replace({x}, '^0+', '') end"
_HEXED = lambda parts: " || ".join(f"printf('%02x', {x})" for x in parts)
_XOR = lambda start, n, shift: f"list_reduce([x >> {shift} for x in signature[{start + 1}:{start + n}]], lambda x, y: xor(x, y))"
_PATTERNS = [f"'mh_bucket_{b}_tol_{v}:' || printf('%x', {_XOR(b * 8, 8, 4)} & {0xFFFFFFFF >> 4 * v})" for b in range(5) for v in range(5)]
_PATTERNS += [f"'mh_global:' || printf('%x', {_XOR(0, 32, 12)} >> 8)"]
_PATTERNS += [f"'bloom_seg_{i}_tol_{v}:' || {_SMALL(_HEXED([f'(w[{i * 32 + j + 1}] & {0xFF << 2 * v & 0xFF})' for j in range(7, -1, -1)]))}" for i in range(4) for v in range(4)]
_PATTERNS += [f"'bloom_global:' || {_SMALL(_HEXED([f'xor(w[{j + 1}], w[{j + 9}])' for j in range(7, 1, -1)]))}"]
PATTERN_HASHES = f"{_A}, y as (select id, signature, {_BYTES} as w from a) select id, to_base64(unhex(substr(sha256('PSI_SALT' || concat_ws('||', {', '.join(_PATTERNS)})), 1, 32))) as hash from y"

# --- assignment, duplicates, counts

_ASSIGNED = """q as materialized (select id1, id2, sha256(id1 || '|' || id2) as h from f),
o as materialized (select id1, id2, row_number() over (order by array_to_string([substr(h, 2 * i + 1, 2) for i in [7, 6, 5, 4, 3, 2, 1, 0]], '') desc) as n from q),
r as (select 0::bigint as n, ''::varchar as id1, ''::varchar as id2, false as won, []::varchar[] as u, []::varchar[] as v
  union all select o.n, o.id1, o.id2, not (list_contains(u, o.id1) or list_contains(v, o.id2)),
    case when list_contains(u, o.id1) or list_contains(v, o.id2) then u else list_append(u, o.id1) end,
    case when list_contains(u, o.id1) or list_contains(v, o.id2) then v else list_append(v, o.id2) end from r join o on o.n = r.n + 1)"""
ONE_TO_ONE = f"{_linked(20).replace('with ', 'with recursive ', 1)}, {_ASSIGNED} select id1, id2 from r where won"
EXCHANGE = f"{_linked(10).replace('with ', 'with recursive ', 1)}, {_ASSIGNED}, t as (select count(*) as n from r where won) select n as local_count, n as peer_count, 0::bigint as local_only, 0::bigint as peer_only, true as equal from t"

_WITHIN = f"""{_A}, {_buckets('a')}, p as (select distinct x.id as id1, y.id as id2 from a_k x join a_k y on x.bucket_id = y.bucket_id and x.id < y.id),
q as (select id1, id2, {_H} as distance, round({_J}, 9)::double as similarity from p join a on a.id = id1 join a as b on b.id = id2), z as (select * from q where distance <= 20 and similarity >= 0.32)"""
WITHIN = f"{_WITHIN} select * from z"
PIPELINE_COUNTS = f"""{_WITHIN}, k as (select bucket_id, count(*) as size from a_k group by bucket_id), o as (select list_sort(list(size)) as l from k)
select (select count(*) from a) as records, (select count(*) from p) as candidate_pairs, (select count(*) from z) as matches, len(l) as total_buckets, list_sum(l)::bigint as total_records,
round(list_sum(l) / len(l), 9) as avg_bucket_size, l[len(l) // 2 + 1] as median_bucket_size, l[len(l)] as max_bucket_size, l[1] as min_bucket_size from o"""
TWO_PARTY_COUNTS = TWO_PARTY.replace(" select * from q where", ", m as (select * from q where") + """)
select (select count(distinct bucket_id) from a_k where bucket_id in (select bucket_id from b_k)) as matching_buckets, (select sum(n_shared) from p)::bigint as candidate_pairs,
(select coalesce(sum(n_shared), 0) from m)::bigint as total_matches, (select count(*) from a) as party1_records, (select count(*) from b) as party2_records"""
BUCKET_JOIN = f"{_AB}, {_buckets('a')}, {_buckets('b')} select distinct x.id as id1, y.id as id2 from a_k x join b_k y using (bucket_id)"
CANDIDATE_CAP = f"{LSH_CANDIDATES} order by id1, id2 limit 100"

#: A column in which a third of all rows have one value, as bucket of customers and of suppliers.
SKEWED = {"customer": ("concat('a', cast(c_custkey as string))", "concat('n', cast(case when c_custkey % 3 = 0 then 0 else c_nationkey end as string))"), "supplier": ("concat('b', cast(s_suppkey as string))", "concat('n', cast(case when s_suppkey % 3 = 0 then 0 else s_nationkey end as string))")}
_SKEWED = ", ".join(f"{t[0]} as (select {i} as id, {k} as bucket_id from {t})" for t, (i, k) in SKEWED.items())
HOT_BUCKETS = f"""with {_SKEWED} select 'within' as kind, x.id as id1, y.id as id2, x.bucket_id from c x join c y on x.bucket_id = y.bucket_id and x.id < y.id
union all select 'across', c.id, s.id, c.bucket_id from c join s using (bucket_id)"""

_ROUNDED = "printf('%.6f', {x})"
_REPORT = f"{_linked(10)}, {_EXPECTED}, {_COUNTS}, {_SCORES}, t as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1 from s)"
REPORT = f"""{_REPORT} select unnest(['true_positives', 'false_positives', 'false_negatives', 'total_ground_truth', 'precision', 'recall', 'f1_score']) as metric,
unnest([true_positives::varchar, false_positives::varchar, false_negatives::varchar, (true_positives + false_negatives)::varchar, {', '.join(_ROUNDED.format(x=f'{c}::double') for c in ('p', 'r', 'f1'))}]) as value from t"""
REPORT_DETAIL = f"select case match_type when 'TP' then 'true_positive' when 'FP' then 'false_positive' else 'false_negative' end as match_type, id1, id2 from ({LABELLED})"
SAMPLES = f"select * from (select match_type, id1, id2, row_number() over (partition by match_type order by id1, id2)::integer as place from ({LABELLED})) where place <= 3"

RATE_LIMIT = """with recursive o as (select event_id, user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
r as (select event_id, user_id, t, n, 1 as held, t + 86400000000 as reset, true as allowed from o where n = 1
  union all select o.event_id, o.user_id, o.t, o.n, case when o.t > r.reset then 1 when r.held >= 2 then r.held else r.held + 1 end,
    case when o.t > r.reset then o.t + 86400000000 else r.reset end, o.t > r.reset or r.held < 2 from r join o on o.user_id = r.user_id and o.n = r.n + 1)
select event_id, user_id, allowed from r"""

# --- files and streams

ODD_TEXT = "concat(c_name, ', \"', c_mktsegment, '\"', chr(10), ' #', cast(c_custkey as string), ' ')"
CSV_SOURCE = f"select cast(c_custkey as varchar) as custkey, {ODD_TEXT} as text, case when c_custkey % 5 = 0 then '' else c_mktsegment end as segment from customer"
CSV_GET = f"select * from ({CSV_SOURCE}) where custkey = '7'"
_kinds = lambda names: f"(select unnest([{', '.join(repr(n) for n in names)}]) as kind)"
TOKEN_KINDS = ["csv", "json", "json_array", "one_message", "frames"]
TOKEN_FILES = f"select kind, r.* from ({RECORDS}) r, {_kinds(TOKEN_KINDS)}"
MATCH_KINDS = ["csv", "json", "export", "intersection"]
MATCH_FILES = f"select kind, 'a' || c_custkey || ', \"x\"' as id1, 'b' || c_custkey as id2 from customer, {_kinds(MATCH_KINDS)}"
TOKEN_STATISTICS = "select count(*) as total_records, true as has_timestamps, 184 as bloom_length, 1612 as minhash_length from customer"
TOKEN_PAGE = "select 'a' || c_custkey as id from customer order by id limit 15 offset 20"
STREAM_LINK = f"{_linked(20)} select id1, id2, '2024-01-01T00:00:00Z' as timestamp from f"
AUDIT_LINES = "select event_id, concat_ws(' ', 'AUDIT_EVENT=' || event_type, 'TIMESTAMP=' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), 'SESSION=s1', 'event_id=' || event_id, 'user_id=' || user_id) as line from events"
_PEOPLE = "(select c_custkey as k, c_custkey::varchar as id, case when c_custkey % 3 = 0 then '' else c_name end as name from customer)"
DATABASE = f"""select 'all' as kind, id, name from {_PEOPLE} union all select 'get', id, name from {_PEOPLE} where k = 7
union all select * from (select 'page', id, name from {_PEOPLE} order by k limit 25 offset 40)
union all select * from (select 'after', id, name from {_PEOPLE} where k > 60 order by k limit 25)"""
NULLS = "select c_custkey, '' as name, '' as date, '' as gender, '' as zip, '' as basic from customer"

# --- synthetic rows

#: Rows of the first and second set, people in both, and the share of noisy fields, in per mille.
SYNTHETIC = (300, 360, 90, 100)


def _synthetic() -> str:
    draw = lambda tag, n: f"(('0x' || substr(md5('1|{tag}|' || kind || '|' || n), 1, 12))::bigint % {n})"
    pick = lambda values, at: f"{values!r}[{at} + 1]"
    padded = lambda x, low, width: f"lpad(({x} + {low})::varchar, {width}, '0')"
    names = "(case when kind = 'base' then 10 else 5 end)"
    n1, n2, base, noise = SYNTHETIC
    fields = f"""{pick(FIRST, f"{draw('first', 10)} % {names}")} as first_name, {pick(LAST, f"{draw('last', 10)} % {names}")} as last_name,
 {padded(draw('year', 50), 1950, 4)} || '-' || {padded(draw('month', 12), 1, 2)} || '-' || {padded(draw('day', 28), 1, 2)} as dob,
 {padded(draw('ssn1', 899), 100, 3)} || '-' || {padded(draw('ssn2', 89), 10, 2)} || '-' || {padded(draw('ssn3', 8999), 1000, 4)} as ssn,
 ({draw('house', 9900)} + 100)::varchar || ' ' || {pick(STREETS, draw('street', 5))} as address,
 '(' || {padded(draw('area', 799), 200, 3)} || ') ' || {padded(draw('exchange', 799), 200, 3)} || '-' || {padded(draw('line', 8999), 1000, 4)} as phone"""

    def noisy(c: str) -> str:
        place, letter, kind = f"({draw(f'{c}-place', 1 << 30)} % greatest(length({c}), 1) + 1)", f"chr((97 + {draw(f'{c}-letter', 26)})::integer)", draw(f"{c}-kind", 3)
        before, at, after = f"substr({c}, 1, {place} - 1)", f"substr({c}, {place})", f"substr({c}, {place} + 1)"
        return f"case when {draw(f'{c}-any', 1_000_000)} < {noise * 1000} and length({c}) > 0 then case when {kind} = 0 then {before} || {letter} || {after} when {kind} = 1 and length({c}) > 1 then {before} || {after} when {kind} = 2 then {before} || {letter} || {at} else {c} end else {c} end as {c}"

    rows = f"k as (select 'base' as kind, n from range({base}) r(n) union all select 'unique1', n from range({n1 - base}) r(n) union all select 'unique2', n from range({n2 - base}) r(n)), p as (select kind, n, {fields} from k)"
    rest = "dob, ssn, phone"
    sides = f"""a_raw as (select case when kind = 'base' then 'd1_base_' else 'd1_unique_' end || n as id, first_name, last_name, address, {rest} from p where kind in ('base', 'unique1')),
b_raw as (select 'd2_base_' || n as id, {noisy('first_name')}, {noisy('last_name')}, {noisy('address')}, {rest} from p where kind = 'base' union all select 'd2_unique_' || n, first_name, last_name, address, {rest} from p where kind = 'unique2')"""
    grams = lambda s: f"""select distinct id, v from (select id, unnest(list_concat([v], list_transform(range(1, length(v)), lambda i: substr(v, i, 2)), list_transform(range(1, length(v) - 1), lambda i: substr(v, i, 3)))) as v
 from (select id, lower(unnest([first_name, last_name, dob, ssn, address, phone])) as v from {s}_raw))"""  # noqa: E731
    return f"with {rows}, {sides}, {_sketched('a', grams('a'))}, {_sketched('b', grams('b'))}, {_buckets('a')}, {_buckets('b')}"


SYNTHETIC_LINK = f"""{_synthetic()}, x as (select distinct x.id as id1, y.id as id2 from a_k x join b_k y using (bucket_id)),
f as (select id1, id2 from x join a on a.id = id1 join b on b.id = id2 where {_H} <= 100 and {_J} >= 0.32), e as (select 'd1_base_' || n as id1, 'd2_base_' || n as id2 from range({SYNTHETIC[2]}) r(n)), {_COUNTS},
s as (select tp as true_positives, all_ - tp as false_positives, greatest(0, exp - tp) as false_negatives, tp / all_ as precision, tp / (tp + greatest(0, exp - tp)) as recall from n)
select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from s"""
