"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

1. Texts of equal shingle sets form one class; only its representative goes on.
2. Every representative stands in each tree of the forest under a path of least hashes; the trees are
   prefix tries held as sorted rows. Prefixes are shortened, hash by hash, down to the length at which
   two texts at the threshold share a prefix in some tree with the target recall (`prefix_length`).
3. Representatives under one prefix are a run. Up to RUN of them meet at once, under the shortest
   prefix. A run with more starts at the deepest prefix: there it falls into small runs, in which
   leaders stand in for what is almost equal to them; only leaders go on to the next shorter prefix.
   Shortening stops for a run as soon as it fits (`_shortened`). What never fits meets in tiles.
4. Members that resemble one another in signature are linked, with margins so wide that two texts at
   the threshold are connected (`JOINS`); components of these links bring together what to verify.
5. Within a component all pairs are verified exactly on the shingle sets, in tiles of bounded size;
   tiles return sums and spanning forests, no pairs.
6. Components of the verified links are the classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import cut, fresh, text_or_empty
from kindred.llm.components import components
from kindred.llm.shingles import mix, set_keys, shingle_sets, signatures

#: Trees of the forest, deepest prefix, and recall for pairs just at the threshold.
TREES, DEEPEST, RECALL = 24, 8, 0.99999
#: Estimated similarity from which two members are connected, and estimated distance up to which a leader
#: stands in for others. Estimates compare 192 places, so their distance is a metric: what is at the
#: threshold of 0.8 to a member, and estimated there within five deviations (0.65), is at 0.55 to its leader.
JOINS, COVERED = 0.55, 0.1
#: Representatives of a run that meet at once.
RUN = 1024
#: Documents and bytes of shingles of one block; a tile holds two.
BLOCK_DOCS, BLOCK_BYTES = 1024, 24 << 20
_LEAST = -(2**63)


def prefix_length(threshold: float, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> int:
    """The prefix length reached by shortening from the deepest until the recall holds."""
    d = deepest
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


def _runs(of: Callable[[dict], Iterator[pa.RecordBatch]], keys: list[str]) -> Callable:
    """A mapInArrow function that calls `of` with the columns (numpy or lists) of each run of equal keys of a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            k = [np.asarray(b.column(c).to_numpy(zero_copy_only=False)) for c in keys]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1
            edges = [0, *change.tolist(), b.num_rows]
            for s, t in zip(edges, edges[1:], strict=False):
                key = tuple(x[s] for x in k)
                if key != last and held:
                    yield from of(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(s, t - s))
                last = key
        if held:
            yield from of(pa.Table.from_batches(held))

    return run


def _signed(docs: DataFrame, size: int, trees: int, shortest: int) -> DataFrame:
    """(doc_id, key, key2, n, prefixes array<long>, signature binary) of every row; prefixes null without shingles.

    prefixes: each tree's path cut to `shortest` hashes. signature: a byte for each hash of each path.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("key2", pa.int64()), ("n", pa.int32()), ("prefixes", pa.list_(pa.int64())), ("signature", pa.binary())])
    weights = mix(np.arange(1, shortest + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                sets = shingle_sets(part.column("text").to_pylist(), size)
                keys = set_keys(sets).view(np.int64)
                none = np.array([not len(s) for s in sets])
                raw = part.column("raw").to_numpy(zero_copy_only=False)
                keys[none, 0], keys[none, 1] = raw[none], ~raw[none]
                prefixes: list = [None] * len(sets)
                signed: list = [None] * len(sets)
                real = np.flatnonzero(~none)
                if len(real):
                    sig = signatures([sets[i] for i in real], trees * DEEPEST)
                    path = (sig.reshape(len(real), trees, DEEPEST)[:, :, :shortest] * weights).sum(2, dtype=np.uint64)
                    path = mix(path + np.arange(trees, dtype=np.uint64)).view(np.int64)
                    short = (mix(sig) & np.uint64(0xFF)).astype("u1")
                    for j, i in enumerate(real.tolist()):
                        prefixes[i], signed[i] = path[j], short[j].tobytes()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([len(s) for s in sets], pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(signed, pa.binary())], schema=schema)

    text = text_or_empty()
    # A text without words equals only the same text; the empty text none at all.
    raw = F.when(F.length(text) == 0, F.xxhash64(F.lit("empty"), "doc_id")).otherwise(F.xxhash64(text))
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc_id"), text.alias("text"), raw.alias("raw"))
    return own.mapInArrow(run, "doc_id long, key long, key2 long, n int, prefixes array<long>, signature binary")


def _led(nodes: np.ndarray, sig: np.ndarray, radius: np.ndarray, joins: float, covered: float) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """(a, b, leaders, radius): a spanning forest (a, b) of the members that resemble one another; places of the
    leaders, and how far what each stands in for is from it.

    A leader stands in for members that are, with all they stand in for, within `covered` of it.
    """
    n = len(nodes)
    free, group, leads = np.ones(n, bool), np.arange(n), np.zeros(n, bool)
    radius = radius.copy()
    a, b = [], []
    while free.any():
        i = int(np.argmax(free))
        leads[i] = True
        far = 1 - (sig == sig[i]).mean(1)
        free[i] = False
        under = free & (far + radius <= covered)
        if under.any():
            radius[i] = max(radius[i], float((far + radius)[under].max()))
        free &= ~under
        joined = np.flatnonzero((far <= 1 - joins) & (group != group[i]))
        if len(joined):
            others, first = np.unique(group[joined], return_index=True)
            a += [int(nodes[i])] * len(others)
            b += nodes[joined[first]].tolist()
            group[np.isin(group, others)] = group[i]
    return a, b, np.flatnonzero(leads), radius


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes = table.column("node").to_numpy()
    return nodes, np.frombuffer(b"".join(table.column("signature").to_pylist()), "u1").reshape(len(nodes), -1), table.column("radius").to_numpy()


def _connected(joins: float, covered: float) -> Callable:
    """Of a run or tile: the forest (a, b) alone."""

    def of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows < 2:
            return
        a, b, _, _ = _led(*_columns(table), joins, covered)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return of


_LED = "a long, b long, tree int, prefix long, node long, signature binary, radius double"


def _leaders(joins: float, covered: float) -> Callable:
    """Of a run: the forest (a, b), and the leaders' own rows (a null)."""

    def of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        nodes, sig, radius = _columns(table)
        a, b, leads, radius = _led(nodes, sig, radius, joins, covered)
        n = len(leads)
        own = table.select(["tree", "prefix", "node", "signature"]).take(pa.array(leads)).combine_chunks().to_batches()[0]
        none = lambda k, t: pa.array([None] * k, t)
        yield pa.RecordBatch.from_arrays([none(n, pa.int64()), none(n, pa.int64()), *own.columns, pa.array(radius[leads])], names=["a", "b", "tree", "prefix", "node", "signature", "radius"])
        if a:
            n = len(a)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), none(n, pa.int32()), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.binary()), none(n, pa.float64())], names=["a", "b", "tree", "prefix", "node", "signature", "radius"])

    return of


_SIDE = ["tree", "prefix", "node", "signature", "radius"]


def _shortened(hot: DataFrame, shortest: int, joins: float, covered: float, run: int) -> DataFrame:
    """Links (a, b) of the members (tree, prefix, node, signature, radius) of runs too large to meet at once.

    From the deepest prefix on, the runs under a prefix, dealt out in parts of about `run` members by a hash,
    keep their leaders; the prefix is shortened until all leaders under a shortest prefix fit. Leaders
    that don't fit even then meet in tiles of two parts.
    """
    links = None
    for length in range(DEEPEST, shortest, -1):
        # The byte of each further hash of the path tells what is below the shortest prefix apart.
        below = F.expr(f"substring(signature, tree * {DEEPEST} + {shortest + 1}, {length - shortest})")
        deep = hot.withColumn("below", below)
        held = deep.groupBy("tree", "prefix", "below").agg(F.ceil(F.count(F.lit(1)) / run).alias("parts"))
        dealt = deep.join(held, ["tree", "prefix", "below"]).withColumn("run", F.xxhash64("tree", "prefix", "below", F.pmod(F.xxhash64("node"), F.col("parts"))))
        rows = dealt.select("run", *_SIDE).repartition("run").sortWithinPartitions("run", "node")
        out = cut(rows.mapInArrow(_runs(_leaders(joins, covered), ["run"]), _LED))
        found = out.where("a is not null").select("a", "b")
        links = found if links is None else links.unionByName(found)
        hot = out.where("a is null").select(*_SIDE)
        if hot.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > run).isEmpty():
            break
    parts = hot.groupBy("tree", "prefix").agg(F.ceil(F.count(F.lit(1)) / run).alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    tiles = hot.join(parts, ["tree", "prefix"]).withColumn("part", part).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    named = tiles.withColumn("run", F.xxhash64("tree", "prefix", F.least("part", "_j"), F.greatest("part", "_j")))
    met = named.select("run", *_SIDE).repartition("run").sortWithinPartitions("run", "node").mapInArrow(_runs(_connected(joins, covered), ["run"]), "a long, b long")
    return met if links is None else links.unionByName(met)


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a boolean link matrix, by breadth-first search; each tree's root is its least place."""
    n = len(links)
    seen, out = np.zeros(n, bool), []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        front = [root]
        while front:
            i = front.pop()
            new = np.flatnonzero(links[i] & ~seen)
            seen[new] = True
            out += [(root, j) for j in new.tolist()]
            front += new.tolist()
    return out


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    if n == 2:
        c = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), c], [c, len(sets[1])]], float)
    all_ = np.concatenate(sets)
    who = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(all_, kind="stable")
    value, who = all_[order], who[order]
    number = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]]))
    often = np.bincount(number)[number] > 1
    number, who = number[often], who[often]
    out = np.zeros((n, n), np.float32)
    if len(number):
        number = np.cumsum(np.concatenate([[0], number[1:] != number[:-1]]))
        width = max(256, min(8192, (16 << 20) // n))
        for s in range(0, int(number[-1]) + 1, width):
            lo, hi = np.searchsorted(number, [s, s + width])
            m = np.zeros((n, width), np.float32)
            m[who[lo:hi], number[lo:hi] - s] = 1
            out += m @ m.T
    out[np.diag_indices(n)] = [len(s) for s in sets]
    return out


def _verify(threshold: float) -> Callable:
    """Of a tile: (node, other, links): a node with its sum of linked rows (other null), or a link of the spanning forest (links null)."""

    def of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        side = table.column("side").to_numpy()
        nodes, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        if len(nodes) < 2:
            return
        order = np.argsort(nodes, kind="stable")
        nodes, copies, side, sets = nodes[order], copies[order], side[order], [sets[i] for i in order]
        both = _shared(sets)
        size = np.array([len(s) for s in sets], float)
        links = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
        np.fill_diagonal(links, False)
        if table.column("other")[0].as_py() != table.column("block")[0].as_py():
            links &= side[:, None] != side[None, :]  # a tile of two blocks: pairs across only
        sums = links @ copies
        some = np.flatnonzero(sums)
        forest = _forest(links)
        n = len(forest)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([nodes[some], [nodes[i] for i, _ in forest]]).astype(np.int64)),
                pa.array([None] * len(some) + [int(nodes[j]) for _, j in forest], pa.int64()),
                pa.array([*sums[some].tolist(), *[None] * n], pa.int64()),
            ],
            names=["node", "linked", "links"],
        )

    return of


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, trees: int = TREES, recall: float = RECALL, run: int = RUN) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of every row of `docs`.

    Two rows are linked if the Jaccard similarity of their sets of `size`-word shingles is at least
    `threshold`; n_links counts the rows a row is linked to, equal ones included; n_copies those of
    equal shingle set, itself included. class_id: the least doc_id among the rows it is linked to, over
    any chain of links. Texts of 1 to size - 1 words are one shingle. Texts without words are linked to
    equal texts only, empty and null texts to none. Null ids stand below all ids. Texts are read whole,
    whatever their length. Other columns are left aside; an empty table gives an empty result.
    """
    shortest = prefix_length(threshold, trees, DEEPEST, recall)
    joins = threshold - 0.8 + JOINS
    signed = cut(_signed(docs, size, trees, shortest))
    # Sets are told apart by 128 bits; a number that is stored with it names each one.
    reps = cut(
        signed.groupBy("key", "key2")
        .agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("prefixes").alias("prefixes"), F.first("signature").alias("signature"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    # Runs of the sorted tries: only prefixes that several representatives share go on.
    rows = reps.where("n > 0").select("node", F.posexplode("prefixes").alias("tree", "prefix"))
    common = cut(rows.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("held")).where("held > 1"))

    def members(keys: DataFrame) -> DataFrame:
        joined = rows.join(keys.select("tree", "prefix"), ["tree", "prefix"]).join(reps.select("node", "signature"), "node")
        return joined.withColumn("radius", F.lit(0.0)).select(*_SIDE)

    dealt = members(common.where(F.col("held") <= run)).repartition("tree", "prefix").sortWithinPartitions("tree", "prefix", "node")
    alike = dealt.mapInArrow(_runs(_connected(joins, COVERED), ["tree", "prefix"]), "a long, b long")
    large = common.where(F.col("held") > run)
    if not large.isEmpty():
        alike = alike.unionByName(_shortened(members(large), shortest, joins, COVERED, run))
    groups = components(cut(alike))  # read twice there
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    # Shingles of the representatives that have to be verified, once each.
    asked = groups.join(reps.select("node", "key", "key2", "doc_id", "copies", "n"), "node")
    counted = asked.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("long").alias("blocks"))
    asked = asked.join(counted, "root")
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc_id"), text_or_empty().alias("text"))
    wanted = asked.select("doc_id", "root", "blocks", "node", "key", "key2", "copies").join(text, "doc_id")
    shingled = wanted.mapInArrow(_shingle(size), "root long, blocks long, node long, copies long, shingles binary").dropDuplicates(["root", "node"])
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    tiles = (
        shingled.withColumn("side", block)
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("root", F.least("side", "_j").alias("block"), F.greatest("side", "_j").alias("other"), "side", "node", "copies", "shingles")
    )
    met = tiles.repartition("root", "block", "other").sortWithinPartitions("root", "block", "other")
    found = cut(met.mapInArrow(_runs(_verify(threshold), ["root", "block", "other"]), "node long, linked long, links long"))
    sums = found.where("linked is null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("linked is not null").select(F.col("node").alias("a"), F.col("linked").alias("b")))
    # The class id is the least doc_id below a root.
    rooted = reps.select("node", "key", "key2", "doc_id", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    told = rooted.join(least, "root").join(sums, "node", "left").select("key", "key2", "class_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # Many rows may share a key: each key has one row on the other side, and the optimiser splits a hot one.
    out = signed.select("doc_id", "key", "key2").join(told, ["key", "key2"])
    back = lambda c: F.when(F.col(c) != _LEAST, F.col(c))
    return out.select(back("doc_id").alias("doc_id"), back("class_id").alias("class_id"), "n_links", F.col("copies").alias("n_copies"))


def _shingle(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                sets = shingle_sets(part.column("text").to_pylist(), size)
                keys = set_keys(sets).view(np.int64)
                # Rows of one id may hold other texts than the one asked for.
                right = (keys[:, 0] == part.column("key").to_numpy()) & (keys[:, 1] == part.column("key2").to_numpy())
                here = np.flatnonzero(right).tolist()
                kept = part.take(pa.array(here, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("root", "blocks", "node", "copies")), pa.array([sets[i].tobytes() for i in here], pa.binary())], names=["root", "blocks", "node", "copies", "shingles"])

    return run


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, that of least doc_id, with the columns of `docs`, whatever their names.

    Rows of one doc_id are one document, of which one row stays. Rows with a null doc_id count as one id.
    Texts without words are classes of their equals, empty and null texts of their own. An empty table
    gives an empty result.
    """
    own = near_duplicates(docs, **options).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.coalesce("doc_id", F.lit(_LEAST)).alias("id")).distinct()
    name = fresh(docs, "id")
    keyed = docs.withColumn(name, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)))
    return keyed.join(own.withColumnRenamed("id", name), name, "left_semi").dropDuplicates([name]).select(docs.columns)
