"""Exact top-k by inner product: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz bounds.

The vectors become integers floor(scale * x). Their Gram matrix (dimension squared, summed over all
rows) gives the rotation of a singular value decomposition, after which the leading coordinates hold
most of the length. Candidates lie in blocks of descending length.

1. All queries meet the longest block. Each one's k-th best score there is a floor: no block gives it less.
2. A candidate can reach a query's floor only if its length is floor / |query| at least (Cauchy-Schwarz).
   Queries are packed in order of that need, so the query blocks that a candidate block has to meet are
   the first so many, and only those pairs of blocks are dealt out.
3. Within a pair of blocks, from the longest candidate on,

    score <= partial + |query's rest| * |candidate's rest|     (Cauchy-Schwarz on what is rotated away)
    score <= |query| * |candidate|                             (ends the block: lengths only descend)

   so what cannot reach the query's k-th best so far, or its floor, is never scored in full.

Full scores are integer sums: in float64 while no sum can pass 2^52, in 64-bit integers up to 2^62, and in
Python integers beyond.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import cut

#: Components of one block of candidates, and of one block of queries, at most (a vector at least).
CANDIDATE_CELLS, QUERY_CELLS = 1 << 19, 1 << 17
#: Candidate blocks that a block of queries meets in one task.
MEETINGS = 64
#: Candidates looked at together, and rotated coordinates of the partial sums.
CHUNK, LEADING = 512, 16
#: Bounds on a score up to which float64 is exact, and up to which 64-bit integers are.
EXACT, LONG = 2.0**52, 2.0**62
_LEAST, _NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _finite(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x array<double>) of the rows whose vector is there, not empty and all finite."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return own.where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & fine)


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): float64 holds it exactly as long as 64-bit integers do; Python integers beyond."""
    whole = np.floor(x * float(scale))
    if not len(whole) or np.abs(whole).max() < LONG:
        return whole.astype(np.int64)
    if not np.isfinite(whole).all():  # the product passed the largest double; whole numbers that large are exact
        return np.array([[int(c) * scale if not np.isfinite(w) else int(w) for c, w in zip(r, s, strict=True)] for r, s in zip(x.tolist(), whole.tolist(), strict=True)], object)
    return np.array([[int(c) for c in r] for r in whole.tolist()], object)


def _bytes(ints: np.ndarray) -> tuple[bytes, str]:
    """Components as bytes of the narrowest integers that hold them, or as text."""
    if ints.dtype == object:
        return ",".join(map(str, ints.ravel().tolist())).encode(), "text"
    most = int(np.abs(ints).max()) if ints.size else 0
    kind = next(k for k in ("<i2", "<i4", "<i8") if k == "<i8" or most < 2 ** (int(k[2]) * 8 - 1))
    return ints.astype(kind).tobytes(), kind


def _unpacked(raw: bytes, kind: str, d: int) -> np.ndarray:
    if kind == "text":
        return np.array([int(x) for x in raw.decode().split(",")], object).reshape(-1, d)
    return np.frombuffer(raw, kind).astype(np.int64).reshape(-1, d)


def _floats(ints: np.ndarray) -> np.ndarray:
    return ints.astype(np.float64)


def _lengths(ints: np.ndarray) -> np.ndarray:
    f = _floats(ints)
    most = np.abs(f).max(1, initial=0)
    most[most == 0] = 1
    return np.sqrt(((f / most[:, None]) ** 2).sum(1)) * most


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _rotation(own: DataFrame, d: int, scale: int) -> np.ndarray:
    """Right singular vectors of all rows, from the d x d Gram matrix summed over the partitions. Any rotation is right;
    where the sums pass the largest double it is none."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            m = _floats(integers(_matrix(b, d), scale))
            with np.errstate(over="ignore", invalid="ignore"):
                total += m.T @ m
        i, j = np.divmod(np.arange(d * d), d)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "g"])

    # d * d sums: their number does not grow with the rows.
    rows = own.select("x").mapInArrow(gram, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect()
    total = np.zeros((d, d))
    for i, j, g in rows:
        total[i, j] = g
    if not np.isfinite(total).all():
        return np.eye(d)
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1]


def _scores(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products; `bound` is above all of them."""
    if bound < EXACT:
        return np.rint(_floats(q) @ _floats(c).T).astype(np.int64)
    if bound < LONG:
        return q.astype(np.int64) @ c.astype(np.int64).T
    return q.astype(object) @ c.astype(object).T


class Best:
    """The k best candidates of each query of a block, over the candidate blocks met so far.

    floor: a score that each query's k-th best is known to reach, -inf if there is none; what is below is left out.
    """

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, rotation: np.ndarray):
        self.ids, self.q, self.floor, self.k, self.rotation = q_ids, q, floor, k, rotation
        self.length = _lengths(q)
        self.leading = (_floats(q) @ rotation)[:, :LEADING]
        self.rest = self._rests(self.length, self.leading)
        self.score = np.full((len(q), k), _LEAST)
        self.who = np.full((len(q), k), _NO_ID)

    @staticmethod
    def _rests(length: np.ndarray, leading: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return np.sqrt(np.maximum(length**2 - (leading * leading).sum(1), 0))

    def _needed(self, rows: np.ndarray) -> np.ndarray:
        """What a score has to reach to matter."""
        full = self.who[rows, -1] != _NO_ID
        return np.where(full, np.maximum(self.score[rows, -1].astype(np.float64), self.floor[rows]), self.floor[rows])

    def meet(self, c_ids: np.ndarray, c: np.ndarray) -> None:
        """A block of candidates: all but the query's own id count."""
        if not len(self.q) or not len(c):
            return
        c_len = _lengths(c)
        order = np.lexsort((c_ids, -c_len))
        c_ids, c, c_len = c_ids[order], c[order], c_len[order]
        bound_all = float(self.length.max()) * float(c_len[0]) * (1 + 1e-9)
        large = bound_all >= LONG or self.score.dtype == object
        if large:  # Python integers, bounded by lengths alone
            self.score = self.score.astype(object)
        leading = (_floats(c) @ self.rotation)[:, :LEADING]
        rest = self._rests(c_len, leading)
        # Rounding of the rotated sums, generously.
        slack = 1e-9 * self.length * c_len[0] + 1e-6
        alive = np.arange(len(self.q))
        for at in range(0, len(c), CHUNK):
            end = min(at + CHUNK, len(c))
            alive = alive[self.length[alive] * c_len[at] + slack[alive] >= self._needed(alive)]
            if not len(alive):
                return
            may = np.ones((len(alive), end - at), bool)
            if not large:
                bound = self.leading[alive] @ leading[at:end].T + self.rest[alive, None] * rest[None, at:end]
                may = bound + slack[alive, None] >= self._needed(alive)[:, None]
            rows = np.flatnonzero(may.any(1))
            if not len(rows):
                continue
            columns = np.flatnonzero(may[rows].any(0))
            ids, own = c_ids[at:end][columns], alive[rows]
            score = _scores(self.q[own], c[at:end][columns], bound_all)
            real = may[np.ix_(rows, columns)] & (ids[None, :] != self.ids[own][:, None])
            all_s = np.hstack([self.score[own], np.where(real, score, _LEAST)])
            all_i = np.hstack([self.who[own], np.where(real, ids[None, :], _NO_ID)])
            if large:
                pick = np.array([sorted(range(len(s)), key=lambda j, s=s, i=i: (i[j] == _NO_ID, -s[j], i[j]))[: self.k] for s, i in zip(all_s.tolist(), all_i.tolist(), strict=True)])
            else:
                pick = np.lexsort((all_i, np.invert(all_s)), axis=1)[:, : self.k]
            self.score[own], self.who[own] = np.take_along_axis(all_s, pick, 1), np.take_along_axis(all_i, pick, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query index, candidate id, score, whether it fits a long) of what may be among the k best of all; scores
        beyond a long stand as its least or highest value, which keeps their order among the others."""
        qi, slot = np.nonzero((self.who != _NO_ID) & (self.score.astype(np.float64) >= self.floor[:, None]))
        score = self.score[qi, slot]
        if score.dtype != object:
            return qi, self.who[qi, slot], score, np.ones(len(qi), bool)
        within = [min(max(int(x), _LEAST), _NO_ID) for x in score]
        return qi, self.who[qi, slot], np.array(within, np.int64), np.array([int(x) == y for x, y in zip(score, within, strict=True)], bool)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query.

    Queries are the rows whose id is divisible by `every`; candidates are all rows but those of the
    query's own id. Ties go to the smaller vec_id; rows of one id count each. Vectors null, empty, or
    with a null or non-finite component, and null ids, take no part. Vectors are compared only with
    those of the same length; extra columns are left aside; an empty table gives an empty result. Scores
    are exact however large the components; if one among a query's k best does not fit a long, reading
    the result raises an error, as an overflowing sum does.
    """
    own = _finite(vectors, id_col, vector_col)
    parts = [_one_dimension(own.where(F.size("x") == d), d, k, every, scale) for (d,) in sorted(own.select(F.size("x").alias("d")).distinct().collect())]
    if not parts:
        return own.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_BLOCK = "ids binary, v binary, kind string, most double"


def _pack(d: int, scale: int, rows: int) -> Callable:
    """Runs of a partition's sorted vectors as rows: ids and components as bytes, and the longest's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_i: list[np.ndarray] = []
        held_x: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            ints = integers(np.concatenate(held_x), scale)
            raw, kind = _bytes(ints)
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held_i).tobytes()], pa.binary()), pa.array([raw], pa.binary()), pa.array([kind]), pa.array([float(_lengths(ints).max())])], names=["ids", "v", "kind", "most"])

        held = 0
        for b in batches:
            ids, x = b.column("vec_id").to_numpy(zero_copy_only=False), _matrix(b, d)
            at = 0
            while at < len(ids):
                n = min(rows - held, len(ids) - at)
                held_i.append(ids[at : at + n])
                held_x.append(x[at : at + n])
                at, held = at + n, held + n
                if held == rows:
                    yield out()
                    held_i, held_x, held = [], [], 0
        if held:
            yield out()

    return run


def _one_dimension(own: DataFrame, d: int, k: int, every: int, scale: int) -> DataFrame:
    spark = own.sparkSession
    rotation = _rotation(own, d, scale)
    rows, query_rows = max(1, CANDIDATE_CELLS // d), max(1, QUERY_CELLS // d)
    sized = own.withColumn("length", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)))
    is_query = F.col("vec_id") % every == 0
    n, n_queries = sized.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    blocks, query_blocks = max(1, -(-n // rows)), max(1, -(-n_queries // query_rows))
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    longest = F.col("length").desc()
    # The longest vectors, one block of bounded size.
    first = sized.orderBy(longest, "vec_id").limit(max(rows, 2 * k)).select("vec_id", "x").collect()
    f_ids, f = np.array([r["vec_id"] for r in first], np.int64), integers(np.array([r["x"] for r in first], float).reshape(-1, d), scale)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, query_rows):
                part = b.slice(at, query_rows)
                own = Best(part.column("vec_id").to_numpy(), integers(_matrix(part, d), scale), np.full(part.num_rows, -np.inf), k, rotation)
                own.meet(f_ids, f)
                floor = np.where(own.who[:, -1] != _NO_ID, own.score[:, -1].astype(np.float64), -np.inf)
                # The length that a candidate needs: any, as long as the floor is not above 0.
                need = np.where(floor > 0, floor / np.maximum(own.length, 1e-300) * (1 - 1e-9), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("x"), pa.array(floor), pa.array(need)], names=["vec_id", "x", "floor", "need"])

    asked = sized.where(is_query).select("vec_id", "x").mapInArrow(floors, "vec_id long, x array<double>, floor double, need double")
    dealt = asked.repartitionByRange(query_blocks, "need", "vec_id", F.xxhash64("x")).sortWithinPartitions("need", "vec_id")

    def pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, query_rows):
                part = b.slice(at, query_rows)
                raw, kind = _bytes(integers(_matrix(part, d), scale))
                columns = [part.column("vec_id").to_numpy().tobytes(), raw, kind, part.column("floor").to_numpy().tobytes(), part.column("need")[0].as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(columns, (pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.float64()), strict=True)], names=["ids", "v", "kind", "floor", "need"])

    queries = cut(dealt.mapInArrow(pack_queries, "ids binary, v binary, kind string, floor binary, need double").withColumn("block", F.monotonically_increasing_id()))
    # One number for each block of queries, in ascending order of need: a candidate block meets those it can serve.
    needs = sorted((r["need"], r["block"]) for r in queries.select("need", "block").collect())
    numbered = spark.createDataFrame([(b, i) for i, (_, b) in enumerate(needs)], "block long, number int")
    reach = np.array([x for x, _ in needs])
    packed = sized.repartitionByRange(blocks, longest, "vec_id", F.xxhash64("x")).sortWithinPartitions(longest, "vec_id").select("vec_id", "x").mapInArrow(_pack(d, scale, rows), _BLOCK)

    def served(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = np.searchsorted(reach, b.column("most").to_numpy() * (1 + 1e-9), side="right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(last.astype(np.int32))], names=["ids", "v", "kind", "most", "last"])

    # A block of queries meets its candidate blocks in several tasks, MEETINGS of them in each, the longest first.
    tasks = -(-blocks // MEETINGS)
    met = packed.mapInArrow(served, f"{_BLOCK}, last int").where("last > 0").withColumn("number", F.explode(F.sequence(F.lit(0), F.col("last") - 1)))
    theirs = met.select("number", F.pmod(F.xxhash64("ids"), F.lit(tasks)).alias("task"), "most", "ids", "v", "kind", F.lit(None).cast("binary").alias("floor"))
    asking = queries.join(F.broadcast(numbered), "block").withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)).cast("array<long>")))
    tiles = asking.select("number", "task", F.lit(float("inf")).alias("most"), "ids", "v", "kind", "floor").unionByName(theirs)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None

        def out() -> pa.RecordBatch:
            qi, ids, score, fits = own.rows()
            # Rows of one query id are told apart by their place in their block.
            return pa.RecordBatch.from_arrays([pa.array(own.ids[qi]), pa.array(own.number * query_rows + qi), pa.array(ids), pa.array(score), pa.array(fits)], names=["query_id", "place", "vec_id", "score", "fits"])

        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                ids, ints = np.frombuffer(row["ids"], np.int64), _unpacked(row["v"], row["kind"], d)
                if row["floor"] is None:
                    own.meet(ids, ints)
                    continue
                if own is not None:
                    yield out()
                own = Best(ids, ints, np.frombuffer(row["floor"], np.float64), k, rotation)
                own.number = row["number"]
        if own is not None:
            yield out()

    dealt = tiles.repartition("number", "task").sortWithinPartitions("number", "task", F.col("most").desc(), "ids")
    shares = dealt.mapInArrow(search, "query_id long, place long, vec_id long, score long, fits boolean")
    best = Window.partitionBy("query_id", "place").orderBy(F.col("score").desc(), "vec_id")
    ranked = shares.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    score = F.when(F.col("fits"), F.col("score")).otherwise(F.raise_error(F.concat(F.lit("the score of query "), F.col("query_id").cast("string"), F.lit(" does not fit a long"))))
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", score.cast("long").alias("score"))
