"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols by the lexicon: insult (with a weight), threat, target, negation, reported speech,
clause end, other. The insult entries (whole words and word beginnings) and their weights are learned
from labelled rows; the closed classes are the fixed lists below. A clause's symbols are read by the
composition of five transducers, each reading what the one before writes:

1. negation: insults and threats up to REACH words after a negation are negated;
2. reported speech: what follows a verb of saying is reported;
3. target: marks insults and threats of a clause that names a target anywhere, before or after them (it
   guesses at the clause's start, and only the right guess can end);
4. threat: a threat with a target is the event `threat`, others are nothing;
5. insult: the events `plain`, `addressed`, `negated`, `reported`.

An insult adds its lexicon weight to its event, a threat adds one. A logistic model fitted on labelled
rows weighs the events. So a matched clause counts, not a word alone: an insult under negation or in
reported speech is an event of its own with its own weight.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kindred.llm.common import fresh, sliced, text_or_empty
from kindred.llm.transducers import Transducer, mapping

# Closed word classes in English, German, French and Spanish.
THREATS = frozenset("kill hurt destroy beat stab shoot strangle töten umbringen verletzen tuer tuez blesser frapper matar herir golpear destruir".split())
TARGETS = frozenset("you your yours yourself u du dich dir dein deine ihr euch tu toi vous votre vos ton ta te tú ti usted ustedes tus".split())
NEGATIONS = frozenset("not no never neither nor without isn't aren't wasn't don't doesn't nicht kein keine keinen nie niemals ohne ne pas jamais sans aucun ni nunca jamás sin".split())
REPORTS = frozenset("said says say called calls quoted quote wrote alleged reported claims sagte sagt nannte schrieb behauptete dit disait appelé écrit dijo dice llamó escribió".split())

#: Labelled documents that the model is fitted on at most, those of smallest hash: the bound of the sample.
SAMPLE_ROWS = 16_000
#: Lengths of word beginnings that may be lexicon entries.
BEGINNINGS = (4, 5, 6, 7)
#: Words after a negation that it covers.
REACH = 3
_STRIP = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "«»„“”‘’¿¡…–—"
_ENDS = frozenset(".!?;:")
#: Symbols: other, insult, threat, target, negation, reported speech; and what ends a clause.
O, I, T, Y, N, R, END = "oITYNR."
EVENTS = ("plain", "addressed", "negated", "reported", "threat")
FEATURES = 8
#: What the logistic weights are drawn to: prior log odds for plain, addressed, negated, reported, threat, rate, any.
PRIOR = np.array([-3.0, 0.5, 0.7, 0.1, 0.1, 0.7, 1.0, 2.0])


def negation() -> Transducer:
    """State: words that the last negation still covers."""
    arcs = {}
    for left in range(REACH + 1):
        after, covered = max(0, left - 1), left > 0
        arcs[left] = {N: [(O, REACH)], I: [("denied" if covered else I, after)], T: [(O if covered else T, after)], **{s: [(s, after)] for s in (O, Y, R)}}
    return Transducer(0, arcs, arcs)


def reported_speech() -> Transducer:
    """State: whether a verb of saying stood in the clause."""
    plain = {s: [(s, 0)] for s in (O, I, T, Y, "denied")} | {R: [(O, 1)]}
    told = {s: [(s, 1)] for s in (O, Y)} | {R: [(O, 1)], I: [("told", 1)], "denied": [("told", 1)], T: [(O, 1)]}
    return Transducer(0, {0: plain, 1: told}, [0, 1])


def target() -> Transducer:
    """States: none (there is no target in the clause), awaited (one will come) and met. The first symbol is read by both guesses."""
    stay = ("denied", "told", O)
    none = {s: [(s, "none")] for s in (*stay, I, T)}
    awaited = {s: [(s, "awaited")] for s in stay} | {I: [("insult at", "awaited")], T: [("threat at", "awaited")], Y: [(O, "met")]}
    met = {s: [(out, "met") for out, _ in steps] for s, steps in awaited.items()}
    start = {s: none.get(s, []) + awaited.get(s, []) for s in none | awaited}
    return Transducer("start", {"start": start, "none": none, "awaited": awaited, "met": met}, ["start", "none", "met"])


def threat() -> Transducer:
    return mapping({"threat at": "threat", T: O}, ["threat at", T, "insult at", I, "denied", "told", O])


def insult() -> Transducer:
    return mapping({I: "plain", "insult at": "addressed", "denied": "negated", "told": "reported"}, [I, "insult at", "denied", "told", "threat", O])


#: The grammar of a clause: every sequence of symbols has one accepting path.
CLAUSE = negation().then(reported_speech()).then(target()).then(threat()).then(insult())


#: Bytes of words whose symbols a grammar keeps.
KEPT_BYTES = 64 << 20
_LONG = re.compile(f"{O}{{{REACH},}}")


def bare(chunk: str) -> str:
    return chunk.strip(_STRIP)


def entries_of(word: str) -> Iterator[str]:
    """Lexicon entries that a word can match: itself, and its beginnings."""
    if len(word) >= 2:
        yield f"={word}"
        for n in BEGINNINGS:
            if len(word) > n:
                yield word[:n]


class Grammar:
    """The lexicon, which maps entries to weights, before the composed transducers, and the weights of their events."""

    def __init__(self, lexicon: dict[str, float], coefficients: np.ndarray):
        self.lexicon, self.coefficients = lexicon, coefficients
        self._seen: dict[str, tuple[str, float]] = {}
        self._read: dict[str, list[str]] = {}
        self._held = 0

    def symbol(self, chunk: str) -> tuple[str, float]:
        """(symbol, with END if it ends a clause, weight of an insult) of a run of non-space characters, in lower case."""
        got = self._seen.get(chunk)
        if got is None:
            word = bare(chunk)
            weight = max((self.lexicon[e] for e in entries_of(word) if e in self.lexicon), default=0.0)
            kind = I if weight > 0 else T if word in THREATS else Y if word in TARGETS else N if word in NEGATIONS else R if word in REPORTS else O
            ends = not _ENDS.isdisjoint(chunk[len(chunk.rstrip(_STRIP)) :])
            got = (kind + END * ends, weight)
            self._held += len(chunk) + 150
            if self._held > KEPT_BYTES:
                self._seen.clear()
                self._held = len(chunk) + 150
            if len(chunk) <= 64:
                self._seen[chunk] = got
        return got

    def events(self, clause: str) -> list[str]:
        """The events of a clause's symbols, in order. Other words beyond a negation's reach say nothing more."""
        key = _LONG.sub(O * REACH, clause)
        got = self._read.get(key)
        if got is None:
            if len(self._read) > 1 << 14:
                self._read.clear()
            got = self._read[key] = [e for e in CLAUSE.read(key) if e != O]
        return got

    def features(self, text: str) -> np.ndarray:
        seen = self._seen
        symbols = [seen.get(c) or self.symbol(c) for c in text.lower().split()]
        x = np.zeros(FEATURES)
        x[0] = 1.0
        kinds = "".join([s for s, _ in symbols])
        if I not in kinds and T not in kinds:
            return x
        weights = iter([w for _, w in symbols if w])
        sums = dict.fromkeys(EVENTS, 0.0)
        for clause in kinds.split(END):
            if I in clause or T in clause:
                # Each insult is one event, in the order of the words.
                for e in self.events(clause):
                    sums[e] += 1.0 if e == "threat" else next(weights)
        x[1:6] = [math.log1p(sums[e]) for e in EVENTS]
        total = sum(sums.values()) - sums["threat"]
        x[6] = math.log1p(25.0 * total / max(12, len(symbols)))
        x[7] = 1.0 if total > 0 else 0.0
        return x

    def score(self, text: str) -> float:
        z = float(self.features(text) @ self.coefficients)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _count(rows: DataFrame) -> DataFrame:
    """(entry, pos, neg): documents of either label that have the entry, summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()

        def out() -> pa.RecordBatch:
            keys = list(pos.keys() | neg.keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], names=["entry", "pos", "neg"])

        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                words = {bare(c) for c in set(text.lower().split())}
                (pos if label else neg).update({e for w in words for e in entries_of(w)})
                if len(pos) + len(neg) > 1_000_000:
                    yield out()
                    pos, neg = Counter(), Counter()
        yield out()

    return rows.select("text", "label").mapInArrow(run, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _cover(marks: list[tuple[str, list[int]]], counts: list[tuple[str, int, int]], n_pos: int, n_neg: int) -> dict[str, float]:
    """Entries that cover the toxic texts greedily, most new texts first, with log odds as weights.

    Copies of one text count once, so the words of a text that was copied don't pass for insults.
    """
    odds = [math.log((p + 0.5) / (n_pos + 1)) - math.log((n + 0.5) / (n_neg + 1)) for _, p, n in counts]
    holders: dict[int, set[int]] = {}
    for i, (_, having) in enumerate(marks):
        for f in having:
            holders.setdefault(f, set()).add(i)
    uncovered = [4] * len(marks)  # each text is to be covered so often
    lexicon: dict[str, float] = {}
    least = least_holders(len(marks))

    def worth(f: int) -> tuple[int, float]:
        fresh = sum(1 for i in holders[f] if uncovered[i])
        return fresh, fresh - 3.0 * counts[f][2] * n_pos / max(1, n_neg) + 0.01 * len(holders[f])

    # What an entry is worth only falls, so one that is still worth its old figure is the best.
    heap = [(-worth(f)[1], counts[f][0], f) for f in holders]
    heapq.heapify(heap)
    while heap:
        old, entry, f = heapq.heappop(heap)
        fresh, now = worth(f)
        if fresh < least or now < least:
            continue
        if -now > old:
            heapq.heappush(heap, (-now, entry, f))
            continue
        lexicon[entry] = max(0.5, odds[f])
        for i in holders[f]:
            uncovered[i] = max(0, uncovered[i] - 1)
    return lexicon


def least_holders(n_pos: int) -> int:
    """Toxic texts that an entry must cover, of n_pos."""
    return max(3, round(0.004 * n_pos))


def _logistic(x: np.ndarray, y: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Newton's method, drawn to PRIOR."""
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + strength * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - strength * (w - PRIOR))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    w[1:] = np.maximum(w[1:], 0)  # no toxic event lowers a score
    return w


def fit(labelled: DataFrame) -> Grammar:
    """labelled: the bounded sample (doc_id, text, label 0/1) that `sample` gives. Exact copies count once.

    Without toxic rows the lexicon is empty and only the closed classes speak.
    """
    own = labelled.where(F.col("label").isNotNull()).select(text_or_empty().alias("text"), (F.col("label") > 0).cast("int").alias("label"), F.xxhash64(text_or_empty(), F.lit(3)).alias("_h"))
    rows = own.groupBy("_h").agg(F.max("label").alias("label"), F.first("text").alias("text")).persist()
    n_pos, n_neg = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("label")), F.lit(0))).first()
    counts: list[tuple[str, int, int]] = []
    lexicon: dict[str, float] = {}
    if n_pos:
        odds = (F.col("pos") + 0.5) / (n_pos + 1) / ((F.col("neg") + 0.5) / (n_neg + 1))
        # Of the bounded sample, so their number is bounded too.
        found = _count(rows).where((F.col("pos") >= least_holders(n_pos)) & (odds > 6))
        counts = sorted((r["entry"], r["pos"], r["neg"]) for r in found.collect())
        index = {e: i for i, (e, _, _) in enumerate(counts)}

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                having = [sorted({index[e] for w in {bare(c) for c in set(t.lower().split())} for e in entries_of(w) if e in index}) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("_h").cast(pa.string()), pa.array(having, pa.list_(pa.int32()))], names=["h", "having"])

        marked = rows.where("label = 1").select("_h", "text").mapInArrow(mark, "h string, having array<int>").collect()
        lexicon = _cover(sorted((r["h"], r["having"]) for r in marked), counts, n_pos, n_neg)
    grammar = Grammar(lexicon, PRIOR)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(lexicon, PRIOR)
        for b in batches:
            x = [g.features(t).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    measured = rows.select("text", "label").mapInArrow(measure, "label int, x array<double>").collect()
    rows.unpersist()
    if measured and n_pos and n_neg:
        measured.sort(key=lambda r: (r["label"], r["x"]))
        grammar.coefficients = _logistic(np.array([r["x"] for r in measured]), np.array([r["label"] for r in measured], float))
    return grammar


def held_out(doc_id: str = "doc_id"):
    """Rows that no label is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled ids that may be learned from, those of smallest hash.

    An id with several labels has its highest. The ids are a bounded number, so they are broadcast and
    the texts of all other documents stay where they are.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    picked = marks.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(rows)
    return docs.where(~held_out()).select("doc_id", "text").join(F.broadcast(picked), "doc_id")


#: Bytes of texts scored at once.
SLICE_BYTES = 8 << 20


def scored(docs: DataFrame, grammar: Grammar, threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """docs (their columns `keep`, all by default) with score (0 to 1) and predicted (1 from `threshold` on), from the text alone.

    A null or empty text has no event and the model's lowest score. Texts are read whole, whatever their
    length; repeated rows are scored each; other columns may be null and have any name, but columns score
    and predicted in `docs` are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("score", "predicted")
    kept = docs.select(*keep) if keep is not None else docs
    own = docs.select(*kept.columns, text_or_empty().alias(fresh(docs, "scored_text")))
    lexicon, coefficients = grammar.lexicon, grammar.coefficients
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(lexicon, coefficients)
        for b in batches:
            for part in sliced(b, b.num_columns - 1, SLICE_BYTES):
                score = [g.score(t) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score, pa.float64())], names=[*names, "score"])

    schema = StructType(list(kept.schema.fields)).add("score", "double")
    return own.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
