"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of events: words, and tags that open or close. A word's score is a sum of learned
weights: one for all words, and one for each feature of the elements around it, their tags and the parts
of their class, id and role names. Tags score negative, by their name. One linear scan finds the
contiguous region of highest sum, the main text's place on the page; it grows to the ends of the innermost
element that holds all its words. Of the region's words those count that score positive: what a menu,
notice or advert inside the region holds scores negative there.

The weights are those of a logistic regression on labelled pages (`labelled_pages`): whether a run of
text is the article's, given the features around it. No element and no name is dropped by a list.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import labelled_pages
from kindred.llm.common import fresh, sliced

_EVENT = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|textarea|title|select|option|object|canvas|math)(?=[\s/>]).*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|([^<]+)|(<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")

#: Elements that stand apart as blocks of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a sibling of their kind closes.
SIBLINGS = frozenset(["li", "dd", "dt", "tr", "td", "th", "option"])
#: Elements that mark a page's article; beside them stands other text.
HOLDERS = frozenset(["article", "main"])
_HOLDING = frozenset(f"<{h}>" for h in HOLDERS)
#: Feature of words beside the holders of a page that has some, and of all words.
BESIDE, ALL = "beside", "all"
#: Labelled pages and the seed of their rule.
PAGES, SEED = 1500, 1
#: A word adds at most this in the scan, and takes at most that; a tag costs between these. Chosen on the labelled pages.
WORD, OTHER_WORD = 2.0, 0.25
LEAST_TAG, MOST_TAG = 0.05, 0.5


class Event:
    """kind: 'text' or a tag's name; words: their number; features: of the words' surroundings; block: ends a block; level: open elements."""

    __slots__ = ("kind", "text", "words", "features", "block", "level")

    def __init__(self, kind: str, text: str, words: int, features: tuple | None, block: bool, level: int):
        self.kind, self.text, self.words, self.features, self.block, self.level = kind, text, words, features, block, level


def features(name: str, attributes: str, parent: str = "") -> frozenset[str]:
    """Features of an element: its tag, with its parent's too; of each name in class, id and role its last part, and the others."""
    if name in ("html", "body"):  # names there speak of the whole page
        return frozenset()
    found = {f"<{name}>", f"{parent}>{name}"}
    for m in _ATTRIBUTE.finditer(attributes):
        for n in (m[1] or m[2] or m[3] or "").split():
            parts = [p.lower() for p in _PARTS.findall(n)]
            if parts:
                found.add(f"{parts[-1]}$")
                found.update(f"{p}-" for p in parts[:-1])
    return frozenset(found)


def events(page: str) -> list[Event]:
    """The page's events, in time linear in its length (names are bounded by the page).

    Tags that never close end with the page or an element around them; a close tag without its open
    one is a tag event alone.
    """
    found: list[Event] = []
    stack: list[tuple[str, tuple, int]] = []  # name, features here and above, place of the nearest block or p
    depth: Counter = Counter()
    known: dict[tuple[str, str, str], frozenset] = {}
    here: tuple = ()

    def leave(to: int) -> None:
        nonlocal here
        while len(stack) > to:
            name, _, _ = stack.pop()
            depth[name] -= 1
        here = stack[-1][1] if stack else ()

    for m in _EVENT.finditer(page):
        if m[5] is not None or m[6]:
            text = entities.unescape(m[5] or m[6])
            found.append(Event("text", text, len(text.split()), here, False, len(stack)))
        elif m[3]:
            name, attributes = m[3].lower(), m[4] or ""
            block = name in BLOCKS
            if m[2]:
                if depth[name]:
                    at = len(stack) - 1
                    while stack[at][0] != name:
                        at -= 1
                    leave(at)
                found.append(Event(name, "", 0, None, block, len(stack)))
                continue
            if block and stack:  # a block ends an open paragraph
                nearest = stack[-1][2]
                if nearest >= 0 and stack[nearest][0] == "p":
                    leave(nearest)
            if name in SIBLINGS and stack and stack[-1][0] == name:
                leave(len(stack) - 1)
            found.append(Event(name, " " if name == "br" else "", 0, None, block, len(stack)))
            if name in VOID or attributes.rstrip().endswith("/"):
                continue
            key = (name, attributes, stack[-1][0] if stack else "")
            own = known.get(key)
            if own is None:
                own = known[key] = features(*key)
            # A linked list of the sets above: no copies, whatever the depth.
            here = (own, here)
            nearest = len(stack) if block else stack[-1][2] if stack else -1
            stack.append((name, here, nearest))
            depth[name] += 1
        elif m[1]:
            found.append(Event("raw", "", 0, None, False, len(stack)))
    return found


class Weights:
    """Learned weights: `word` by feature, `tag` by name; tags the labelled pages lack cost `other`."""

    def __init__(self, word: dict[str, float], tag: dict[str, float], other: float = LEAST_TAG):
        self.word, self.tag, self.other = word, tag, other

    def scores(self, es: list[Event]) -> list[float]:
        """Log odds of each word event (0 without words), and the cost of each tag."""
        sums: dict[int, tuple[frozenset, float, bool]] = {}  # by place in the linked list: features that count, their sum, in a holder

        def summed(at: tuple) -> tuple[frozenset, float, bool]:
            todo = []
            while at and id(at) not in sums:
                todo.append(at)
                at = at[1]
            seen, total, held = sums[id(at)] if at else (frozenset(), self.word.get(ALL, 0.0), False)
            for node in reversed(todo):
                new = [f for f in node[0] if f in self.word and f not in seen]
                if new:
                    seen, total = seen | frozenset(new), total + sum(self.word[f] for f in sorted(new))
                held = held or not _HOLDING.isdisjoint(node[0])
                sums[id(node)] = seen, total, held
            return seen, total, held

        out = [0.0] * len(es)
        beside = []
        marked = False
        for i, e in enumerate(es):
            if e.features is None:
                out[i] = -self.tag.get(e.kind, self.other)
            elif e.words:
                _, out[i], held = summed(e.features)
                marked |= held
                if not held:
                    beside.append(i)
        if marked:
            for i in beside:
                out[i] += self.word.get(BESIDE, 0.0)
        return out


def _training(pages: list[str]) -> tuple[Counter, Counter, Counter]:
    """(features, whether the article's) of the labelled pages' texts, each by the root of its words, and tags inside and outside of the articles."""
    rows, inside, outside = Counter(), Counter(), Counter()
    for page in pages:
        es = events(page)
        own = [i for i, e in enumerate(es) if labelled_pages.MARK in e.text]
        around: list[frozenset] = []
        sets: dict[int, frozenset] = {}
        for e in es:
            at = e.features or ()
            if id(at) not in sets:
                found, node = set(), at
                while node:
                    found |= node[0]
                    node = node[1]
                sets[id(at)] = frozenset(found)
            around.append(sets[id(at)])
        held = [not _HOLDING.isdisjoint(x) for x in around]
        marked = any(h and e.words for h, e in zip(held, es, strict=True))
        for i, e in enumerate(es):
            if e.features is None:
                (inside if own and own[0] <= i <= own[-1] else outside)[e.kind] += 1
            elif e.words:
                rows[around[i] | ({ALL, BESIDE} if marked and not held[i] else {ALL}), labelled_pages.MARK in e.text] += math.sqrt(e.words)
    return rows, inside, outside


def fit(pages: list[str], strength: float = 1.0) -> Weights:
    """Logistic regression of the texts' labels on their features, by Newton's method; tags by the log odds of
    standing inside the article, as a cost."""
    rows, inside, outside = _training(pages)
    often = Counter(f for around, _ in rows for f in around)
    names = sorted(f for f, n in often.items() if n >= 3)
    index = {f: i for i, f in enumerate(names)}
    x, y, heavy = np.zeros((len(rows), len(names))), np.zeros(len(rows)), np.zeros(len(rows))
    for r, ((around, own), weight) in enumerate(sorted(rows.items(), key=lambda row: (sorted(row[0][0]), row[0][1]))):
        x[r, [index[f] for f in around if f in index]] = 1
        y[r], heavy[r] = own, weight
    w = np.zeros(len(names))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (heavy * p * (1 - p))[:, None]) + strength * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (heavy * (y - p)) - strength * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    n_in, n_out = sum(inside.values()), sum(outside.values())
    odds = {t: math.log((outside[t] + 0.5) / (n_out + 1)) - math.log((inside[t] + 0.5) / (n_in + 1)) for t in inside.keys() | outside.keys()}
    return Weights(dict(zip(names, w.tolist(), strict=True)), {t: min(MOST_TAG, max(LEAST_TAG, o)) for t, o in odds.items()})


_weights: list[Weights] = []


def weights() -> Weights:
    if not _weights:
        _weights.append(fit(labelled_pages.pages(PAGES, SEED)))
    return _weights[0]


def values(es: list[Event], scores: list[float]) -> list[float]:
    """What each event adds in the scan: a word's score for each of its words, a tag's cost once."""
    return [s if e.features is None else max(-OTHER_WORD, min(WORD, s)) * e.words for e, s in zip(es, scores, strict=True)]


def region(value: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous events of highest sum, the first of equals; (0, 0) if none is positive."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, v in enumerate(value):
        if total <= 0:
            total, start = 0.0, i
        total += v
        if total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def grown(es: list[Event], start: int, end: int) -> tuple[int, int]:
    """The region grown to the ends of the innermost element that holds all its words; unchanged if that is the page's body."""
    words = [i for i in range(start, end) if es[i].words]
    if not words:
        return start, end
    # Between the first and the last word the least number of open elements is at that element.
    level = min(e.level for e in es[words[0] : words[-1] + 1])
    at = es[words[0]].features
    for _ in range(es[words[0]].level - level):
        at = at[1]
    if not at or not at[0]:
        return start, end
    while start and es[start - 1].level >= level:
        start -= 1
    while end < len(es) and es[end].level >= level:
        end += 1
    return start, end


def main_text(page: str | None, w: Weights | None = None) -> str:
    """The page's main text: blocks in page order joined by two line feeds; '' if there is none."""
    if not page:
        return ""
    es = events(page)
    scores = (w or weights()).scores(es)
    start, end = grown(es, *region(values(es, scores)))
    blocks: list[str] = []
    held: list[str] = []

    def close() -> None:
        if text := _SPACE.sub(" ", "".join(held)).strip():
            blocks.append(text)
        held.clear()

    for e, s in zip(es[start:end], scores[start:end], strict=True):
        if e.block:
            close()
        # Words by their score; white space between words, and line breaks, as they stand.
        if e.text and (s > 0 or not e.words):
            held.append(e.text)
    close()
    return "\n\n".join(blocks)


#: Bytes of pages whose texts a task holds at once.
SLICE_BYTES = 8 << 20


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns `keep`, then text and n_chars (code points) of each page's main text.

    A null or empty page, or one without words that score positive, has the text ''. Repeated rows are
    handled each. `keep` must not name text or n_chars (ValueError); other names are free. Whole pages
    are read, whatever their length; markup that ends early is closed at the page's end. An empty table
    gives an empty result.
    """
    if clash := {"text", "n_chars"} & {c.lower() for c in keep}:
        raise ValueError(f"columns {sorted(clash)} would be made twice")
    name = fresh(pages, "html_text")
    own = pages.select(*keep, F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias(name))
    kept = own.select(*keep).schema
    w = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in sliced(b, b.num_columns - 1, SLICE_BYTES):
                texts = [main_text(x, w) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, "text", "n_chars"])

    return own.mapInArrow(run, kept.add("text", "string").add("n_chars", "long"))
