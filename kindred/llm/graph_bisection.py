"""Recursive graph bisection of documents by their terms, in numpy.

A group of documents is split in halves, then pairs of documents are swapped between the halves as long as
that lowers the estimated cost of the terms' gaps; each half is split in turn. All groups of a level are
worked on together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Swapping passes of one level.
PASSES = 6


def _places(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, place within the runs of equal keys but the last) of rows sorted by keys, the first one leading."""
    order = np.lexsort(keys[::-1])
    run = np.ones(len(order), bool)
    for k in keys[:-1]:
        run[1:] &= k[order][1:] == k[order][:-1]
    run[:1] = False
    starts = np.flatnonzero(~run)
    return order, np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))


@dataclass
class Level:
    """One level: each document's side, the distinct (group, term) keys, and their documents on both sides."""

    side: np.ndarray
    keys: np.ndarray
    degrees: np.ndarray
    sizes: np.ndarray


def split(group: np.ndarray, doc: np.ndarray, terms: np.ndarray, n_terms: int) -> Level:
    """Sides (0, 1) of the documents of every group. doc, terms: the document and the term of each posting, by document."""
    n = len(group)
    order, place = _places(group, np.arange(n))
    count = np.bincount(group)
    side = np.zeros(n, np.int64)
    side[order] = place >= (count[group[order]] + 1) // 2
    keys, at = np.unique(group[doc] * n_terms + terms, return_inverse=True)
    of = keys // n_terms
    sizes = np.stack([(count + 1) // 2, count // 2])
    degrees = np.zeros((2, len(keys)))
    for turn in range(PASSES + 1):
        for s in (0, 1):
            degrees[s] = np.bincount(at[side[doc] == s], minlength=len(keys))
        if turn == PASSES:
            break
        cost = lambda d, s: d * np.log2(np.maximum(sizes[s][of], 1) / (d + 1))
        now = cost(degrees[0], 0) + cost(degrees[1], 1)
        gains = np.stack([now - cost(np.maximum(degrees[s] - 1, 0), s) - cost(degrees[1 - s] + 1, 1 - s) for s in (0, 1)])
        gain = np.bincount(doc, gains[side[doc], at], n)
        order, place = _places(group, side, -gain)
        # The documents of most gain on both sides change places, while together they gain.
        one, two = (order[side[order] == s] for s in (0, 1))
        place_one, place_two = (place[side[order] == s] for s in (0, 1))
        first_two = np.zeros(len(count), np.int64)
        first_two[1:] = np.cumsum(np.bincount(group[two], minlength=len(count)))[:-1]
        met = place_one < np.bincount(group[two], minlength=len(count))[group[one]]
        partner = two[first_two[group[one[met]]] + place_one[met]] if len(place_two) else one[:0]
        swap = gain[one[met]] + gain[partner] > 1e-9
        if not swap.any():
            break
        side[one[met][swap]], side[partner[swap]] = 1, 0
    return Level(side, keys, degrees, sizes)


def ordered(doc: np.ndarray, terms: np.ndarray, n_docs: int, n_terms: int, leaf: int) -> np.ndarray:
    """Numbers of leaves of at most `leaf` documents, of each document, in the order of the bisection."""
    group = np.zeros(n_docs, np.int64)
    while n_docs and np.bincount(group).max() > leaf:
        group = 2 * group + split(group, doc, terms, n_terms).side
        group = np.unique(group, return_inverse=True)[1]
    return group


@dataclass
class Tree:
    """Bisections that were found on a sample, as weights of terms and a threshold for every node."""

    weights: np.ndarray
    limits: np.ndarray
    levels: int

    def leaves(self, doc: np.ndarray, terms: np.ndarray, n_docs: int) -> np.ndarray:
        node = np.zeros(n_docs, np.int64)
        for level in range(self.levels):
            at = (1 << level) - 1 + node
            score = np.bincount(doc, self.weights[at[doc], terms], n_docs)
            node = 2 * node + (score > self.limits[at])
        return node


def fitted(doc: np.ndarray, terms: np.ndarray, n_docs: int, n_terms: int, levels: int) -> Tree:
    """The upper levels of the bisection of a sample, for documents outside of it as well: a term weighs as much as it
    tells the halves apart, and a node's threshold halves the sample."""
    weights, limits = np.zeros(((1 << levels) - 1, n_terms), np.float32), np.zeros((1 << levels) - 1)
    group = np.zeros(n_docs, np.int64)
    for level in range(levels if n_docs else 0):
        found = split(group, doc, terms, n_terms)
        first = (1 << level) - 1
        of = found.keys // n_terms
        weights[first + of, found.keys % n_terms] = np.log2((found.degrees[1] + 1) / (found.sizes[1][of] + 1)) - np.log2((found.degrees[0] + 1) / (found.sizes[0][of] + 1))
        score = np.bincount(doc, weights[first + group[doc], terms], n_docs)
        for g in np.unique(group):
            limits[first + g] = np.median(score[group == g])
        group = 2 * group + (score > limits[first + group])
    return Tree(weights, limits, levels)
