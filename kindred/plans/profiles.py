"""Parameter sets of the encodings and thresholds of linkage."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Profile:
    """m bits, k hash functions, s signature places. grams: what of a value goes into the filter."""

    m: int = 1000
    k: int = 5
    s: int = 100
    q: int = 2
    pad: str = "$"
    seed: str = "kindred"
    grams: str = "whole"  # whole | padded | bag
    methods: bool = True  # apply the fields' normalization methods
    noise: float = 0.0
    random_bits: float = 0.0
    noise_seed: str = "0"


WORKFLOW = Profile()
VALIDATE = replace(WORKFLOW, methods=False)
SERVER = Profile(m=100, s=1000, grams="padded", methods=False)
HARNESS = Profile(grams="bag", methods=False)


@dataclass(frozen=True)
class Thresholds:
    hamming: int = 20
    jaccard: float = 0.32


def chosen(cli: Thresholds, first: Thresholds, second: Thresholds) -> Thresholds:
    """The command line's values, but for its defaults the laxer of both parties'."""
    if cli != Thresholds():
        return cli
    return Thresholds(max(first.hamming, second.hamming), min(first.jaccard, second.jaccard))
