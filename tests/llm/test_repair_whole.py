from collections import Counter

import numpy as np
import pytest

from kindred.llm import token_files


def test_pairs_are_counted_over_the_whole_block():
    ids = np.random.default_rng(1).integers(100, 5000, 600_000).astype(np.uint32)
    ids[33_200:35_200] = np.tile([7, 8, 9, 10], 500)  # between the evenly spaced stretches once counted
    symbols, rules, lengths = token_files.compress(ids, 5000)
    assert (rules < 100).all(1).any()
    block = token_files.Block(5000, rules, lengths, symbols, np.zeros(1, np.int64), np.array([len(ids)]))
    assert (block.all_ids() == ids).all()


def plain_counts(symbols):
    """Occurrences of each pair, from left to right, that don't overlap one of the same pair."""
    counts, last = Counter(), {}
    for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)):
        if last.get(pair) != i - 1:
            counts[pair] += 1
            last[pair] = i
    return counts


@pytest.mark.parametrize("seed", range(6))
def test_rounds_go_on_until_no_rule_pays(seed):
    rng = np.random.default_rng(seed)
    ids = rng.zipf(1.3, 30_000).clip(1, 999).astype(np.uint32) + (0 if seed % 2 else 100)
    ids[rng.integers(0, len(ids), 300)] = token_files.END
    ids[500:900], ids[2000:2301] = 150, 0
    symbols, rules, lengths = token_files.compress(ids, 1200)
    ends = {token_files.END}
    for i, (_, right) in enumerate(rules.tolist()):
        ends |= {1200 + i} if right in ends else set()
    left = {p: n for p, n in plain_counts(symbols.tolist()).items() if p[0] not in ends}
    assert max(left.values()) < token_files.LEAST
    block = token_files.Block(1200, rules, lengths, symbols, np.zeros(1, np.int64), np.array([len(ids)]))
    assert (block.all_ids() == ids).all()
    pairs, counts = token_files.counted_pairs(ids, np.arange(1200) == token_files.END)
    want = {p: n for p, n in plain_counts(ids.tolist()).items() if p[0] != token_files.END}
    assert dict(zip(((int(p) >> 32, int(p) & 0xFFFFFFFF) for p in pairs), counts.tolist(), strict=True)) == want


def test_every_rule_is_used_often_enough():
    ids = np.random.default_rng(9).zipf(1.2, 50_000).clip(1, 400).astype(np.uint32) + 5
    symbols, rules, _ = token_files.compress(ids, 500)
    used = Counter(symbols.tolist()) + Counter(rules.ravel().tolist())
    assert len(rules) > 100 and min(used[500 + i] for i in range(len(rules))) > 0 and len(symbols) + 3 * len(rules) < len(ids)


def test_more_symbols_than_16_bits_hold():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 70_000, 30_000)
    ids = np.concatenate([np.tile(base, 9), np.arange(1, 70_000)]).astype(np.uint32)
    symbols, rules, lengths = token_files.compress(ids, 70_000)
    few = np.tile(rng.integers(1, 60_000, 30_000), 9).astype(np.uint32)  # 16 bits at first, more with the rules
    for x, made in ((ids, (symbols, rules, lengths)), (few, token_files.compress(few, 60_000))):
        v = 70_000 if x is ids else 60_000
        block = token_files.Block(v, made[1], made[2], made[0], np.zeros(1, np.int64), np.array([len(x)]))
        assert (block.all_ids() == x).all() and len(made[0]) < len(x)
