"""Bootstrap draws made where the row is.

``counts`` gives each row its multiplicity in a tree's bootstrap: exactly n draws
with replacement over n ranked rows, without a table of draws. The ranks are cut
in blocks; the n draws of a tree go down the binary tree of blocks by binomial
splits, each from a generator seeded by (seed, tree, bounds of the split), and
the draws of a block fall evenly on its rows. Whoever holds a row works out its
count from the row's rank alone, so counts are the same in any partitioning and
sum to n for each tree. Rows that lie by rank share the work of a block.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Ranks of a block; its counts are drawn at once.
BLOCK = 4096


def generator(*key: int) -> np.random.Generator:
    return np.random.default_rng([k % (1 << 63) for k in key])


@lru_cache(maxsize=200_000)
def _left(seed: int, tree: int, lo: int, hi: int, draws: int, rows: int, left_rows: int) -> int:
    """How many of the draws over blocks lo..hi fall in the left half of the blocks."""
    return int(generator(seed, tree, lo, hi, 1).binomial(draws, left_rows / rows))


def block_draws(seed: int, tree: int, n: int, block: int) -> int:
    """Draws of a tree that fall in a block of ranks."""
    lo, hi, draws = 0, -(-n // BLOCK), n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _left(seed, tree, lo, hi, draws, min(hi * BLOCK, n) - lo * BLOCK, (mid - lo) * BLOCK)
        lo, hi, draws = (lo, mid, left) if block < mid else (mid, hi, draws - left)
    return draws


def block_counts(seed: int, tree: int, n: int, block: int) -> np.ndarray:
    """The multiplicity of each row of a block."""
    size = min((block + 1) * BLOCK, n) - block * BLOCK
    at = generator(seed, tree, block, 0).integers(0, size, block_draws(seed, tree, n, block))
    return np.bincount(at, minlength=size)


def counts(seed: int, tree: int, n: int, rank: np.ndarray) -> np.ndarray:
    """The multiplicities of rows by their ranks in 0..n-1."""
    out = np.zeros(len(rank), np.int64)
    block = rank // BLOCK
    for b in np.unique(block):
        own = block == b
        out[own] = block_counts(seed, tree, n, int(b))[rank[own] - b * BLOCK]
    return out


def poisson_counts(seed: int, tree: int, row_ids: np.ndarray) -> np.ndarray:
    """Counts of a Poisson(1) draw from a mixed hash of (seed, tree, row): the same wherever the row is."""
    with np.errstate(over="ignore"):
        h = row_ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + tree * 7919 + 1) % 2**63)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    u = (h >> np.uint64(11)).astype(float) / 2.0**53
    return np.searchsorted(np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)]), u, side="right")
