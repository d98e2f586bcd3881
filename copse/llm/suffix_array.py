"""Suffix arrays by induced sorting, and capped permuted common prefixes, on NumPy arrays.

Induced sorting places suffixes bucket by bucket; here all suffixes that one
scan of a bucket induces are placed at once, wave by wave (a wave follows a run
of equal symbols), which keeps the linear order of the sequential scan.
"""

from __future__ import annotations

import numpy as np

#: Reduced strings with at most this many names are sorted by induction again, others by rank doubling.
RECURSE_NAMES = 2048


def types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the last one is)."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int64)))  # of s[i + 1] - s[i]
    at = np.where(step != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1] if n > 1 else at
    out = np.ones(n, bool)
    out[:-1] = np.where(nxt < n, step[np.minimum(nxt, n - 2)] > 0, False) if n > 1 else True
    return out


def _dealt(pos: np.ndarray, sym: np.ndarray, parts: list[list[np.ndarray]]) -> None:
    """Appends pos to the parts of their symbols, in order."""
    if not len(pos):
        return
    order = np.argsort(sym, kind="stable")
    sym, pos = sym[order], pos[order]
    cuts = np.flatnonzero(sym[1:] != sym[:-1]) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(pos)], strict=True):
        parts[sym[a]].append(pos[a:b])


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int64)


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in order."""
    by_sym = [np.zeros(0, np.int64)] * k
    sym = s[lms]
    order = np.argsort(sym, kind="stable")
    cuts = np.flatnonzero(np.diff(sym[order])) + 1
    for own in np.split(lms[order], cuts) if len(lms) else []:
        by_sym[s[own[0]]] = own
    larger: list[list[np.ndarray]] = [[] for _ in range(k)]
    left: list[np.ndarray] = []
    for c in range(k):  # left to right: suffixes larger than their successor
        waves, wave = [], _joined(larger[c])
        while len(wave):
            waves.append(wave)
            pred = wave[wave > 0] - 1
            pred = pred[~small[pred]]
            own = s[pred]
            _dealt(pred[own != c], own[own != c], larger)
            wave = pred[own == c]
        left.append(_joined(waves))
        pred = by_sym[c][by_sym[c] > 0] - 1
        _dealt(pred, s[pred], larger)
    smaller: list[list[np.ndarray]] = [[] for _ in range(k)]
    out: list[np.ndarray] = []
    for c in range(k - 1, -1, -1):  # right to left: the others
        waves, wave = [], _joined(smaller[c])
        while len(wave):
            waves.append(wave)
            pred = wave[wave > 0] - 1
            pred = pred[small[pred]]
            own = s[pred]
            _dealt(pred[own != c], own[own != c], smaller)
            wave = pred[own == c]
        back = left[c][::-1]
        pred = back[back > 0] - 1
        pred = pred[small[pred]]
        _dealt(pred, s[pred], smaller)
        out += [_joined(waves), back]
    # the last suffix is followed by nothing, so no scan induces it: it is the smallest of all
    return np.concatenate([*out, np.array([len(s) - 1], np.int64)])[::-1]


def _named(s: np.ndarray, lms_sorted: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the sorted leftmost-smaller substrings: equal ones share one."""
    a, b = lms_sorted[:-1], lms_sorted[1:]
    same = length[a] == length[b]
    at, j = np.flatnonzero(same), 0
    while len(at):
        live = at[length[a[at]] > j]
        ok = s[a[live] + j] == s[b[live] + j]
        same[live[~ok]] = False
        at, j = live[ok], j + 1
    names = np.r_[0, np.cumsum(~same)]
    return names, int(names[-1]) + 1


def suffix_array(s: np.ndarray, k: int | None = None, depth: int | None = None) -> np.ndarray:
    """Positions of s's suffixes in order; s ends with a smallest symbol that doesn't also come before it. With depth, ties beyond that many symbols stay open."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    k = int(s.max()) + 1 if k is None else k
    s = s.astype(np.int16) if k <= 1 << 15 else s.astype(np.int64)
    small = types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    first = induce(s, small, lms, k)  # sorts leftmost-smaller substrings
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    lms_sorted = first[is_lms[first]]
    length = np.zeros(n, np.int64)
    length[lms] = np.r_[np.diff(lms) + 1, 1] if len(lms) else 0
    if len(lms) > 1:
        names, m = _named(s, lms_sorted, length)
        if m < len(lms):
            reduced = np.zeros(n, np.int64)
            reduced[lms_sorted] = names
            reduced = reduced[lms]
            order = suffix_array(reduced, m, depth) if m <= RECURSE_NAMES else _by_doubling(reduced, depth)
            lms_sorted = lms[order]
    return induce(s, small, lms_sorted, k)


def _by_doubling(r: np.ndarray, depth: int | None) -> np.ndarray:
    """Suffix order of ranks r; stops when all differ, or beyond depth symbols (each covers one at least)."""
    n, h = len(r), 1
    rank = r.astype(np.int64)
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - h] = rank[h:] + 1 if h < n else 0
        key = rank * (n + 2) + nxt
        order = np.argsort(key)
        new = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
        rank = np.empty(n, np.int64)
        rank[order] = new
        h *= 2
        if new[-1] == n - 1 or h >= n or (depth is not None and h >= depth):
            return order


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, width: int) -> np.ndarray:
    """In text order: how many bytes, width at most, the suffix at each place shares with the one before it in sa.

    0 for the first of sa and for places that sa doesn't list. Every suffix of sa
    has width bytes at least. Places are compared in text order, eight bytes at a
    time, and only while they still agree.
    """
    pad = np.concatenate([text.astype(np.uint8), np.zeros(8, np.uint8)])
    word = np.lib.stride_tricks.sliding_window_view(pad, 8)[: len(text)]
    word = np.ascontiguousarray(word).view("<u8").ravel()
    before = np.full(len(text), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    live = np.flatnonzero(before >= 0)
    out = np.zeros(len(text), np.int64)
    for j in range(0, width, 8):
        differ = word[live + j] ^ word[before[live] + j]
        ends = differ != 0
        lowest = differ[ends] & (~differ[ends] + np.uint64(1))  # the first byte that differs is the lowest
        out[live[ends]] = np.minimum(j + np.log2(lowest.astype(float)).astype(np.int64) // 8, width)
        live = live[~ends]
    out[live] = width
    return out
