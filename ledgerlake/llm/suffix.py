"""Suffix arrays by induced sorting, and permuted longest common prefixes."""

from __future__ import annotations

import numpy as np


def kinds(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one. The last symbol counts as larger than what would follow."""
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1].astype(np.int64))
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def _same(s: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of s[a:] and s[b:], up to most; s has words() of room behind."""
    out = np.zeros(len(a), np.int64)
    todo = np.arange(len(a))
    while len(todo):
        x, y = a[todo] + out[todo], b[todo] + out[todo]
        todo = todo[(out[todo] < most[todo]) & (s[np.minimum(x, len(s) - 1)] == s[np.minimum(y, len(s) - 1)]) & (x < len(s)) & (y < len(s))]
        out[todo] += 1
    return out


def _words(s: np.ndarray) -> np.ndarray:
    """For each position the 4 symbols (16 bits each) that begin there as one number."""
    wide = np.concatenate([s.astype(np.uint64), np.zeros(4, np.uint64)])
    out = wide[: len(s)].copy()
    for k in range(1, 4):
        out |= wide[k : k + len(s)] << np.uint64(16 * k)
    return out


def common(s: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of s[a:] and s[b:], up to most, for symbols below 2**16."""
    words, n = _words(s), len(s)
    out = np.zeros(len(a), np.int64)
    todo = np.arange(len(a))
    while len(todo):
        x, y = a[todo] + out[todo], b[todo] + out[todo]
        whole = (x + 4 <= n) & (y + 4 <= n) & (out[todo] + 4 <= most[todo])
        whole[whole] = words[x[whole]] == words[y[whole]]
        todo = todo[whole]
        out[todo] += 4
    rest = _same(s, a + out, b + out, np.minimum(most - out, 4))
    return out + rest


def _spread(sa: np.ndarray, front: np.ndarray, symbols: np.ndarray, entries: np.ndarray, forward: bool) -> None:
    """Append entries, in their order, at the fronts of their symbols' buckets."""
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    counts = np.bincount(sorted_symbols, minlength=len(front))
    within = np.arange(len(order)) - (np.cumsum(counts) - counts)[sorted_symbols]
    if forward:
        sa[front[sorted_symbols] + within] = entries[order]
        front += counts
    else:
        sa[front[sorted_symbols] - 1 - within] = entries[order]
        front -= counts


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in the order that the given order of the leftmost-smaller ones induces, one bucket after the other."""
    n = len(s)
    counts = np.bincount(s, minlength=size)
    end = np.cumsum(counts)
    begin = end - counts
    sa = np.full(n, -1, np.int64)
    large_front = begin.copy()
    symbol = s[lms]
    order = np.argsort(symbol, kind="stable")
    by_symbol = lms[order]
    edge = np.searchsorted(symbol[order], np.arange(size + 1))
    # the last suffix has no smaller one behind it: it comes first of all that are larger than their next
    _spread(sa, large_front, s[n - 1 : n], np.array([n - 1]), True)
    for c in range(size):
        done = begin[c]
        while done < large_front[c]:
            part = sa[done : large_front[c]].copy()
            done = large_front[c]
            before = part[part > 0] - 1
            before = before[~small[before]]
            if len(before):
                _spread(sa, large_front, s[before], before, True)
        part = by_symbol[edge[c] : edge[c + 1]]
        before = part[part > 0] - 1
        if len(before):
            _spread(sa, large_front, s[before], before, True)
    small_front = end.copy()
    for c in range(size - 1, -1, -1):
        done = end[c]
        while small_front[c] < done:
            part = sa[small_front[c] : done][::-1].copy()
            done = small_front[c]
            before = part[part > 0] - 1
            before = before[small[before]]
            if len(before):
                _spread(sa, small_front, s[before], before, False)
        part = sa[begin[c] : large_front[c]][::-1]
        before = part[part > 0] - 1
        before = before[small[before]]
        if len(before):
            _spread(sa, small_front, s[before], before, False)
    return sa


def _plain(s: list[int], size: int) -> list[int]:
    """Suffix array of a list of numbers below size: induced sorting one suffix at a time, for the recursive strings."""
    n = len(s)
    if n <= 1:
        return list(range(n))
    small = [False] * n
    for i in range(n - 2, -1, -1):
        small[i] = s[i] < s[i + 1] or (s[i] == s[i + 1] and small[i + 1])
    begin = [0] * (size + 1)
    for c in s:
        begin[c + 1] += 1
    for c in range(size):
        begin[c + 1] += begin[c]
    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]

    def spread(order: list[int]) -> list[int]:
        sa = [-1] * n
        tail = begin[1:]
        for i in reversed(order):
            c = s[i]
            tail[c] -= 1
            sa[tail[c]] = i
        head = begin[:-1]
        last = s[n - 1]
        sa[head[last]] = n - 1
        head[last] += 1
        for r in range(n):
            j = sa[r] - 1
            if j >= 0 and not small[j]:
                c = s[j]
                sa[head[c]] = j
                head[c] += 1
        tail = begin[1:]
        for r in range(n - 1, -1, -1):
            j = sa[r] - 1
            if j >= 0 and small[j]:
                c = s[j]
                tail[c] -= 1
                sa[tail[c]] = j
        return sa

    if not lms:
        return spread([])
    stop = {a: b for a, b in zip(lms, lms[1:], strict=False)}
    rank, name, previous = {}, -1, None
    is_lms = set(lms)
    for i in spread(lms):
        if i in is_lms:
            this = s[i : stop[i] + 1] if i in stop else None
            if this is None or this != previous:
                name += 1
            rank[i], previous = name, this
    if name + 1 < len(lms):
        order = [lms[k] for k in _plain([rank[i] for i in lms], name + 1)]
    else:
        order = sorted(lms, key=rank.__getitem__)
    return spread(order)


def suffix_array(s: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of s, symbols below size (a few hundred)."""
    n = len(s)
    if n <= 1:
        return np.arange(n)
    small = kinds(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):
        return induce(s, small, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sa = induce(s, small, lms, size)
    sorted_lms = sa[is_lms[sa]]
    length = np.full(n, n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    a, b = sorted_lms[:-1], sorted_lms[1:]
    alike = (length[a] == length[b]) & (length[a] < n)
    at = np.flatnonzero(alike)
    alike[at] = common(s, a[at], b[at], length[a[at]]) >= length[a[at]]
    name = np.concatenate([[0], np.cumsum(~alike)])
    rank = np.zeros(n, np.int64)
    rank[sorted_lms] = name
    if name[-1] + 1 < len(lms):
        order = lms[np.array(_plain(rank[lms].tolist(), int(name[-1]) + 1))]
    else:
        order = sorted_lms
    return induce(s, small, order, size)


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position the length, up to most, of the prefix that its suffix shares with the one before it in sa.

    Where the symbols before the two suffixes agree, the value is one less than that of the position before; only at
    the other positions are symbols compared.
    """
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    start = (phi < 0) | (at == 0) | (phi == 0)
    rest = np.flatnonzero(~start)
    start[rest] = s[rest - 1] != s[phi[rest] - 1]
    begin = np.flatnonzero(start)
    value = np.zeros(len(begin), np.int64)
    real = phi[begin] >= 0
    value[real] = common(s, begin[real], phi[begin[real]], np.full(int(real.sum()), n, np.int64) if most >= n else np.full(int(real.sum()), most, np.int64) + _gap(begin, n)[real])
    owner = np.maximum.accumulate(np.where(start, at, 0))
    out = np.zeros(n, np.int64)
    out[begin] = value
    return np.minimum(np.maximum(out[owner] - (at - owner), 0), most)


def _gap(begin: np.ndarray, n: int) -> np.ndarray:
    """How many positions take their value from each of begin."""
    return np.diff(np.concatenate([begin, [n]]))
