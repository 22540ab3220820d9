"""Suffix arrays by induced sorting, and permuted common prefixes, with numpy.

Induced sorting walks the buckets of first letters once upwards and once downwards. A
bucket is handled in array passes: its suffixes put the suffixes one letter longer into
their buckets, in order, all at once.
"""

from __future__ import annotations

import numpy as np

from trolley.llm.spans import Prefix, runs


def _smaller_next(s: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one (S-type); the last letter is the least."""
    n = len(s)
    change = np.where(s[:-1] != s[1:], np.arange(n - 1), n)
    decides = np.minimum.accumulate(change[::-1])[::-1]
    return np.append((s[:-1] < s[1:])[decides], True)


def _spread(found: np.ndarray, s: np.ndarray, sa: np.ndarray, heads: np.ndarray, step: int) -> None:
    """Append ``found`` to the buckets of their letters, upwards or downwards, in order."""
    letters = s[found]
    order = np.argsort(letters, kind="stable")
    found, letters = found[order], letters[order]
    firsts = np.concatenate([[0], np.flatnonzero(letters[1:] != letters[:-1]) + 1])
    counts = np.diff(np.append(firsts, len(letters)))
    used = letters[firsts]
    sa[np.repeat(heads[used], counts) + step * runs(counts)] = found
    heads[used] += step * counts


def _induced(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes sorted, given the leftmost-smaller ones in (some) order."""
    counts = np.bincount(s)
    ends = np.cumsum(counts)
    starts = ends - counts
    present = np.flatnonzero(counts)
    sa = np.empty(len(s), np.int64)
    n_lms = np.bincount(s[lms], minlength=len(counts))
    heads = ends - n_lms
    _spread(lms, s, sa, heads, 1)
    marked = {c: sa[ends[c] - n_lms[c] : ends[c]].copy() for c in present}
    heads = starts.copy()

    def longer(block: np.ndarray, kind: bool) -> np.ndarray:
        before = block - 1
        before = before[before >= 0]
        return before[smaller[before] == kind]

    for c in present:
        at = starts[c]
        while at < heads[c]:
            block, at = sa[at : heads[c]], heads[c]
            if len(found := longer(block, False)):
                _spread(found, s, sa, heads, 1)
        if len(found := longer(marked[c], False)):
            _spread(found, s, sa, heads, 1)
    # S-type suffixes anew, from the right; the last letter's own comes first of all
    tails = ends - 1
    sa[0] = len(s) - 1
    tails[0] = -1
    for c in present[::-1]:
        at = ends[c] - 1
        while at > tails[c]:
            block, at = sa[tails[c] + 1 : at + 1][::-1], tails[c]
            if len(found := longer(block, True)):
                _spread(found, s, sa, tails, -1)
        if len(found := longer(sa[starts[c] : heads[c]][::-1], True)):
            _spread(found, s, sa, tails, -1)
    return sa


def _reduced_order(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of the reduced string.

    Its alphabet is about as large as itself, so there are no buckets to walk: the names
    of twice as many letters are ranked in each round instead.
    """
    n, reach = len(names), 1
    while True:
        following = np.zeros(n, np.int64)
        following[:-reach or None] = names[reach:] + 1 if reach < n else following[:0]
        key = names * (n + 1) + following
        order = np.argsort(key, kind="stable")
        key = key[order]
        ranks = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        names = np.empty(n, np.int64)
        names[order] = ranks
        if ranks[-1] == n - 1:
            return order
        reach *= 2


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of a byte string in their order."""
    s = np.append(data.astype(np.uint16) + 1, np.uint16(0))
    smaller = _smaller_next(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) > 1:
        marked = np.zeros(len(s), bool)
        marked[lms] = True
        first = _induced(s, smaller, lms)
        first = first[marked[first]]
        # a leftmost-smaller substring ends with the first letter of the next one
        until = np.empty(len(s), np.int64)
        until[lms] = np.append(lms[1:] + 1, len(s))
        ends = np.minimum(until[first], len(data))
        hashes = Prefix(data).of(np.minimum(first, ends), ends)
        names = np.empty(len(s), np.int64)
        lasts = until[first] == len(s)
        same = (hashes[1:] == hashes[:-1]) & ~lasts[1:] & ~lasts[:-1]
        names[first] = np.concatenate([[0], np.cumsum(~same)])
        if names[first[-1]] + 1 < len(lms):
            lms = lms[_reduced_order(names[lms])]
        else:
            lms = first
    return _induced(s, smaller, lms)[1:]


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: of each suffix with the one before it in the order.

    Where the letters before the two suffixes are equal, the value is one less than that
    of the position before; only the other positions are searched, by hashes of spans.
    """
    n = len(data)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    at = np.arange(n)
    follows = np.zeros(n, bool)
    inner = before[1:] > 0
    follows[1:][inner] = data[:-1][inner] == data[before[1:][inner] - 1]
    # the chain holds only if the position before is compared with the suffix before its own
    follows[1:] &= before[:-1] >= 0
    own = at[~follows & (before >= 0)]
    other = before[own]
    most = n - np.maximum(own, other)
    prefix = Prefix(data)
    length = np.zeros(len(own), np.int64)
    todo = np.arange(len(own))
    step = 8
    # gallop upwards, then halve
    high = np.zeros(len(own), np.int64)
    while len(todo):
        reach = np.minimum(length[todo] + step, most[todo])
        a, b = own[todo] + length[todo], other[todo] + length[todo]
        gain = reach - length[todo]
        equal = prefix.of(a, a + gain) == prefix.of(b, b + gain)
        high[todo[~equal]] = reach[~equal]
        length[todo[equal]] = reach[equal]
        todo = todo[equal & (reach < most[todo])]
        step *= 2
    todo = np.flatnonzero(high > length + 1)
    while len(todo):
        middle = (length[todo] + high[todo]) // 2
        a, b = own[todo] + length[todo], other[todo] + length[todo]
        gain = middle - length[todo]
        equal = prefix.of(a, a + gain) == prefix.of(b, b + gain)
        length[todo[equal]] = middle[equal]
        high[todo[~equal]] = middle[~equal]
        todo = todo[high[todo] > length[todo] + 1]
    values = np.zeros(n, np.int64)
    values[own] = length
    source = np.maximum.accumulate(np.where(follows, 0, at))
    return np.where(follows, values[source] - (at - source), values)
