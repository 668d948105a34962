"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller or larger than their successor; leftmost-smaller substrings are
sorted by one round of induction, named, and their order found by recursion; a second round
induces the order of all suffixes from theirs. A bucket is induced at once: all entries that are
known when its turn comes send their predecessors to the other buckets with a stable radix sort,
and predecessors that fall into the same bucket follow in rounds. Reduced strings of many names are
written in digits, so the recursion is by induction at every depth.
"""

from __future__ import annotations

import numpy as np

#: Strings of more names than this are written in two digits a name, if that makes them so much
#: shorter than the string that they came from; each symbol is a step of the induction.
DIRECT, SHRINK = 512, 0.9


def _spread(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by key, the sorted keys, and each one's number among equal keys."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    rank = np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))
    return order, keys, rank


def _induce(text: np.ndarray, lms: np.ndarray, counts: np.ndarray, larger: np.ndarray) -> np.ndarray:
    """All suffixes, induced from the leftmost-smaller ones in the given order (grouped by first symbol)."""
    n, ends = len(text), np.cumsum(counts)
    starts = ends - counts
    out = np.empty(n, np.int32)
    head, tail = starts.copy(), ends.copy()
    of = np.bincount(text[lms], minlength=len(counts))
    lms_end = np.cumsum(of)
    for c in np.flatnonzero(counts):
        a, seen = starts[c], starts[c]
        while seen < head[c]:
            p = out[seen : head[c]] - 1
            seen = head[c]
            p = p[p >= 0]
            p = p[text[p] == c]
            out[seen : seen + len(p)] = p
            head[c] += len(p)
        p = np.concatenate([out[a : head[c]], lms[lms_end[c] - of[c] : lms_end[c]]]) - 1
        p = p[p >= 0]
        p = p[text[p] > c]
        if len(p):
            order, keys, rank = _spread(text[p])
            out[head[keys] + rank] = p[order]
            head += np.bincount(keys, minlength=len(counts))
    out[0] = n - 1
    tail[0] = 0
    for c in np.flatnonzero(counts)[::-1]:
        seen = ends[c]
        while c and seen > tail[c]:
            p = out[tail[c] : seen][::-1] - 1
            seen = tail[c]
            p = p[p >= 0]
            p = p[text[p] == c]
            out[seen - len(p) : seen] = p[::-1]
            tail[c] -= len(p)
        p = np.concatenate([out[tail[c] : ends[c]][::-1], out[starts[c] : starts[c] + larger[c]][::-1]]) - 1
        p = p[p >= 0]
        p = p[text[p] < c]
        if len(p):
            order, keys, rank = _spread(text[p])
            out[tail[keys] - 1 - rank] = p[order]
            tail -= np.bincount(keys, minlength=len(counts))
    return out


def _reduced(names: np.ndarray, parent: int) -> np.ndarray:
    """The suffix array of the names of a string of ``parent`` symbols; the last is the least and occurs only there.

    A name that occurs once ends every comparison that reaches it. So the string is cut down to the
    names that repeat, each run of them with the name behind it, and sorted by induction again.
    """
    n = len(names)
    counts = np.bincount(names)
    repeats = counts[names] > 1
    out = np.empty(n, np.int64)
    starts = np.cumsum(counts) - counts
    alone = np.flatnonzero(~repeats)
    out[starts[names[alone]]] = alone
    if len(alone) < n:
        kept = np.flatnonzero(repeats | np.append(False, repeats[:-1]) | (np.arange(n) == n - 1))
        met, text = np.unique(names[kept], return_inverse=True)
        digits = len(met) > DIRECT and len(kept) * 2 <= parent * SHRINK
        order = kept[_by_digits(text, len(met)) if digits else suffix_array(text, len(met))]
        out[np.repeat(counts, counts) > 1] = order[repeats[order]]
    return out


def _by_digits(names: np.ndarray, kinds: int) -> np.ndarray:
    """The suffix array of a string of many different names, by induction over their digits.

    Names become two digits each, so suffixes that start at a name compare as the names do; one
    symbol below the digits ends the string.
    """
    base = int(np.ceil(np.sqrt(kinds)))
    base += base * base < kinds
    text = np.zeros(len(names) * 2 + 1, np.uint32)
    text[:-1:2], text[1:-1:2] = names // base + 1, names % base + 1
    order = suffix_array(text, base + 1)
    return order[(order % 2 == 0) & (order < len(text) - 1)] // 2


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of the suffixes of ``text`` in order; the last symbol must be 0 and occur only there."""
    n = len(text)
    if n < 3:
        return np.arange(n)[::-1].astype(np.int32)
    if symbols <= 1 << 16:
        text = text.astype(np.uint16)  # for which numpy's stable sort is a radix sort
    differs = text[:-1] != text[1:]
    at = np.where(differs, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.append((text[:-1] < text[1:])[following], True)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    counts = np.bincount(text, minlength=symbols)
    larger = np.bincount(text[~smaller], minlength=symbols)
    by_symbol = lambda x: x[np.argsort(text[x], kind="stable")]
    rough = _induce(text, by_symbol(lms), counts, larger)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    stop = np.full(n, n - 1, np.int64)
    stop[lms[:-1]] = lms[1:]
    length = stop[ordered] - ordered + 1
    same = np.append(False, length[1:] == length[:-1])
    pair = np.flatnonzero(same)
    if len(pair):
        size = length[pair]
        base = np.append(0, np.cumsum(size)[:-1])
        step = np.arange(size.sum()) - np.repeat(base, size)
        equal = text[np.repeat(ordered[pair], size) + step] == text[np.repeat(ordered[pair - 1], size) + step]
        same[pair] = np.logical_and.reduceat(equal, base)
    name_of = np.empty(n, np.int64)
    name_of[ordered] = np.cumsum(~same) - 1
    names = name_of[lms]
    kinds = int(names.max()) + 1
    if kinds < len(names):
        ordered = lms[_reduced(names, n)]
    return _induce(text, ordered, counts, larger)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By place in the text: the length of the prefix that a suffix shares with its forerunner in ``order``.

    Lengths are compared only where the preceding symbols differ; elsewhere they are one less than
    at the place before.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    fixed = (before < 0) | (before == 0) | (i == 0)
    rest = np.flatnonzero(~fixed)
    fixed[rest] = text[rest - 1] != text[before[rest] - 1]
    starts = np.flatnonzero(fixed)
    found = np.zeros(len(starts), np.int64)
    live = np.flatnonzero(before[starts] >= 0)
    packed = np.append(text.astype(np.uint64), np.zeros(8, np.uint64))
    packed = packed[:-1] << np.uint64(9) | packed[1:]
    words = packed[:-6] << np.uint64(36) | packed[2:-4] << np.uint64(18) | packed[4:-2]
    words = np.append(words, np.zeros(8, np.uint64))
    while len(live):
        a, b = starts[live] + found[live], before[starts[live]] + found[live]
        inside = np.maximum(a, b) < n
        equal = inside & (words[np.minimum(a, n)] == words[np.minimum(b, n)])
        found[live[equal]] += 6
        off = live[~equal & inside]
        for _ in range(6):  # the six symbols of the first word that differs
            if not len(off):
                break
            a, b = starts[off] + found[off], before[starts[off]] + found[off]
            good = (np.maximum(a, b) < n) & (text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)])
            off = off[good]
            found[off] += 1
        live = live[equal]
    at = np.cumsum(fixed) - 1
    return found[at] - (i - starts[at])
