"""Repeated blocks inside texts as numpy kernels (inventory id C14): a text is one task's work and is compared with itself alone.

A block begins where two equal words have unlike characters before them and ends where they have
unlike ones after them.  Only such pairs are made, so that work follows the number of
blocks and not that of all equal pairs of words: n equal characters are some 2 n blocks, not n * n pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters that are searched at once, and pairs that are made at once.
_CHARACTERS, _PAIRS = 1 << 20, 1 << 21


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of codes[i : i + width], from those of widths that are powers of two; beyond the end is 0."""
    shift = lambda x, k: np.concatenate([x[k:], np.zeros(min(k, len(x)), np.uint64)])
    one, out, done, size = _mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), None, 0, 1
    while True:
        if width & size:
            piece = shift(one, done)
            out = piece if out is None else _mix(out * np.uint64(0xD6E8FEB86659FD93) + piece)
            done += size
        if done == width:
            return out
        one = _mix(one * np.uint64(0xA0761D6478BD642F) + shift(one, size))
        size *= 2


def _unlike(key: np.ndarray, side: np.ndarray, key2: np.ndarray, side2: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (i, j) of all pairs of equal keys whose sides differ, some at a time."""
    order = np.lexsort((side2, key2))
    key2, side2 = key2[order], side2[order]
    first, last = np.searchsorted(key2, key, "left"), np.searchsorted(key2, key, "right")
    # those of the same side lie together within a key's
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(key2)), bool), (key2[1:] != key2[:-1]) | (side2[1:] != side2[:-1])]))
    run = np.concatenate([new, [len(key2)]])
    both = lambda k, s: _mix(k + _mix(s.astype(np.uint64)))
    known = both(key2[new], side2[new])
    by = np.argsort(known)
    found = np.append(known[by], 0)
    same = np.minimum(np.searchsorted(known[by], both(key, side)), len(new))
    has = (same < len(new)) & (found[same] == both(key, side))
    same = np.append(by, 0)[same]
    begin, end = np.where(has, run[same], first), np.where(has, run[np.minimum(same + 1, len(new))], first)
    count = (last - first) - (end - begin)
    upto = np.cumsum(count)
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _PAIRS, "right")))
        n = count[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[i]
        yield i, order[np.where(j >= begin[i], j + (end - begin)[i], j)]
        lo = hi


def _among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each of x is in y, by sorting: numpy's own hashes these slowly."""
    y = np.sort(y)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))


def blocks(codes: np.ndarray, starts: np.ndarray, least: int, back: np.ndarray | None = None, bad: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text, start1, start2, len) of the maximal repeated blocks in texts that lie one after the other, text t from starts[t] to starts[t + 1].

    Without back, of blocks that are repeated as they are (start1 < start2); with the texts'
    involutes, of blocks that have their involute in the text (start1 <= start2). No block holds a bad character.
    """
    n = len(codes)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    lo, hi = starts[text], starts[text + 1]
    at = np.arange(n)
    broken = np.zeros(n, bool) if bad is None else bad
    before_sum = np.concatenate([[0], np.cumsum(broken)])
    fits = at + least <= hi
    fits[fits] = before_sum[at[fits] + least] == before_sum[at[fits]]

    def sides(c: np.ndarray, ill: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
        # a character that isn't there, or is bad, ends a block by itself: it gets its place as a name
        alone = -(at + 1) - mark * (n + least)
        c, prev, nxt = c.astype(np.int64), at - 1, np.minimum(at + least, n - 1)
        return np.where((at == lo) | ill[prev], alone, c[prev]), np.where((at + least >= hi) | ill[nxt], alone, c[nxt])

    def words(c: np.ndarray) -> np.ndarray:
        return _mix(_word_hashes(c, least) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    key, (before, after) = words(codes), sides(codes, broken, 0)
    if back is None:
        p = np.flatnonzero(fits)
        order = np.argsort(key[p], kind="stable")
        k = key[p][order]
        again = np.flatnonzero(k[1:] == k[:-1])
        p = q = p[order[np.union1d(again, again + 1)]]
        key2, before2, after2, place2 = key, before, after, at
        begins = [(a[m], b[m]) for a, b in ((p[i], q[j]) for i, j in _unlike(key[p], before[p], key[q], before[q])) for m in [a < b]]
        ends = [(a[m], b[m]) for a, b in ((p[i], q[j]) for i, j in _unlike(key[p], after[p], key[q], after[q])) for m in [a < b]]
        along = lambda a, b: b - a
    else:
        # the word at place2[r] is, turned round, that of the involute at r
        mirrored = lo + hi - 1 - at
        place2 = lo + hi - at - least
        key2, (before2, after2) = words(back), sides(back, broken[mirrored], 1)
        r = np.flatnonzero(at + least <= hi)
        r = r[fits[place2[r]]]
        p = np.flatnonzero(fits)
        p = p[_among(key[p], key2[r])]
        r = r[_among(key2[r], key[p])]
        begins = [(a[m], b[m]) for a, b in ((p[i], place2[r[j]]) for i, j in _unlike(key[p], before[p], key2[r], before2[r])) for m in [a <= b]]
        ends = [(a[m], b[m]) for a, b in ((p[i], place2[r[j]]) for i, j in _unlike(key[p], after[p], key2[r], after2[r])) for m in [a + 1 < b]]
        # a block goes no further than the middle between its two parts
        for step in (0, 1):
            a = p[(p + step < n) & (p + step + least <= hi[p])]
            b = a + step
            m = fits[b] & (key[a] == key2[lo[a] + hi[a] - b - least])
            ends.append((a[m], b[m]))
        along = lambda a, b: a + b - 2 * lo[a]
    (a, b), (c, d) = _joined(begins), _joined(ends)
    first, last = np.lexsort((a, along(a, b), text[a])), np.lexsort((c, along(c, d), text[c]))
    a, c = a[first], c[last]
    # both parts are given by their first places: a mirrored one's is where the other ends
    return text[a], a - lo[a], (b[first] if back is None else d[last]) - lo[a], c - a + least


def kernel(least: int, alphabet: str | None):
    """Blocks of batches (id, s, back), back null for direct repeats, as (id, start1, start2, len)."""

    def of(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts, backs = part.columns
        coded = lambda xs: [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in xs.to_pylist()]
        codes = coded(texts)
        starts = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
        flat = np.concatenate(codes)
        bad = None
        if alphabet:
            import re

            found, which = np.unique(flat, return_inverse=True)
            bad = np.array([not re.match(f"[{alphabet}]$", chr(c)) for c in found.tolist()])[which]
        text, start1, start2, size = blocks(flat, starts, least, None if backs.null_count else np.concatenate(coded(backs)), bad)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(text)), pa.array(start1.astype(np.int32)), pa.array(start2.astype(np.int32)), pa.array(size.astype(np.int64))], names=["id", "start1", "start2", "len"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([len(x) for x in batch.column(1).to_pylist()])
            lo = 0
            while lo < len(sizes):
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + _CHARACTERS, "right")))
                found = of(batch.slice(lo, hi - lo))
                for k in range(0, found.num_rows, 50_000):
                    yield found.slice(k, 50_000)
                lo = hi

    return run
