"""Which of many strings stand in a text: exact, in time and memory that do not multiply the two."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Numbers of comparisons up to which strings are looked for one by one; code points that are looked at together.
FEW, BLOCK = 4_000_000, 1 << 20
END = 0x110000  # between texts: no code point
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * ODD[0] + (b ^ (b >> np.uint64(29))) * ODD[1]
    return h ^ (h >> np.uint64(32))


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")


def _blocks(texts: list[str], overlap: int) -> Iterator[np.ndarray]:
    """The texts' code points with END after each, in blocks that begin with the end of the one before."""
    end, held, size = np.array([END], "<u4"), [np.zeros(0, "<u4")], 0
    for t in texts:
        for lo in range(0, len(t), BLOCK):
            held.append(_points(t[lo : lo + BLOCK]))
            size += len(held[-1])
            if size >= BLOCK:
                yield (b := np.concatenate(held))
                held, size = [b[max(0, len(b) - overlap) :]], 0
        held.append(end)
    yield np.concatenate(held)


def _windows(points: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Hashes of all windows of 1, 2, 4 ... code points, each length from the one before."""
    h = _mixed(points.astype(np.uint64), np.zeros(len(points), np.uint64))
    width = 1
    while width <= most:
        yield h
        h = _mixed(h[:-width], h[width:]) if len(h) > width else h[:0]
        width *= 2


def standing(wanted: list[str], texts: list[str]) -> set[str]:
    """Those of the wanted strings that are a substring of some text.

    A string of q to 2q - 1 code points, q a power of 2, is known by its first and its last q. Windows of q in the texts that are
    some string's beginning are tried with each length that strings of that class have; what agrees by hash is compared itself.
    """
    distinct = list(dict.fromkeys(wanted))
    if sum(map(len, texts)) * len(distinct) <= FEW:
        return {w for w in distinct if any(w in t for t in texts)}
    found = {w for w in distinct if not w}
    distinct = [w for w in distinct if w]
    if not distinct:
        return found
    lengths = np.array([len(w) for w in distinct])
    most = int(lengths.max())
    levels = np.frexp(lengths)[1] - 1
    first, last = np.zeros(len(distinct), np.uint64), np.zeros(len(distinct), np.uint64)
    lo = 0
    while lo < len(distinct):  # hashes of the strings, some at a time
        hi = min(len(distinct), lo + max(1, int(np.searchsorted(np.cumsum(lengths[lo:]), BLOCK))))
        at = np.concatenate([[0], np.cumsum(lengths[lo:hi])])[:-1]
        for level, h in enumerate(_windows(_points("".join(distinct[lo:hi])), int(lengths[lo:hi].max()))):
            own = np.flatnonzero(levels[lo:hi] == level)
            first[lo + own], last[lo + own] = h[at[own]], h[at[own] + lengths[lo + own] - (1 << level)]
        lo = hi
    classes = {}
    for level in np.unique(levels):
        own = np.flatnonzero(levels == level)
        seen = np.zeros(1 << 22, bool)
        seen[first[own] >> np.uint64(42)] = True
        by_length = []
        for n in np.unique(lengths[own]):
            of = own[lengths[own] == n]
            key, one, many = np.unique(_mixed(first[of], last[of]), return_index=True, return_counts=True)
            by_length.append((int(n), key, of[one]))
            if len(key) < len(of):  # different strings of one hash
                found.update(w for w in (distinct[k] for k in np.delete(of, one[many == 1])) if any(w in t for t in texts))
        classes[int(level)] = seen, np.unique(first[own]), by_length
    for points in _blocks(texts, most - 1):
        for level, h in enumerate(_windows(points, most)):
            if level not in classes or not len(h):
                continue
            seen, firsts, by_length = classes[level]
            at = np.flatnonzero(seen[h >> np.uint64(42)])
            at = at[firsts[np.minimum(np.searchsorted(firsts, h[at]), len(firsts) - 1)] == h[at]]
            for n, key, of in by_length:
                p = at[at + n <= len(points)]
                k = _mixed(h[p], h[p + n - (1 << level)])
                i = np.minimum(np.searchsorted(key, k), len(key) - 1)
                hit = key[i] == k
                p, i = p[hit], i[hit]
                _, one = np.unique(i, return_index=True)
                for x, j in zip(p[one].tolist(), i[one].tolist(), strict=True):
                    w = distinct[of[j]]
                    if w in found:
                        continue
                    want = _points(w)
                    if np.array_equal(points[x : x + n], want) or any(np.array_equal(points[y : y + n], want) for y in p[i == j].tolist()):
                        found.add(w)
    return found
