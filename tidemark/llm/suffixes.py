"""Suffix sorting in blocks with a difference cover."""

from __future__ import annotations

import numpy as np

#: A difference cover: each number modulo 31 is a difference of two of these.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: SHIFT[r, q]: the smallest d for which r + d and q + d are in the cover modulo PERIOD.
SHIFT = np.array([[next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (q + d) % PERIOD in COVER) for q in range(PERIOD)] for r in range(PERIOD)])
#: The shortest strings that a cover span, its shift and a tail of 62 bytes settle.
LEAST = 2 * PERIOD


def span_of(depth: int) -> int:
    """Bytes that a cover rank stands for: the period, doubled as often as the depth allows with a shift before it."""
    if depth < LEAST:
        raise ValueError(f"depth must be {LEAST} or more")
    return PERIOD << ((depth - PERIOD) // PERIOD).bit_length() - 1


#: Suffixes that are sorted together at most, unless one first-8-byte bucket is larger.
BLOCK = 1 << 20


def _eights(text: np.ndarray) -> np.ndarray:
    """For each position the next 8 bytes as a big-endian number; text has 8 bytes to spare."""
    out = np.zeros(len(text) - 7, dtype=np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | text[j : len(text) - 7 + j]
    return out


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of the rows (keys[0], keys[1], ..), equal for equal rows."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=np.int64)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(text: np.ndarray, eights: np.ndarray, span: int) -> np.ndarray:
    """By position, for positions in the cover: the rank of the next `span` bytes. -1 elsewhere."""
    n = len(text)
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    last = len(eights) - 1
    words = [eights[np.minimum(at + 8 * i, last)] for i in range(4)]
    words[3] = words[3] >> np.uint64(8)  # 31 bytes
    rank = np.full(n + span, -1, dtype=np.int64)
    rank[at] = _dense(*words)
    size = PERIOD
    while size < span:
        rank[at] = _dense(rank[at], rank[at + size])
        size *= 2
    return rank


def equal_suffixes(text: np.ndarray, starts: np.ndarray, depth: int, block: int = BLOCK) -> np.ndarray:
    """For each start the number of starts (itself included) whose next `depth` bytes are the same.

    Suffixes are dealt into buckets by their first 8 bytes, and one block of whole buckets
    is sorted at a time: by 31 bytes, then ties by a ternary partition around a pivot, whose
    comparisons look up precomputed ranks of cover positions instead of bytes. For a
    suffix and a pivot some shift under 31 takes both into the cover; two overlapping spans from
    there and the last 62 bytes settle a tie of any length up to depth, which is 62 or more. text must go on for depth bytes after each start.
    """
    span = span_of(depth)
    padded = np.concatenate([text, np.zeros(depth + 64, dtype=np.uint8)])
    eights = _eights(padded)
    rank = cover_ranks(padded, eights, span)
    second = (depth - span - PERIOD) // PERIOD * PERIOD  # of the second span, from the first
    tail = depth - 62
    assert 0 <= second <= span and second + span >= tail and second + span + PERIOD - 1 <= depth
    out = np.ones(len(starts), dtype=np.int64)
    first = eights[starts]
    order = np.argsort(first, kind="stable")
    heads = np.flatnonzero(np.append(True, first[order][1:] != first[order][:-1]))
    ends = np.append(heads[1:], len(order))
    a = 0
    while a < len(heads):
        b = max(a + 1, int(np.searchsorted(ends, heads[a] + block, "right")))
        ix = order[heads[a] : ends[b - 1]]
        a = b
        s = starts[ix]
        w = [first[ix], eights[s + 8], eights[s + 16], eights[s + 24] >> np.uint64(8)]
        o = np.lexsort(w[::-1])
        ix, s = ix[o], s[o]
        new = np.zeros(len(s), dtype=bool)
        new[0] = True
        for k in w:
            k = k[o]
            new[1:] |= k[1:] != k[:-1]
        group = np.cumsum(new) - 1
        while len(s):
            size = np.bincount(group)
            keep = size[group] > 1
            ix, s, group = ix[keep], s[keep], group[keep]
            if not len(s):
                break
            new = np.append(True, group[1:] != group[:-1])
            group = np.cumsum(new) - 1
            lead = np.flatnonzero(new)
            middle = (lead + np.append(lead[1:], len(s))) // 2
            pivot = s[middle][group]
            shift = SHIFT[s % PERIOD, pivot % PERIOD]
            sign = np.sign(rank[s + shift] - rank[pivot + shift])
            tied = np.flatnonzero(sign == 0)
            x, y = s[tied] + shift[tied] + second, pivot[tied] + shift[tied] + second
            sign[tied] = np.sign(rank[x] - rank[y])
            for j in (*range(0, 56, 8), 54):
                tied = np.flatnonzero(sign == 0)
                x, y = eights[s[tied] + tail + j], eights[pivot[tied] + tail + j]
                sign[tied] = (x > y).astype(np.int64) - (x < y)
            same = sign == 0
            out[ix[same]] = np.bincount(group[same], minlength=len(lead))[group[same]]
            rest = ~same
            key = group[rest] * 2 + (sign[rest] > 0)
            o = np.argsort(key, kind="stable")
            ix, s, key = ix[rest][o], s[rest][o], key[o]
            group = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1 if len(key) else key
    return out
