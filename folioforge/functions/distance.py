"""Edit distances of many pairs at once, and sets of letter pairs that bound them."""

from __future__ import annotations

import numpy as np

#: The shorter text of a pair is the pattern: a bit for each of its characters.
BITS = 64
#: Most entries of a table: patterns by characters, or texts by places.
TABLE = 1 << 21
#: Longs of a text's set of letter pairs.
LONGS = 8


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distances by characters of the pairs (a[i], b[i]), of which the
    shorter has 1 to BITS characters: Myers' bit vectors, a step for each character
    of the longer texts and all pairs in each step. Where a pattern has which
    character is laid out once for each distinct pattern."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    short, long_ = ({} for _ in range(2))
    at = np.array([(short.setdefault(x, len(short)), long_.setdefault(y, len(long_))) for x, y in pairs])
    letters = np.unique(np.frombuffer("".join([*short, *long_]).encode("utf-32-le", "surrogatepass"), dtype="<u4"))
    width = max(map(len, long_))
    if len(pairs) > 1 and max(len(short) * (len(letters) + 1), len(long_) * width) > TABLE:
        half = len(pairs) // 2
        return np.concatenate([edit_distances(a[:half], b[:half]), edit_distances(a[half:], b[half:])])
    # Column 0 is for places past a text's end: no pattern has it.
    pattern, text = (np.where((c := _codes(list(t), w)) == PAST, 0, np.searchsorted(letters, c) + 1) for t, w in ((short, BITS), (long_, width)))
    has = np.zeros((len(short), len(letters) + 1), dtype=np.uint64)
    rows = np.arange(len(short))
    for i in range(BITS):
        has[rows, pattern[:, i]] |= np.uint64(1 << i)
    has[:, 0] = 0
    size, end = np.array(list(map(len, short)))[at[:, 0]], np.array(list(map(len, long_)))[at[:, 1]]
    one, last, has, base, mine = np.uint64(1), (size - 1).astype(np.uint64), has.ravel(), at[:, 0] * (len(letters) + 1), at[:, 1]
    more, less, score = np.full(len(size), ~np.uint64(0)), np.zeros(len(size), dtype=np.uint64), size.astype(np.int64)
    for j, codes in enumerate(np.ascontiguousarray(text.T)):
        same = has[base + codes[mine]]
        down = same | less
        across = (((same & more) + more) ^ more) | same
        plus, minus = less | ~(across | more), more & across
        step = ((plus >> last) & one).astype(np.int64) - ((minus >> last) & one).astype(np.int64)
        score += np.where(j < end, step, 0)
        plus, minus = plus << one | one, minus << one
        more, less = minus | ~(down | plus), plus & down
    return score


def letter_pairs(texts: list[str]) -> np.ndarray:
    """A row of LONGS longs for each text: its letter pairs as a set of bits, in which
    a pair's second occurrence is another element than its first. An edit takes two
    elements from a text and adds two at most."""
    out = np.zeros((len(texts), LONGS), dtype=np.int64)
    order, at = sorted(range(len(texts)), key=lambda i: len(texts[i])), 0
    while at < len(order):
        n = min(4096, len(order) - at)
        while n > 1 and n * len(texts[order[at + n - 1]]) > TABLE // 8:
            n //= 2
        part, at = order[at : at + n], at + n
        width = max(len(texts[part[-1]]), 2)
        codes = _codes([texts[i] for i in part], width).astype(np.uint64)
        pairs = codes[:, :-1] << np.uint64(32) | codes[:, 1:]
        pairs[codes[:, 1:] == PAST] = ~np.uint64(0)
        pairs.sort(axis=1)
        place = np.arange(width - 1)
        first = np.maximum.accumulate(np.where(np.diff(pairs, axis=1, prepend=~pairs[:, :1]) != 0, place, 0), axis=1)
        mixed = pairs * np.uint64(0x9E3779B97F4A7C15) + (place - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(55)
        mixed[pairs == ~np.uint64(0)] = LONGS * 64
        held = np.zeros((n, LONGS * 64 + 8), dtype=bool)
        np.put_along_axis(held, mixed.astype(np.int64), True, axis=1)
        out[part] = np.packbits(held[:, : LONGS * 64], axis=1, bitorder="little").view("<i8")
    return out


#: What stands past a text's end; no character has this code.
PAST = 0x110000


def _codes(texts: list[str], width: int) -> np.ndarray:
    size = np.array(list(map(len, texts)))
    padded = "".join(t.ljust(width, "\0") for t in texts)
    codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(texts), width)
    return np.where(np.arange(width) < size[:, None], codes, np.uint32(PAST))
