"""A word-level BPE tokenizer compiled to a finite-state transducer.

The pre-tokenizer's pattern is compiled to a deterministic automaton over a few
character classes; its transitions say where words begin and, with that, where
the word before is closed. The transition that closes a word emits how many
tokens the word has (or, to encode, its ids): merges in rank order say so once
for each distinct word, for all new words of a batch together.

Texts are cut into chunks of equal length, and all chunks advance together, one
character a step. First each chunk starts from every state at once, which gives
its map from entry state to exit state; a prefix scan composes the maps, so that
each chunk learns its true entry state. Then each chunk runs from that state,
and its closing transitions' counts add up to what it emits; a second scan
composes those sums, so that the count of a text is a difference of two prefixes.
The counts on the paths from other entry states are never needed.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from .common import Numbers

#: Classes and states of the compiled pre-tokenizer pattern.
#: 's|'t|'re|'ve|'m|'ll|'d | letters | one number | what is neither nor white space
C_SPACE, C_LETTER, C_NUMBER, C_OTHER, C_APOSTROPHE, C_STMD, C_R, C_V, C_L, C_E = range(10)
S_SPACE, S_LETTER, S_NUMBER, S_OTHER, S_CLOSED, S_APO, S_APO_R, S_APO_V, S_APO_L = range(9)
N_STATES, N_CLASSES = 9, 10
#: Code points that this Python's Unicode tables do not know: left to the library.
C_UNKNOWN = 10
#: Emissions: a word begins here; one began at the character before; both.
HERE, BEFORE = 1, 2
CHUNK = 2048


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) by state and class, state-major."""
    step = np.zeros((N_STATES, N_CLASSES), dtype=np.uint8)
    emit = np.zeros((N_STATES, N_CLASSES), dtype=np.uint8)
    begins = {C_SPACE: S_SPACE, C_NUMBER: S_NUMBER, C_OTHER: S_OTHER, C_APOSTROPHE: S_APO}
    for s in range(N_STATES):
        for c in range(N_CLASSES):
            step[s, c], emit[s, c] = begins.get(c, S_LETTER), HERE
    for c in range(N_CLASSES):
        if c not in begins:
            emit[S_LETTER, c] = 0
    for s in (S_OTHER, S_APO):
        for c in (C_OTHER, C_APOSTROPHE):
            step[s, c], emit[s, c] = S_OTHER, 0
    step[S_APO, C_STMD], emit[S_APO, C_STMD] = S_CLOSED, 0
    for c, s in ((C_R, S_APO_R), (C_V, S_APO_V), (C_L, S_APO_L)):
        step[S_APO, c], emit[S_APO, c] = s, 0
    for s, closes in ((S_APO_R, C_E), (S_APO_V, C_E), (S_APO_L, C_L)):
        for c in range(N_CLASSES):  # no contraction after all: the letter before began a word
            emit[s, c] = BEFORE | (HERE if c in begins else 0)
        step[s, closes], emit[s, closes] = S_CLOSED, 0
    return step, emit


STEP, EMIT = _compile()


@lru_cache(maxsize=1)
def char_class() -> np.ndarray:
    out = np.full(0x110000, C_OTHER, dtype=np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            out[i] = C_LETTER
        elif kind == "N":
            out[i] = C_NUMBER
        elif chr(i).isspace() and not 0x1C <= i <= 0x1F:
            out[i] = C_SPACE
        elif unicodedata.category(chr(i)) == "Cn":
            out[i] = C_UNKNOWN
    for chars, c in (("'", C_APOSTROPHE), ("stmd", C_STMD), ("r", C_R), ("v", C_V), ("l", C_L), ("e", C_E)):
        for x in chars:
            out[ord(x)] = c
    return out


def normalize(text: str) -> str:
    """NFC, then each character by itself in lower case."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan: row i becomes maps[i] after ... after maps[0]."""
    out, shift = maps.copy(), 1
    while shift < len(out):
        out[shift:] = np.take_along_axis(out[shift:], out[:-shift], axis=1)
        shift *= 2
    return out


def chunk_width(n: int) -> int:
    return max(1, min(CHUNK, -(-n // 64)))


def word_starts(classes: np.ndarray) -> np.ndarray:
    """Where words or white space begin in a character-class array that starts
    and ends with white space; by chunk state maps and their prefix scan."""
    n, width = len(classes), chunk_width(len(classes))
    rows = -(-n // width)
    grid = np.zeros(rows * width, dtype=np.uint8)  # padded with white space
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    table = STEP.T.copy()  # class-major: a row holds the map of one character
    maps = np.broadcast_to(np.arange(N_STATES, dtype=np.uint8), (rows, N_STATES)).copy()
    flat, base = table.ravel(), np.empty((rows, 1), dtype=np.intp)
    for j in range(width):
        base[:, 0] = grid[j]
        base *= N_STATES
        maps = flat[base + maps]
        if j >= 8 and j % 8 == 0 and (maps == maps[:, :1]).all():
            # every chunk forgot its entry state; one run from it is the map
            state = maps[:, 0]
            for i in range(j + 1, width):
                state = flat[grid[i].astype(np.intp) * N_STATES + state]
            maps = np.broadcast_to(state[:, None], maps.shape)
            break
    entry = np.full(rows, S_SPACE, dtype=np.uint8)
    entry[1:] = compose(np.ascontiguousarray(maps))[:-1, S_SPACE]
    both = (STEP.astype(np.uint8) | (EMIT << 4)).T.copy().ravel()
    seen, state = np.empty((width, rows), dtype=np.uint8), entry
    for j in range(width):
        out = both[grid[j].astype(np.intp) * N_STATES + state]
        seen[j] = out >> 4
        state = out & 15
    seen = seen.T.ravel()[:n]
    starts = (seen & HERE).astype(bool)
    starts[:-1] |= (seen[1:] & BEFORE).astype(bool)
    return starts


def emitted_before(at: np.ndarray, closes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """How many tokens the transitions before each of the (rising) positions
    ``at`` of n emit. closes: where words are closed, rising; counts: what these
    transitions emit. Whole chunks come from the scan of the chunks' sums."""
    width = chunk_width(n)
    sums = np.bincount(closes // width, weights=counts, minlength=-(-n // width) + 1).astype(np.int64)
    before = np.cumsum(sums) - sums
    inside = np.concatenate([[0], np.cumsum(counts)])
    chunk = at // width
    first, last = np.searchsorted(closes, chunk * width), np.searchsorted(closes, at)
    return before[chunk] + inside[last] - inside[first]


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class WordBPE:
    """Compiled from a tokenizers JSON file with a word-end suffix."""

    def __init__(self, path: str, most_words: int = 100_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        chars = byte_alphabet()
        self.first = np.array([vocab.get(c, -1) for c in chars], dtype=np.int64)
        self.last = np.array([vocab.get(c + end, -1) for c in chars], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.is_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.mark = os.path.commonprefix(list(self.special))  # what every special string begins with
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.most_words, self.odd = most_words, set()
        self.number, self.counts = Numbers(), np.zeros(0, dtype=np.int64)
        self.known, self.length, self.start, self.flat = Numbers(), *self.nothing()
        self.library = Tokenizer.from_file(path)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.rank[at], len(self.rank))

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What merging leaves of all words together: symbols, in order within
        their word, and the number of the word each belongs to."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        sym, ends = self.first[data], np.cumsum(sizes)
        sym[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        none = len(self.rank)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(sym), none)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self._ranks(sym[inner], sym[inner + 1])  # of the pair that begins here
        while len(sym):
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, begin)
            spans = np.diff(np.r_[begin, len(sym)])
            low = np.repeat(least, spans)
            over = low == none
            if over.any():
                done.append((sym[over], word[over]))
                go = ~over
                sym, word, rank, low = sym[go], word[go], rank[go], low[go]
                if not len(sym):
                    break
            hit = rank == low
            touch = np.flatnonzero(hit[1:] & hit[:-1])
            if len(touch):  # of overlapping equal pairs, every other from the left
                run = np.flatnonzero(hit)
                head = np.r_[True, np.diff(run) != 1]
                since = np.arange(len(run)) - np.maximum.accumulate(np.where(head, np.arange(len(run)), 0))
                hit[run[since % 2 == 1]] = False
            at = np.flatnonzero(hit)
            sym[at] = self.made[low[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, rank = sym[keep], word[keep], rank[keep]
            at = moved[at]
            again = np.concatenate([at, at[at > 0] - 1])  # some twice, with the same result
            inside = again[again + 1 < len(sym)]
            same = word[inside] == word[inside + 1]
            rank[again] = none
            inside = inside[same]
            rank[inside] = self._ranks(sym[inside], sym[inside + 1])
        return tuple(np.concatenate([d[i] for d in done]) for i in (0, 1))

    def parts(self, texts: list[str | None]) -> tuple[list[str], list[int]]:
        """Normalised texts, cut at special strings, and whose each part is; a
        special string's part has the owner -i - 1."""
        parts, owner = [], []
        for i, t in enumerate(texts):
            at = 0
            for m in self.is_special.finditer(t) if t and self.mark in t else ():
                parts += [normalize(t[at : m.start()]), m[0]]
                owner += [i, -i - 1]
                at = m.end()
            parts.append(normalize(t[at:] if at else t or ""))
            owner.append(i)
        return parts, owner

    def closed(self, parts: list[str], owner: list[int]) -> tuple[list[str], np.ndarray, np.ndarray, int]:
        """All words, where each is closed, the bounds of the parts, and the length
        of the joined text. Owners with code points of unknown class are noted in
        ``odd``."""
        plain = ["" if o < 0 else p for p, o in zip(parts, owner, strict=True)]
        joined = " " + " ".join(plain) + " "
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        classes = char_class()[codes]
        unknown = np.flatnonzero(classes == C_UNKNOWN)
        classes[unknown] = C_OTHER
        starts = np.flatnonzero(word_starts(classes))
        some = classes[starts] != C_SPACE
        words, ends = starts[some], np.append(starts[1:], len(classes))[some]
        bounds = np.cumsum([1, *(1 + len(p) for p in plain)])
        self.odd = {owner[k] if owner[k] >= 0 else -owner[k] - 1 for k in np.searchsorted(bounds, unknown, side="right") - 1}
        # All words are cut out at once: their characters alone, with a blank before each.
        inside = classes != C_SPACE
        spaced = np.insert(codes[inside], (np.cumsum(inside) - 1)[words], 32)
        return spaced.tobytes().decode("utf-32-le", "surrogatepass").split(" ")[1:], ends, bounds, len(classes)

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these words one after the other, and how many each has.
        Known words are kept up to a bound, then all are forgotten, which costs time
        only."""
        if len(self.known) > self.most_words:
            self.known, self.length, self.start, self.flat = Numbers(), *self.nothing()
        numbers, new = self.known.of(words)
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            sym, word = self.merged(part)
            size = np.bincount(word, minlength=len(part))
            self.start = np.concatenate([self.start, np.cumsum(size) - size + len(self.flat)])
            self.length = np.concatenate([self.length, size])
            self.flat = np.concatenate([self.flat, sym[np.argsort(word, kind="stable")].astype(np.uint16)])
        size = self.length[numbers]
        return self.flat[np.repeat(self.start[numbers] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))], size

    @staticmethod
    def nothing() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint16)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 16-bit integers."""
        parts, owner = self.parts(texts)
        words, closes, bounds, _ = self.closed(parts, owner)
        flat, size = self.ids_of(words)
        cuts = (2 * np.concatenate([[0], np.cumsum(size)])[np.searchsorted(closes, bounds)]).tolist()
        data, out = flat.astype("<u2").tobytes(), [b""] * len(texts)
        for k, (p, o) in enumerate(zip(parts, owner, strict=True)):
            if o < 0:
                out[-o - 1] += np.array([self.special[p]], dtype="<u2").tobytes()
            else:
                out[o] = out[o] + data[cuts[k] : cuts[k + 1]] if out[o] else data[cuts[k] : cuts[k + 1]]
        for i in self.odd:
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, dtype="<u2").tobytes()
        return out

    def tokens_of(self, words: list[str]) -> np.ndarray:
        """How many tokens each word has; no ids are made. Known words are kept up
        to a bound, then all are forgotten, which costs time only."""
        if len(self.number) > self.most_words:
            self.number, self.counts = Numbers(), np.zeros(0, dtype=np.int64)
        numbers, new = self.number.of(words)
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.counts = np.concatenate([self.counts, np.bincount(self.merged(part)[1], minlength=len(part))])
        return self.counts[numbers]

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of whole texts."""
        parts, owner = self.parts(texts)
        words, closes, bounds, n = self.closed(parts, owner)
        before = emitted_before(bounds, closes, self.tokens_of(words), n)
        out = np.zeros(len(texts), dtype=np.int64)
        whose = np.array(owner, dtype=np.int64)
        np.add.at(out, np.where(whose < 0, -whose - 1, whose), np.where(whose < 0, 1, np.diff(before)))
        for i in self.odd:
            out[i] = len(self.library.encode(texts[i], add_special_tokens=False).ids)
        return out.tolist()


@lru_cache(maxsize=2)
def compiled(path: str) -> WordBPE:
    return WordBPE(path)
