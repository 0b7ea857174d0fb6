"""Secrets in texts: fixed patterns, and password guess cost in credential context.

The guess cost of a value is the cheapest way to build it from words of a
ranked list, dates, repeats of blocks, keyboard walks, sequences and brute-force
spans, found by dynamic programming over its positions (base-10 logarithms of
guess counts add up along the segmentation). Values that stand where a credential
stands and cost enough are reported as spans of kind ``guess``.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, map_rows

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs below 24 characters would fail anyway, and a run cannot hold another.
HEX = re.compile(r"[0-9a-f]{24,}")
#: Wider context than ASSIGN: more names, more separators, quoted or bare values. A
#: name may end an identifier, after a separator or digit or with its own capital.
NAME = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret(?:[_-]?key)?|token|api[_-]?key|access[_-]?key|auth(?:orization)?|bearer|credentials?|private[_-]?key)"
CONTEXT = re.compile(
    rf"""(?ai)(?:(?<![a-z])|(?-i:(?<=[a-z])(?=[A-Z]))){NAME}"""
    r"""(?:["']?(?:\x20*(?::=|=>|[:=])\x20*|\x20+is\x20+)|(?<=bearer)\x20+)["']?(?=[^\s"'<>,;]{6})"""
)
#: A value goes on to the next of these.
RUN = re.compile(r"""[^\s"'<>,;]*""")
NAMED = re.compile(rf"(?ai){NAME}(?![a-z0-9])")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
LEET = str.maketrans("@4301!5$7", "aaeoiisst")


#: A repeat's block has at most so many characters.
BLOCK = 16
#: Starting a brute-force span costs as much as doubling the guesses.
START = 0.3


class Ranks(dict):
    """Words and their ranks, and how long the longest word is."""

    def __init__(self, words: list[str]) -> None:
        super().__init__((w, i + 1) for i, w in enumerate(words))
        self.longest = max(map(len, words), default=0)


@lru_cache(maxsize=2)
def word_ranks(path: str) -> Ranks:
    """Ranks of whole words of three letters or more, most common first, from the
    merge order of a public word-level BPE vocabulary."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = [w[:-4] for w, _ in sorted(vocab.items(), key=lambda x: x[1]) if w.endswith("</w>")]
    return Ranks([w for w in words if len(w) > 2 and w.isascii() and w.isalpha()])


def _charset(s: str) -> int:
    return max(10, 26 * any(c.islower() for c in s) + 26 * any(c.isupper() for c in s) + 10 * any(c.isdigit() for c in s) + 33 * any(not c.isalnum() for c in s))


def word_cost(word: str, ranks: Ranks) -> float:
    """Of a word of the list, as it is or with common letters for signs; else infinite."""
    low, extra = "".join(c.lower()[0] for c in word), 0.0
    rank = ranks.get(low)
    if rank is None and (plain := low.translate(LEET)) != low:
        rank, extra = ranks.get(plain), math.log10(4)
    if rank is None:
        return math.inf
    caps = 0.0 if word == low else math.log10(2 if word.istitle() or word.isupper() else 2.0 ** min(len(word), 20))
    return math.log10(rank + 1) + extra + caps


def date_cost(n: int) -> float:
    return math.log10(119 if n == 4 else 119 * 372)


def walk_cost(n: int) -> float:
    return math.log10(47 * 8 * n)


def sequence_cost(n: int) -> float:
    return math.log10(62 * 2 * n)


class Costs:
    """Guess costs of all suffixes of one value, which share their tables."""

    def __init__(self, value: str, ranks: Ranks) -> None:
        self.value, self.ranks = value, ranks
        self.low = "".join(c.lower()[0] for c in value)  # one character each
        self.plain = self.low.translate(LEET)
        self.kinds = [0] * (len(value) + 1)  # which character sets a suffix has
        for i in range(len(value) - 1, -1, -1):
            c = value[i]
            self.kinds[i] = self.kinds[i + 1] | c.islower() | c.isupper() << 1 | c.isdigit() << 2 | (not c.isalnum()) << 3
        self.blocks: dict[str, float] = {}
        self.made: dict[int, tuple[list[float], list[tuple[str, int]]]] = {}

    def of(self, start: int = 0) -> float:
        """log10 of the guesses of the cheapest segmentation from start to the end."""
        return self._table(start)[0][start]

    def spans(self) -> list[tuple[str, int, int]]:
        """(kind, start, end) of the cheapest segmentation of the whole value."""
        out, i, (_, on) = [], 0, self._table(0)
        while i < len(self.value):
            kind, j = on[i]
            out.append((kind, i, j))
            i = j
        return out

    def _table(self, start: int) -> tuple[list[float], list[tuple[str, int]]]:
        """Suffixes with the same character sets differ in where they begin only, so
        a value has a few tables, however many starts are asked for."""
        kind = self.kinds[start]
        if kind not in self.made:
            self.made[kind] = self._fill(self.kinds.index(kind), math.log10(_charset(self.value[start:])) if start < len(self.value) else 0.0)
        return self.made[kind]

    def _fill(self, first: int, per_char: float) -> tuple[list[float], list[tuple[str, int]]]:
        value, low, plain, ranks = self.value, self.low, self.plain, self.ranks
        n = len(value)
        best, brute = [math.inf] * n + [0.0], [math.inf] * (n + 1)
        on: list[tuple[str, int]] = [("", n)] * (n + 1)
        until = [n] * (n + 1)  # where the brute-force span ends that begins here cheapest
        alike = [0] * (BLOCK + 1)  # how many characters from here equal those a block after
        walk = line = n  # where the walk and the sequence that begin here end
        way: tuple[int, int] | None = None
        step = 0
        for i in range(n - 1, first - 1, -1):
            c = low[i]
            if i + 1 < n:
                p = low[i + 1]
                at, after = PLACE.get(c), PLACE.get(p)
                now = (after[0] - at[0], after[1] - at[1]) if at and after else None
                if now is None or now == (0, 0) or max(map(abs, now)) > 1:
                    walk, way = i + 1, None
                elif way is not None and now[0] * way[0] + now[1] * way[1] < 0:
                    walk, way = i + 2, now
                else:
                    way = now
                d = ord(p) - ord(c)
                if abs(d) != 1 or not (c.isalnum() and p.isalnum()):
                    line, step = i + 1, 0
                elif d != step:
                    line, step = i + 2, d
            new, further = best[i + 1] + START + per_char, brute[i + 1] + per_char
            brute[i], until[i] = (further, until[i + 1]) if further <= new else (new, i + 1)
            found = [(brute[i], "brute", until[i])]
            if m := DATE.match(value, i):
                found.append((best[m.end()] + date_cost(m.end() - i), "date", m.end()))
            for size in range(1, min(BLOCK, n - i - 1) + 1):
                alike[size] = alike[size] + 1 if c == low[i + size] else 0
                times = alike[size] // size + 1
                if times >= (3 if size == 1 else 2):
                    block = value[i : i + size]
                    if block not in self.blocks:
                        self.blocks[block] = math.log10(_charset(block)) if size == 1 else guess_cost(block, ranks)[0]
                    found.append((best[i + times * size] + self.blocks[block] + math.log10(times), "repeat", i + times * size))
            if walk - i >= 4:
                found.append((best[walk] + walk_cost(walk - i), "walk", walk))
            if line - i >= 3:
                found.append((best[line] + sequence_cost(line - i), "sequence", line))
            for j in range(i + 3, min(n, i + ranks.longest) + 1):
                if low[i:j] in ranks or plain[i:j] in ranks:
                    found.append((best[j] + word_cost(value[i:j], ranks), "word", j))
            best[i], kind, j = min(found)
            on[i] = (kind, j)
        return best, on


def guess_cost(value: str, ranks: Ranks) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses of the cheapest segmentation, and its (kind, start, end).

    Walks, sequences and repeats that begin at a place end as far right as they
    go. A repeat is three or more of one character or whole blocks of up to BLOCK
    characters, twice or more, and costs its block and their number.
    """
    costs = Costs(value, ranks)
    return costs.of(), costs.spans()


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, kind's order, kind, ...) spans of the fixed patterns, in order."""
    out = [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda x: (x[0], order[x[2]]))


def guess_spans(text: str, ranks: Ranks, least: float) -> list[tuple[int, int, float]]:
    """Credential-context values whose guess cost is at least ``least``. A value that
    is or begins with a context name is scanned for a context of its own; such values
    end with the same run of characters and share its tables, so the time is in
    proportion to the text."""
    out, at, stop, costs, base = [], 0, -1, None, 0
    while m := CONTEXT.search(text, at):
        start = m.end()
        if start >= stop:
            stop = RUN.match(text, start).end()
            run = text[start:stop].rstrip(".)]}")
            costs, base = Costs(run, ranks), start
        if start <= base + len(costs.value) and (cost := costs.of(start - base)) >= least:
            out.append((start, base + len(costs.value), cost))
        at = start if NAMED.match(text, start) else stop
    return out


def scan(text: str | None, ranks: Ranks, least: float) -> tuple[list, list[tuple[int, int, float]]]:
    text = text or ""
    return base_spans(text), guess_spans(text, ranks, least)


def redact(text: str | None, ranks: Ranks, least: float) -> str | None:
    """The text with every secret value replaced; where spans overlap, by one mark."""
    if not text:
        return text
    base, guess = scan(text, ranks, least)
    spans = sorted([(e - len(v) if k == "assign" else s, e) for s, e, k, v in base] + [(s, e) for s, e, _ in guess])
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", least: float = 8.0) -> DataFrame:
    """One row per row of docs: its base spans by kind, guess spans with their
    cost, and the contract's digest columns.

    Offsets are code points, ends exclusive. A null or empty text has no spans.
    Rows repeat as in docs; ids may be null; other columns are not read. The
    scan is one pass over whole texts without a shuffle. ``least`` is the log10
    of guesses from which a credential-context value counts; ``vocab`` is the
    path of the vocabulary file that ranks words.
    """
    schema = "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, max_guess_log10 double"

    def run(cols: list[list]) -> list:
        ranks = word_ranks(vocab)
        out: list[list] = [[] for _ in range(8)]
        for i, text in zip(*cols, strict=True):
            base, guess = scan(text, ranks, least)
            kinds = [k for _, _, k, _ in base]
            named = [f"{k}:{s}:{e}" for s, e, k, _ in base]
            every = sorted([(s, ("assign", "access", "hex").index(k), f"{k}:{s}:{e}") for s, e, k, _ in base] + [(s, 3, f"guess:{s}:{e}") for s, e, _ in guess])
            row = (i, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(",".join(named).encode()).hexdigest(), ",".join(x for _, _, x in every), len(guess), max((c for _, _, c in guess), default=None))
            for c, v in zip(out, row, strict=True):
                c.append(v)
        return out

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, schema, run).withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, vocab: str, text_col: str = "text", least: float = 8.0) -> DataFrame:
    """docs with secrets replaced in text_col; all rows and columns stay.

    Null, empty and blank texts stay as they are, whole texts are read however
    long, rows that repeat are each replaced alike, and an empty table gives an
    empty result. One pass, no shuffle.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = word_ranks(vocab)
        for batch in batches:
            for b in by_bytes(batch):
                texts = pa.array([redact(t, ranks, least) for t in b.column(place).to_pylist()], type=b.schema.field(place).type)
                yield b.set_column(place, b.schema.field(place), texts)

    return docs.mapInArrow(run, docs.schema)
