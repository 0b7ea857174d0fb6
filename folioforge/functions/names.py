"""Person names: blocks, order, and similarity by one-pass word alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .phonetic import double_metaphone
from .text import AMBIGUOUS_NAMES, normalize_title

#: Words of a surname that stand before its main word, and suffixes.
PARTICLES = ["da", "de", "del", "della", "den", "der", "di", "dos", "du", "el", "la", "le", "st", "te", "ten", "ter", "van", "vel", "von", "zu"]
SUFFIXES = ["jr", "jnr", "sr", "snr", "ii", "iii", "iv", "phd", "md", "esq"]


def _among(word: Column, words: list[str]) -> Column:
    return F.array_contains(F.array(*map(F.lit, words)), word)


def _simple(word: Column) -> Column:
    return F.lower(F.translate(word, ".,", ""))


def name_block(c: Column | str) -> Column:
    """``last,f``: the normalised surname with its particles and the first
    letter of the first name; ``last,`` for a single word. Suffixes and
    ``Last, First`` order are understood."""
    c = F.col(c) if isinstance(c, str) else c
    clean = F.trim(F.regexp_replace(c, " +", " "))
    words = F.filter(F.split(F.regexp_replace(F.split(clean, ",")[0], " +", " "), " "), lambda w: ~_among(_simple(w), SUFFIXES) & (w != ""))
    after = F.trim(F.get(F.split(clean, ","), F.lit(1)))
    comma = after.isNotNull() & (after != "") & ~_among(_simple(after), SUFFIXES)
    n = F.size(words)
    # The surname begins at the earliest of the particles that run up to the last word.
    start = F.aggregate(F.sequence(n - 1, F.lit(1), F.lit(-1)), n, lambda s, i: F.when((s == i + 1) & ((i == n - 1) | _among(_simple(F.get(words, i)), PARTICLES)), i).otherwise(s))
    last = F.when(comma, F.array_join(words, " ")).otherwise(F.array_join(F.slice(words, start + 1, n), " "))
    first = F.when(comma, F.split(after, " ")[0]).otherwise(F.get(words, F.lit(0)))
    block = F.concat(normalize_title(last), F.lit(","), F.substring(normalize_title(first), 1, 1))
    return F.when(F.size(F.split(c, " ")) == 1, F.concat(normalize_title(c), F.lit(","))).when((n < 2) & ~F.coalesce(comma, F.lit(False)), F.concat(normalize_title(F.array_join(words, " ")), F.lit(","))).otherwise(block)


def name_score(words: Column) -> Column:
    """How telling a name is: longer and unambiguous words score more."""
    worth = lambda w: F.when((F.length(w) == 1) | _among(w, AMBIGUOUS_NAMES), 0).when(F.length(w) <= 5, 1).when(F.length(w) <= 8, 2).otherwise(3)
    return F.aggregate(words, F.lit(-1), lambda s, w: s + worth(w))


def is_western(words: Column) -> Column:
    """Whether the last word is the surname: any initial says so; else a last
    word of over 3 letters and a mean length of 4 or more."""
    total = F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w))
    return F.exists(words, lambda w: F.length(w) == 1) | ((F.length(F.element_at(words, -1)) > 3) & (F.floor(total / F.size(words)) >= 4))


def rotate(words: Column, by: int) -> Column:
    """Words moved by ``by`` places: 1 puts the first last, -1 the last first."""
    n = F.size(words)
    k = F.pmod(F.lit(by), F.greatest(n, F.lit(1)))
    return F.concat(F.slice(words, k + 1, n), F.slice(words, F.lit(1), k))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once; lambdas share no subexpressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def aligned(a: Column, b: Column, most_extra: Column | int = 1, abbreviations: Column | bool = True) -> Column:
    """Whether two word lists align in one pass.

    Each word of a takes the next free word of b that it equals or, if allowed,
    abbreviates or is abbreviated by; a word that finds none uses up all that
    is left of b. Lists do not align if both have unmatched words, one has more
    than ``most_extra``, abbreviations go both ways, or there are extra words
    and abbreviations. The relation is not symmetric.
    """
    short = F.lit(abbreviations) if isinstance(abbreviations, bool) else abbreviations
    most = F.lit(most_extra) if isinstance(most_extra, int) else most_extra
    n = F.size(b)
    zero = F.struct(F.lit(0).alias("next"), F.lit(0).alias("hits"), F.lit(0).alias("shortens"), F.lit(0).alias("lengthens"))

    def take(s: Column, x: Column) -> Column:
        fits = lambda y: (x == y) | (short & (((F.length(x) == 1) & F.startswith(y, x)) | ((F.length(y) == 1) & F.startswith(x, y))))
        free = F.when(s["next"] < n, F.sequence(s["next"], n - 1)).otherwise(F.array().cast("array<int>"))
        at = F.get(F.filter(free, lambda i: fits(F.get(b, i))), F.lit(0))
        return _let(at, lambda i: _let(F.get(b, i), lambda y: step(s, x, i, y)))

    def step(s: Column, x: Column, at: Column, y: Column) -> Column:
        hit = at.isNotNull()
        differs = F.coalesce(x != y, F.lit(False))
        shortens = differs & (F.length(x) == 1)
        return F.struct(
            F.coalesce(at + 1, n).alias("next"),
            (s["hits"] + hit.cast("int")).alias("hits"),
            (s["shortens"] + shortens.cast("int")).alias("shortens"),
            (s["lengthens"] + (differs & ~shortens).cast("int")).alias("lengthens"),
        )

    def verdict(s: Column) -> Column:
        left_a, left_b = F.size(a) - s["hits"], n - s["hits"]
        shortened = (s["shortens"] > 0) | (s["lengthens"] > 0)
        return ~((s["shortens"] > 0) & (s["lengthens"] > 0)) & ~((left_a > 0) & (left_b > 0)) & (F.greatest(left_a, left_b) <= most) & ~((F.greatest(left_a, left_b) > 0) & shortened)

    return F.aggregate(a, zero, take, verdict)


def same_author(a: Column | str, b: Column | str) -> Column:
    """Whether two normalised names can be one person's."""
    x, y = F.split(a, " "), F.split(b, " ")
    xs, ys = rotate(x, -1), rotate(y, -1)  # surname first
    common = _among(F.element_at(x, -1), AMBIGUOUS_NAMES)
    first_x, first_y = F.get(xs, F.lit(1)), F.get(ys, F.lit(1))
    western = (
        (F.element_at(x, -1) == F.element_at(y, -1))
        & (F.size(x) >= 2)
        & (F.size(y) >= 2)
        & (F.startswith(first_x, first_y) | F.startswith(first_y, first_x))
        & aligned(xs, ys, F.when(common, 0).otherwise(1), ~common)
    )
    asian = F.lit(False)
    for turned in (x, rotate(x, -1), rotate(x, 1)):
        asian = asian | aligned(turned, y) | aligned(y, turned)
    return (F.lit(True) & (F.col(a) if isinstance(a, str) else a).eqNullSafe(F.col(b) if isinstance(b, str) else b)) | F.coalesce(F.when(is_western(x), western).otherwise(asian), F.lit(False))


def same_author_scored(a: Column | str, b: Column | str) -> Column:
    """An older rule: how much may differ depends on how telling the name is."""
    x, y = F.split(a, " "), F.split(b, " ")
    score = name_score(x)
    most, short = F.floor(score / 2).cast("int"), score >= 2
    found = F.lit(False)
    for turned in (x, rotate(x, 1), rotate(x, -1)):
        found = found | aligned(turned, y, most, short) | aligned(y, turned, most, short)
    last = F.element_at(x, -1)
    return F.when((F.length(last) > 5) & ~F.array_contains(y, last), False).otherwise(found)


@F.pandas_udf(StringType())
def metaphone_name(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Primary phonetic keys of a name's words, joined by spaces; made once for each
    distinct word of a batch. No native expression exists; soundex is the nearest
    and coarser."""
    for s in names:
        words = s.str.split(" ")
        known = {w: double_metaphone(w)[0] for w in set(words.dropna().explode().dropna())}
        yield words.map(lambda x, known=known: " ".join(map(known.__getitem__, x)) if isinstance(x, list) else None)
