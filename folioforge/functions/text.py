"""Normalisation of titles, names and identifiers as native column expressions."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROLS = "\t\n\r\x0b\x0c"
#: Letters that fold to more than one character.
LONG_FOLDS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ĳ": "ij", "Ĳ": "IJ"}
#: Letters without a decomposition.
SHORT_FOLDS = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i"}
#: Latin spellings of small Greek and Cyrillic letters; a capital's begins with a capital.
GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n",
    "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "ς": "s", "σ": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "io", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t",
    "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia", "є": "ie", "і": "i", "ї": "yi", "ґ": "g",
}
#: Names too common to say much alone. The third entry is two
#: names written as one; results depend on it.
AMBIGUOUS_NAMES = [
    "chen", "christopherdaniel", "david", "dex", "garcia", "hassan", "james", "jean", "john", "jose", "han", "huang",
    "kim", "lee", "lin", "liu", "martin", "michael", "paul", "peter", "richard", "robert", "schmidt", "stephen",
    "thomas", "van", "william", "xux", "yang", "yux", "wang", "wong", "wei", "wux", "zhang",
]
#: Words that say nothing about a title.
STOP_WORDS = (
    "a about above after again all am an and any are as at be because been before being below between both but by can did do does doing down during each few for "
    "from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our "
    "out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what "
    "when where which while who whom why will with you your"
).split()


def fold_pairs() -> tuple[str, str]:
    """Latin letters with marks, and the ASCII letters they fold to."""
    source, target = "".join(SHORT_FOLDS), "".join(SHORT_FOLDS.values())
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if chr(code) not in SHORT_FOLDS and chr(code) not in LONG_FOLDS and base != chr(code) and base.isascii() and base.isalpha():
            source, target = source + chr(code), target + base
    return source, target


def other_scripts() -> dict[str, str]:
    """Greek and Cyrillic letters, with and without marks, in Latin letters."""
    known = GREEK | CYRILLIC
    known |= {k.upper(): v.capitalize() for k, v in known.items()}
    for code in range(0x370, 0x460):
        if chr(code) not in known and (base := unicodedata.normalize("NFKD", chr(code))[0]) in known:
            known[chr(code)] = known[base]
    return known


def _by_length_of_fold(folds: dict[str, str]) -> tuple[str, str, dict[str, str]]:
    """Letters of one character and theirs, in the form of translate (which drops
    what has none), and the folds to several characters."""
    short = {k: v for k, v in folds.items() if len(v) < 2}
    order = sorted(short, key=lambda k: not short[k])
    return "".join(order), "".join(short[k] for k in order), {k: v for k, v in folds.items() if len(v) > 1}


def fold_ascii(c: Column | str) -> Column:
    """Latin, Greek and Cyrillic letters to their closest ASCII letters; other
    characters stay. Texts without such letters are only looked through once."""
    c = F.col(c) if isinstance(c, str) else c
    source, target, several = _by_length_of_fold(other_scripts())
    other = latin = F.translate(_replaced(c, LONG_FOLDS), *fold_pairs())
    other = F.translate(_replaced(other, several), source, target)
    return F.when(c.rlike("[\\u0370-\\u045F]"), other).when(c.rlike("[^\\x00-\\x7F]"), latin).otherwise(c)


def _replaced(c: Column, folds: dict[str, str]) -> Column:
    for k, v in folds.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def title_words(text: str) -> list[str]:
    """The words of a text as normalize_title has them, for queries on the driver."""
    folds = {ord(k): v for k, v in {**LONG_FOLDS, **dict(zip(*fold_pairs(), strict=True)), **other_scripts()}.items()}
    gone = dict.fromkeys(map(ord, string.punctuation + CONTROLS))
    return [w for w in text.replace("-", " ").translate(folds).translate(gone).lower().split(" ") if w]


def _squeezed(c: Column) -> Column:
    """Without ASCII punctuation and control white space, in lower case, with
    single spaces inside and none around."""
    bare = F.lower(F.translate(fold_ascii(c), string.punctuation + CONTROLS, ""))
    return F.trim(F.regexp_replace(bare, " +", " "))


def normalize_title(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return _squeezed(F.translate(c, "-", " "))


def normalize_author(c: Column | str) -> Column:
    """As a title, with dots as spaces and an x after each word of two letters,
    so that such names stay long enough for a token index."""
    c = F.col(c) if isinstance(c, str) else c
    words = F.split(_squeezed(F.translate(c, "-.", "  ")), " ")
    return F.array_join(F.transform(words, lambda w: F.when(F.length(w) == 2, F.concat(w, F.lit("x"))).otherwise(w)), " ")


def split_authors(c: Column | str) -> Column:
    """Entries of an ``a;b;`` list; what follows the last semicolon is dropped."""
    parts = F.split(c, ";")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def join_list(c: Column | str) -> Column:
    """The ``a;b;`` form of an array, nulls left out; null for an empty one."""
    some = F.array_compact(c)
    return F.when(F.size(some) > 0, F.concat(F.array_join(some, ";"), F.lit(";")))


def _by_length(words: Column, descending: bool) -> Column:
    """Words by length; of equal ones the later first if descending, else last."""
    keyed = F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), i.alias("i"), w.alias("w")))
    ordered = F.array_sort(keyed)
    return F.transform(F.reverse(ordered) if descending else ordered, lambda x: x["w"])


def relevant_words(c: Column | str, most: int = 3) -> Column:
    """The longest words that are no stop words; of equal length the later first."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    words = F.filter(F.split(c, " "), lambda w: ~F.array_contains(stop, w))
    return F.slice(_by_length(words, True), 1, most)


def search_query(c: Column | str) -> Column:
    """The relevant words; the whole title if all of them have under 4 letters."""
    c = F.col(c) if isinstance(c, str) else c
    words = relevant_words(c)
    return F.when(F.forall(words, lambda w: F.length(w) < 4), c).otherwise(F.array_join(words, " "))


def author_words(c: Column | str) -> Column:
    """Name words of more than one letter, shortest first."""
    return _by_length(F.filter(F.split(c, " "), lambda w: F.length(w) > 1), False)


def author_tokens(c: Column | str, most: int = 3) -> Column:
    """Words a matching name must have: the longest first until ``most`` of them
    are unambiguous; ambiguous ones among them count as extra."""
    known = F.array(*map(F.lit, AMBIGUOUS_NAMES))
    words = F.reverse(author_words(c))
    clear = F.transform(words, lambda w: F.when(F.array_contains(known, w), 0).otherwise(1))
    before = F.transform(words, lambda w, i: F.aggregate(F.slice(clear, F.lit(1), i), F.lit(0), lambda s, v: s + v))
    kept = F.filter(F.arrays_zip(words.alias("w"), before.alias("b")), lambda x: x["b"] < most)
    return F.transform(kept, lambda x: x["w"])


def author_query(c: Column | str) -> Column:
    return F.array_join(F.transform(author_tokens(c), lambda w: F.concat(F.lit("+"), w)), " ")


def parse_pages(c: Column | str, sep: str = "-") -> Column:
    """(first, last) of a page range; both null for more than two parts."""
    parts = F.split(c, sep)
    n = F.size(parts)
    return F.struct(F.when(n <= 2, parts[0]).alias("first"), F.when(n == 1, parts[0]).when(n == 2, F.get(parts, F.lit(1))).alias("last"))


def title_similarity(a: Column | str, b: Column | str) -> Column:
    """Whole per cent of the longer title that the edit distance leaves."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 100).otherwise(F.floor((1 - F.levenshtein(a, b) / longer) * 100)).cast("int")


def near_length(a: Column | str, b: Column | str, percent: int) -> Column:
    """Whether lengths alone still allow a similarity of ``percent``."""
    return 100 * F.abs(F.length(a) - F.length(b)) <= (100 - percent) * F.greatest(F.length(a), F.length(b))


def strip_years(c: Column | str) -> Column:
    """A name without the four-digit numbers that tell namesakes apart."""
    return F.trim(F.regexp_replace(c, r"\d{4}", ""))


def dotted(c: Column | str) -> Column:
    """An initial with its dot."""
    return F.when(F.length(c) == 1, F.concat(c, F.lit("."))).otherwise(c)


def person_name(first: Column | str, middle: Column | str, last: Column | str) -> Column:
    """``first middle last`` with dotted initials; missing parts leave one space."""
    part = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return F.replace(F.concat(dotted(part(first)), F.lit(" "), dotted(part(middle)), F.lit(" "), part(last)), F.lit("  "), F.lit(" "))


def file_name(url: Column | str) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def without_tags(c: Column | str) -> Column:
    """Mixed XML content as plain text: no tags, no line feeds, common entities resolved."""
    c = F.translate(F.regexp_replace(c, "<[^>]+>", ""), "\n", "")
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(value))
    return c


def local_tag(c: Column | str) -> Column:
    """A tag without its namespace."""
    return F.regexp_replace(c, r"^\{[^}]*\}", "")
