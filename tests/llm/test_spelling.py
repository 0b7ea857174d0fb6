"""Spelling variants against plain Python."""

import itertools
import re
import string
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from folioforge.llm import spelling

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: {v for v in n if one_edit(w, v)} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    return sorted(tuple(r) for r in spelling.spelling_variants(df).collect())


@pytest.mark.parametrize("many", [64, 0])
def test_equals_plain_python(spark, monkeypatch, many):
    """Chains of forms, ties, anagrams, repeated letters, letters beyond a-z and lost
    letters; with every key crowded and with none."""
    monkeypatch.setattr(spelling, "MANY", many)
    words = {"colour": 40, "color": 9, "colours": 12, "kolour": 3, "colou": 4, "olourc": 3, "straße": 8, "strasse": 9, "Straße": 9, "aaaaa": 3, "aaaaaa": 6, "aaaaab": 6, "baaaaa": 6, "ÉCLAIR": 6, "éclair": 12, "abcde": 5, "bacde": 5, "abcdf": 5, "four": 50, "fours": 3, "twice": 2}
    text = " ".join(w for w, c in words.items() for _ in range(c))
    rows = [(1, text), (2, None), (3, ""), (4, "!!! 123"), (None, "colour-color_colours"), (5, "z" * 3_000 + " " + "z" * 2_999), (5, "z" * 3_000 + " " + "z" * 2_999), (6, "z" * 3_000 + " " + "z" * 2_999)]
    rows += [(100 + i, "theatre theater heatre colour") for i in range(300)]
    assert found(spark, rows) == brute(rows)


def test_crowded_anagrams(spark):
    """A thousand anagrams of each other, and their neighbours by one exchange: the
    pairs that meet are those that link, not all pairs of the class."""
    words = ["".join(p) for p in itertools.permutations("abcdefg")][:1000]
    words += [w[:3] + "x" + w[4:] for w in words[:200]]
    rows = [(i, " ".join(words)) for i in range(4)]
    assert found(spark, rows) == brute(rows)
    counts = spark.createDataFrame([(w,) for w in words], "word string").distinct()
    pairs = spelling.near_words(counts)
    want = defaultdict(set)
    for a, b in itertools.combinations(set(words), 2):
        if one_edit(a, b):
            want[a].add(b)
            want[b].add(a)
    assert pairs.count() == sum(map(len, want.values()))


def test_keys(spark):
    """Anagrams share a key, and a letter's value is what it adds."""
    df = spark.createDataFrame([("listen", "l"), ("silent", "l"), ("isten", "l"), ("é" * 300_000, "é")], "w string, c string")
    k = [tuple(r) for r in df.select(spelling.anagram_key(df.w), spelling.letter_value(df.c)).collect()]
    assert k[0][0] == k[1][0] and k[2][0] + k[2][1] == k[0][0] and k[3][0] == 300_000 * k[3][1] % spelling.PRIME


def test_odd_documents(spark, odd_docs, no_docs):
    assert spelling.spelling_variants(no_docs).count() == 0
    got = sorted(tuple(r) for r in spelling.spelling_variants(odd_docs).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])


def test_equals_oracle(spark):
    docs = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{docs}'")
    assert sorted(tuple(r) for r in spelling.spelling_variants(spark.read.parquet(docs)).collect()) == sorted(con.sql(spelling.ORACLE).fetchall())
