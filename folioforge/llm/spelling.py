"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, so it does not depend
on their order, and a letter added, removed or exchanged moves it by known values.
Words meet where keys do after one letter is taken from the longer one, or one from
each of two as long: each word goes to its own key and to its key less each of its
letters. What meets is verified on the letters' order. Keys at which very many words
meet are joined by key and order of the remaining letters, so that no group's pairs
are all tried. All of it is DataFrame operations.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Keys are sums modulo a prime: equal sums stay equal, and no sum leaves a long.
POWER, PRIME = 5, (1 << 61) - 1
LETTERS = "([A-Za-zÀ-ÿ]+)"
#: Words (each once for every letter it may lose) at a key beyond which the letters' order is a part of it.
MANY = 64


def letter_value(letter: Column) -> Column:
    one = F.ascii(letter).cast("long")
    out = one
    for _ in range(POWER - 1):
        out = out * one
    return out


def anagram_key(word: Column) -> Column:
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda acc, c: (acc + letter_value(c)) % F.lit(PRIME))


def count_words(docs: DataFrame, id_col: str, text_col: str, every: int, shortest: int, least: int) -> DataFrame:
    """(word, n): the words of all texts; of every ``every``-th run of letters in a
    document, by its hash, one letter is lost."""
    lower = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(LETTERS), F.lit(1))).alias("run"))
    runs = runs.where(F.length("run") >= shortest).select("doc", lower.alias("run"))
    h, size = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")), F.length("run")
    at = (h % size).cast("int")
    lost = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, size))
    words = runs.select(F.when(h % every == 0, lost).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def near_words(words: DataFrame) -> DataFrame:
    """(word, other): both ways, for words that differ by exactly one inserted,
    deleted or replaced code point. words: (word), distinct, without empty ones."""
    keyed = words.select("word", anagram_key(F.col("word")).alias("key"))
    own = keyed.select("key", "word", F.lit("").alias("lost"))
    less = keyed.select("key", "word", F.explode(F.array_distinct(F.split("word", ""))).alias("lost"))
    less = less.select(F.pmod(F.col("key") - letter_value(F.col("lost")), F.lit(PRIME)).alias("key"), "word", "lost")
    probes = materialize(own.union(less), "probes")
    crowded = probes.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > MANY).select("key", F.lit(True).alias("crowded"))
    probes = probes.join(crowded, "key", "left")
    at = F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(F.col("word"), i, F.lit(1)) == F.col("lost"))
    rest = F.transform(at, lambda i: F.xxhash64(F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.substring(F.col("word"), i + 1, F.length("word")))))
    order = F.when(F.col("crowded").isNull(), F.array(F.lit(0).cast("long"))).when(F.col("lost") == "", F.array(F.xxhash64("word"))).otherwise(F.array_distinct(rest))
    probes = materialize(probes.select("key", "word", "lost", F.explode(order).alias("order")), "probes")
    a, b = (probes.select("key", "order", F.col("word").alias(x), F.col("lost").alias(f"lost_{x}")) for x in "ab")
    met = (F.col("lost_a") == "") & (F.col("lost_b") != "") | (F.col("lost_a") != "") & (F.col("lost_b") != "") & (F.col("lost_a") != F.col("lost_b")) & (F.col("a") < F.col("b"))
    pairs = a.join(b, ["key", "order"]).where(met & (F.levenshtein("a", "b", 1) == 1)).select("a", "b")
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"))))
    return pairs.select(both.alias("p")).select("p.*").repartition("word").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) by doubling the step along forms(word, form): a form is at least
    twice as frequent as its word, so rounds are few."""
    step = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = step.select(F.col("word").alias("root"), F.col("root").alias("up"))
        further = materialize(step.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        step = further.select("word", "root")
        if further.where("moved").isEmpty():
            return step


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, shortest: int = 5, least: int = 3, ratio: int = 2) -> DataFrame:
    """One row per word: (word, form, root, n, n_near, form_n).

    Words are maximal runs of Latin-1 letters, A-Z in lower case, of at least
    ``shortest`` code points and ``least`` occurrences n over all documents. A run
    whose crc32 of "<id>:<run>" is divisible by ``every`` loses the code point at
    crc32 modulo its length; a null id counts as the empty string. form is the near
    word (one code point inserted, deleted or replaced) of largest n, of equal ones
    the first in code-point order, if it has ``ratio`` times the word's n, else
    null; root is where forms lead. Null and empty texts have no word; an empty
    table gives an empty result; repeated rows count again; other columns are not
    read. A word at a crowded key takes time with the square of its length.
    """
    words = materialize(count_words(docs, id_col, text_col, every, shortest, least), "words")
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("m"))
    best = F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best")
    near = near_words(words.select("word")).join(counts, "other").groupBy("word").agg(F.count("*").alias("n_near"), best)
    enough = -F.col("best.m") >= F.lit(ratio) * F.col("n")
    found = words.join(near, "word", "left").select("word", F.when(enough, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, -F.col("best.m")).alias("form_n"))
    found = materialize(found, "forms")
    return found.join(roots(found.where(F.col("form").isNotNull())), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _oracle() -> str:
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
raw AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{upper}', '{lower}') AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS times FROM raw WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM runs, crc_table),
spelt AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cut AS (SELECT word, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM words)),
pairs AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT cut.word, words.word FROM cut JOIN words ON cut.rest = words.word
  UNION SELECT words.word, cut.word FROM cut JOIN words ON cut.rest = words.word),
near AS (
  SELECT pairs.word, count(*) AS n_near, max(m.n) AS top FROM pairs JOIN words m ON m.word = other GROUP BY pairs.word),
best AS (
  SELECT near.word, near.n_near, near.top, min(other) AS other FROM near JOIN pairs ON pairs.word = near.word JOIN words m ON m.word = other AND m.n = near.top GROUP BY ALL),
forms AS (
  SELECT words.word, CASE WHEN top >= 2 * words.n THEN other END AS form, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 2 * words.n THEN top END AS form_n
  FROM words LEFT JOIN best USING (word)),
walk AS (
  SELECT word, form, word AS root, form AS next FROM forms
  UNION ALL SELECT w.word, w.form, f.word, f.form FROM walk w JOIN forms f ON f.word = w.next)
SELECT word, form, root, forms.n, forms.n_near, forms.form_n FROM walk JOIN forms USING (word, form) WHERE next IS NULL
UNION ALL SELECT word, form, word, n, n_near, form_n FROM forms WHERE form IS NULL
"""


ORACLE = _oracle()
