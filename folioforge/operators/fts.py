"""Full-text search over a token index."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_title, title_words
from ..storage import written

OPERATORS = set('+-><()*"')


def token_index(df: DataFrame, key: str, text: Column | str) -> DataFrame:
    """(token, key): each distinct word of a normalised text once."""
    words = F.array_distinct(F.filter(F.split(normalize_title(text), " "), lambda w: w != ""))
    return df.select(key, F.explode(words).alias("token"))


def mode_of(query: str) -> str:
    """boolean if the query has an operator character, else natural."""
    return "boolean" if OPERATORS & set(query) else "natural"


@dataclass(frozen=True)
class Term:
    """A part of a query: sign is +, - or empty; kind is word, prefix, phrase or
    group. A prefix's last word may go on."""

    sign: str
    kind: str
    words: tuple[str, ...] = ()
    terms: tuple[Term, ...] = ()


def parse(query: str, mode: str | None = None) -> list[Term]:
    """The terms of a query.

    Boolean: + and - at a word's start say that it must or must not be there; "a
    phrase", a prefix*, and (groups) take signs like words, and a word that
    normalises to several, as one with a hyphen, is a phrase. The signs of weight,
    < > and ~, are read and change no match. Natural: every word by itself.
    """
    mode = mode or mode_of(query)
    if mode != "boolean":
        return [Term("", "word", (w,)) for w in title_words(query)]
    return _terms(query, 0)[0]


def _terms(query: str, at: int) -> tuple[list[Term], int]:
    """Terms from a place to the end of its group, and the place after it."""
    out: list[Term] = []
    while at < len(query):
        c, sign = query[at], ""
        if c == ")":
            return out, at + 1
        if c.isspace():
            at += 1
            continue
        while at < len(query) and query[at] in "+-<>~":
            sign = query[at] if query[at] in "+-" else sign
            at += 1
        if at == len(query) or query[at].isspace() or query[at] == ")":
            continue
        if query[at] == "(":
            inner, at = _terms(query, at + 1)
            if inner:
                out.append(Term(sign, "group", (), tuple(inner)))
            continue
        if query[at] == '"':
            end = query.find('"', at + 1)
            end = len(query) if end < 0 else end
            words, kind, at = title_words(query[at + 1 : end]), "phrase", end + 1
        else:
            m = re.compile(r'[^\s()"]*').match(query, at)
            part, at = m[0], m.end()
            words, kind = title_words(part), "prefix" if part.endswith("*") else "word"
        if words:
            out.append(Term(sign, "phrase" if kind == "word" and len(words) > 1 else kind, tuple(words)))
    return out, at


def matches(text: Column, terms: list[Term] | tuple[Term, ...]) -> Column:
    """Whether a normalised text between blanks matches: all must-terms, no
    must-not-term, and without must-terms one of the others. Only must-nots match
    nothing."""
    any_of, all_of = F.lit(False), F.lit(True)
    for t in terms:
        if t.kind == "group":
            own = matches(text, t.terms)
        else:
            own = F.contains(text, F.lit(" " + " ".join(t.words) + ("" if t.kind == "prefix" else " ")))
        if t.sign == "+":
            all_of = all_of & own
        elif t.sign == "-":
            all_of = all_of & ~own
        else:
            any_of = any_of | own
    return all_of if any(t.sign == "+" for t in terms) else all_of & any_of


def _searched(columns: list[str]) -> Column:
    return F.concat(F.lit(" "), normalize_title(F.concat_ws(" ", *columns)), F.lit(" "))


def search(df: DataFrame, columns: list[str], query: str, mode: str | None = None) -> DataFrame:
    """Rows of df whose columns together match a query (see parse and matches): a
    scan with native predicates."""
    return df.where(matches(_searched(columns), parse(query, mode)))


def search_many(df: DataFrame, columns: list[str], queries: list[str], mode: str | None = None) -> DataFrame:
    """(query, columns of df): the rows that match each of a few queries, in one scan."""
    text = F.col("__text")
    hit = F.array(*[F.when(matches(text, parse(q, mode)), F.lit(q)) for q in queries])
    found = df.withColumn("__text", _searched(columns)).withColumn("query", F.explode(F.array_compact(hit)))
    return found.select("query", *df.columns)


def contains_phrase(text: Column | str, phrase: Column | str) -> Column:
    """Whether a normalised text holds a normalised phrase as whole words."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return F.contains(pad(F.col(text) if isinstance(text, str) else text), pad(F.col(phrase) if isinstance(phrase, str) else phrase))


def token_weights(index: DataFrame, key: str) -> DataFrame:
    """(token, df): in how many keys each token is."""
    return index.groupBy("token").agg(F.count(key).alias("df"))


#: Share of the keys from which a token counts as common.
COMMON = 0.01


def best_matches(queries: DataFrame, qkey: str, qtokens: str, index: DataFrame, key: str, total: int, limit: int | None = 5, weights: DataFrame | None = None) -> DataFrame:
    """(qkey, key, score, rank): index entries that share a token with a query,
    by the sum of log(1 + total / df) of the shared tokens; ties by key. limit
    None keeps all, without ranks. weights(token, df) are counted where not given.

    Common tokens meet most entries and say little. So entries are first scored by
    a query's other tokens. Where the ``limit``-th of them scores more than all
    common tokens together, no entry without one can be among the best; then
    common tokens are only looked up for entries that can still reach it. Other
    queries are joined with all their tokens.
    """
    index = written(index.select("token", key), "index")
    weights = (token_weights(index, key) if weights is None else weights).withColumn("w", F.log(1 + F.lit(total) / F.col("df")))
    asked = queries.select(qkey, F.explode(F.array_distinct(qtokens)).alias("token")).join(weights, "token")
    if limit is None:
        return asked.join(index, "token").groupBy(qkey, key).agg(F.round(F.sum("w"), 6).alias("score"))
    common = F.col("df") > max(limit, COMMON * total)
    asked = written(asked.select(qkey, "token", "w", common.alias("common")), "asked")
    rare = written(asked.where("not common").join(index, "token").groupBy(qkey, key).agg(F.sum("w").alias("part")), "part_scores")
    order = W.partitionBy(qkey).orderBy(F.desc("part"))
    least = rare.withColumn("r", F.row_number().over(order)).where(F.col("r") == limit).select(qkey, F.col("part").alias("least"))
    rest = asked.groupBy(qkey).agg(F.coalesce(F.sum(F.when(F.col("common"), F.col("w"))), F.lit(0.0)).alias("rest"))
    # A whole unit of rounding apart, so that no tie is decided here.
    closed = written(rest.join(least, qkey).where(F.col("least") > F.col("rest") + 1e-5), "closed")
    able = rare.join(closed, qkey).where(F.col("part") + F.col("rest") + 1e-5 >= F.col("least")).select(qkey, key, "part")
    tokens = asked.where("common").join(closed.select(qkey), qkey, "left_semi").select(qkey, "token", "w")
    more = able.select(qkey, key).join(tokens, qkey).join(index, ["token", key], "left_semi").groupBy(qkey, key).agg(F.sum("w").alias("more"))
    able = able.join(more, [qkey, key], "left").select(qkey, key, F.round(F.col("part") + F.coalesce("more", F.lit(0.0)), 6).alias("score"))
    open_ = asked.join(closed.select(qkey), qkey, "left_anti").join(index, "token").groupBy(qkey, key).agg(F.round(F.sum("w"), 6).alias("score"))
    order = W.partitionBy(qkey).orderBy(F.desc("score"), F.asc(key))
    return able.unionByName(open_).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def rarest_token_match(queries: DataFrame, qkey: str, qtokens: str, rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """(qkey, need, key): rows whose token array holds the rarest of a query's
    tokens, need. Only tokens that a query has are counted and joined."""
    asked = queries.select(qkey, F.array_distinct(qtokens).alias("need")).where(F.size("need") > 0)
    each = asked.select(qkey, "need", F.explode("need").alias("token"))
    index = rows.select(key, F.explode(F.array_distinct(tokens)).alias("token")).join(each.select("token").distinct(), "token", "left_semi")
    index = written(index, "asked_index")
    rare = each.join(token_weights(index, key), "token", "left").groupBy(qkey)
    rare = rare.agg(F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), "token")).alias("token"), F.first("need").alias("need"))
    return rare.join(index, "token").select(qkey, "need", key)


def all_tokens_match(queries: DataFrame, qkey: str, qtokens: str, rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """(qkey, key): rows whose token array holds every token of the query. The
    join runs on the query's rarest token only; the rest is a filter."""
    found = rarest_token_match(queries, qkey, qtokens, rows, key, tokens).join(rows.select(key, F.col(tokens).alias("has")), key)
    return found.where(F.forall("need", lambda t: F.array_contains(F.col("has"), t))).select(qkey, key)
