"""Full-text search over a table's columns and those of related tables.

A field is a column, or a path ``relation__column`` through one or more relations.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_title
from .fts import parse
from .postings import decide

SEPARATOR = "__"


@dataclass(frozen=True)
class Relation:
    """Related rows: ``links`` has two columns, the key of a row and the ``key`` of a
    row of ``table`` that belongs to it; either side may have many of the other."""

    table: DataFrame
    key: str
    links: DataFrame
    relations: dict[str, Relation] = field(default_factory=dict)


def search_related(df: DataFrame, key: str, fields: Sequence[str], query: str, relations: dict[str, Relation] | None = None, mode: str | None = None) -> DataFrame:
    """Rows of df that match a query (see fts.parse and fts.matches) in fields
    together: a word may be in any of them, a phrase in one value.

    Each table is scanned once; rows that hold none of the query's words or phrases
    leave there, and what is joined and grouped is a set of bits by key, so that a
    row with any number of related ones stays one number. Rows with a null key match
    nothing, rows of equal keys match together, links to missing rows are ignored.
    """
    leaves: list[tuple[tuple[str, ...], bool]] = []
    decision = decide(parse(query, mode), leaves)
    if not leaves:
        return df.limit(0)
    found = _hits(df, key, relations or {}, fields, leaves).where(decision).select(F.col("key").alias("__key"))
    return df.join(found, F.col(key) == F.col("__key"), "left_semi")


def _hits(df: DataFrame, key: str, relations: dict[str, Relation], fields: Sequence[str], leaves: list[tuple[tuple[str, ...], bool]]) -> DataFrame:
    """(key, bits): which words and phrases a row has, itself or by its related rows."""
    own = [f for f in fields if f in df.columns]
    paths: dict[str, list[str]] = {}
    for f in fields:
        step, _, rest = f.partition(SEPARATOR)
        if f not in own:
            if step not in relations or not rest:
                raise ValueError(f"no column and no path: {f}")
            paths.setdefault(step, []).append(rest)
    parts = []
    if own:
        bits = reduce(Column.bitwiseOR, [_bits(c, leaves) for c in own])
        parts.append(df.select(F.col(key).alias("key"), bits.alias("bits")).where("key is not null and bits <> 0"))
    for step, rest in paths.items():
        r = relations[step]
        inner = _hits(r.table, r.key, r.relations, rest, leaves).withColumnRenamed("key", "to")
        a, b = r.links.columns[:2]
        links = r.links.select(F.col(a).alias("key"), F.col(b).alias("to")).where("key is not null")
        parts.append(links.join(inner, "to").select("key", "bits"))
    return reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.bit_or("bits").alias("bits"))


def _bits(column: str, leaves: list[tuple[tuple[str, ...], bool]]) -> Column:
    text = F.concat(F.lit(" "), normalize_title(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(" "))
    one = lambda i, words, prefix: F.when(F.contains(text, F.lit(" " + " ".join(words) + ("" if prefix else " "))), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return reduce(Column.bitwiseOR, [one(i, w, p) for i, (w, p) in enumerate(leaves)])
