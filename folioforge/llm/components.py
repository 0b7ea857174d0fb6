"""Connected components of a graph that no single machine has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges(a, b); component is the smallest id.

    Each round, every node hooks to its smallest neighbour, pointers are
    doubled to the roots, and the graph is contracted to the roots that still
    have edges between them, so that rounds shrink at least by half. Hubs stay
    cheap: minima are combined before the shuffle, and the joins have one row
    per node on one side and plain tables on both, so that Spark may split a
    hot key. Every round is written to the shared folder. Null ends and loops
    are ignored; an empty input gives an empty result.
    """
    edges = materialize(_simple(edges), "edges")
    found: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("parent"))
        parent = _roots(materialize(parent, "parents"))
        if found is None:
            found = parent.select("id", F.col("parent").alias("component"))
        else:
            p = parent.select(F.col("id").alias("component"), "parent")
            found = found.join(p, "component", "left").select("id", F.coalesce("parent", "component").alias("component"))
        found = materialize(found, "components")
        pa, pb = (parent.select(F.col("id").alias(c), F.col("parent").alias(f"p{c}")) for c in "ab")
        edges = materialize(_simple(edges.join(pa, "a").join(pb, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "edges")
    if found is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found


def _simple(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _roots(parent: DataFrame) -> DataFrame:
    """Follow parents until each is a root, doubling the step every time."""
    while True:
        up = parent.select(F.col("id").alias("parent"), F.col("parent").alias("up"))
        if parent.where(F.col("id") != F.col("parent")).join(up, "parent").where(F.col("up") != F.col("parent")).isEmpty():
            return parent
        parent = materialize(parent.join(up, "parent").select("id", F.col("up").alias("parent")), "parents")


def smallest_ids(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cls, id, root): for each class of classes(cls, id) that edges(a, b) link
    with another, the smallest id and the smallest class it reaches. Classes are
    distinct, ids may be null or repeat."""
    found = connected_components(edges).select(F.col("id").alias("cls"), F.col("component").alias("root"))
    found = materialize(found.join(classes.select("cls", "id"), "cls"), "linked_classes")
    return found.select("cls", "root").join(found.groupBy("root").agg(F.min("id").alias("id")), "root").select("cls", "id", "root")
