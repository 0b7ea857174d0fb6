"""Deletes, changed records, two writers, late order, running indexes."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.operators import difftree, upsert
from folioforge.plans import ingest
from folioforge.schemas import CANONICAL
from tests.test_plans import record


def plain(store, name):
    return sorted(map(str, store[name].drop("seq").collect()))


def test_deleted_and_changed_records(spark, tmp_path):
    """A deleted record leaves the trees and its own entities, on disk too, and can
    come back; a changed one gives the store of its new state."""
    path = str(tmp_path / "store")
    make = lambda *rows: spark.createDataFrame(list(rows), CANONICAL)
    first, old, new = record("a/1", "Deep Graph Matching", ["Ann Smithson"]), record("b/1", "Deep Graph Matching", ["Ann Smithson", "Bob Hallberg"], 1999), record("b/1", "Other Words Entirely", ["Cyd Norbury"], 2005)
    store, _ = ingest.ingest(ingest.Store.load(spark, path), make(first), "A")
    scratch = store
    store, _ = ingest.ingest(store, make(old), "B")
    store = store.save(path)
    gone = store.forget(store["source_records"].where("local_url = 'b/1'"))
    assert {len(t["url_ids"]) for t in ingest.trees(gone).collect()} == {1} and gone["authors"].count() == 1
    gone = gone.save(path)
    for name in ("source_records", "clusters", "publications", "authors", "author_edges", "author_aliases", "values"):
        assert plain(gone, name) == plain(scratch, name), name
    changed, counts = ingest.change(store, make(new), "B")
    assert {r["outcome"]: r["n"] for r in counts.collect()} == {"added": 1}
    want, _ = ingest.ingest(scratch, make(new), "B")
    for name in ("source_records", "clusters", "publications", "authors", "author_edges", "author_aliases", "values"):
        assert plain(changed, name) == plain(want, name), name
    with pytest.raises(ValueError, match="another writer"):
        changed.save(path)  # its store is older than the deletion that was saved meanwhile
    again = ingest.change(ingest.Store.load(spark, path), make(new), "B")[0].save(path)
    assert plain(again, "values") == plain(want, "values") and plain(again, "authors") == plain(want, "authors")


def test_retraction_keeps_order_and_votes(spark):
    rows = spark.createDataFrame([(1, "u1", 1, "a"), (1, "u2", 2, "b"), (1, "u3", 3, "a"), (2, "u1", 1, "x")], "pub long, url string, seq long, title string")
    t = difftree.apply_votes(difftree.merge(rows, "pub", "url", "seq", ["title"]), spark.createDataFrame([(1, "title", "b", 2)], "pub long, attr string, value string, votes int"))
    gone = lambda *x: spark.createDataFrame(list(x), "pub long, url_id string")
    show = lambda df: {r["pub"]: (r["url_ids"], [tuple(n) for n in r["attrs"]["title"]]) for r in df.collect()}
    assert show(t)[1] == (["u1", "u2", "u3"], [("b", 2, 2), ("a", 0, 5)])
    assert show(difftree.retract(t, gone((1, "u1"), (1, "u1"), (9, "u1"), (1, "nosuch")))) == {1: (["u2", "u3"], [("b", 2, 1), ("a", 0, 2)]), 2: (["u1"], [("x", 0, 1)])}
    assert show(difftree.retract(t, gone((1, "u2"), (2, "u1")))) == {1: (["u1", "u3"], [("a", 0, 3)])}
    assert show(difftree.retract(t, gone())) == show(t)


def test_insert_comes_after_whatever_its_seq(spark):
    rows = spark.createDataFrame([(1, "u1", -5, "first"), (1, "u2", -2_000_000, "second")], "pub long, url string, seq long, title string")
    t = difftree.insert(difftree.merge(rows.where("url = 'u1'"), "pub", "url", "seq", ["title"]), rows.where("url = 'u2'"), "pub", "url", "seq", ["title"])
    got = t.collect()[0]
    assert got["url_ids"] == ["u1", "u2"] and [n["value"] for n in got["attrs"]["title"]] == ["first", "second"]


def test_running_index_without_a_window_over_the_partition(spark):
    """A hot, a small and a null partition, with ties."""
    rows = spark.range(5000).select((F.when(F.col("id") % 50 == 0, "b").when(F.col("id") % 51 != 0, "a")).alias("p"), (F.col("id") * 7 % 1000).alias("t"), "id")
    got = upsert.running_index(rows, ["p"], [F.col("t")], 100)
    n = F.row_number().over(W.partitionBy("p").orderBy("t", F.xxhash64("p", "t", "id")))
    want = rows.withColumn("bucket", F.floor((n - 1) / 100) * 100)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
