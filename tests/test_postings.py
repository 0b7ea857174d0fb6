"""The maintained index against scans."""

import pyarrow as pa
import pytest

from folioforge.operators import fts, postings
from folioforge.operators.postings import PostingIndex
from folioforge.storage import claim

ROWS = [(1, "Graph matching, deep graph matching"), (2, "Matching the graph"), (3, None), (4, ""), (5, "Deep-graph networks"), (6, "the the the"), (7, "Größe der Netze")]
QUERIES = ["graph", '"deep graph"', "+matching -deep", "net*", '"graph match"', "+(deep netze) -networks", '"the the"', '"the the the the"', "-graph", "deep-graph*", "g*", "+groesse", "", '+"matching deep" +graph']


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    made = PostingIndex(spark, str(tmp_path_factory.mktemp("index") / "i"))
    df = spark.createDataFrame(ROWS, "id long, title string")
    for part in (df.where("id <= 2"), df.where("id in (3, 4)"), df.where("id > 4")):
        made.append(part, "id", "title")
    return made, df


def test_searches_equal_scans(index):
    made, df = index
    for q in QUERIES:
        assert sorted(r["key"] for r in made.search(q).collect()) == sorted(r["id"] for r in fts.search(df, ["title"], q).collect()), q


def test_counts_and_positions(index):
    made, df = index
    want = {r["token"]: r["df"] for r in fts.token_weights(fts.token_index(df, "id", "title"), "id").collect()}
    assert {r["token"]: r["df"] for r in made.document_frequencies().collect()} == want and made.texts() == 7
    assert {r["token"]: r["df"] for r in made.document_frequencies(["graph", "nosuch"]).collect()} == {"graph": 3}
    assert {r["key"]: r["positions"] for r in made.postings(["graph"]).collect()} == {1: [0, 3], 2: [2], 5: [1]}


def test_best_matches(spark, index):
    made, df = index
    asked = spark.createDataFrame([(1, ["deep", "graph"]), (2, ["the"]), (3, ["nosuch"])], "q int, words array<string>")
    whole = fts.best_matches(asked, "q", "words", fts.token_index(df, "id", "title"), "id", 7)
    got = made.best(asked, "q", "words")
    assert sorted((r["q"], r["key"], r["score"], r["rank"]) for r in got.collect()) == sorted((r["q"], r["id"], r["score"], r["rank"]) for r in whole.collect())


def test_an_append_leaves_the_rest_alone(spark, index, tmp_path):
    """Batches are files of their own; one that was not committed does not count, and a
    number is taken once."""
    _, df = index
    path = tmp_path / "i"
    made = PostingIndex(spark, str(path)).append(df.where("id = 1"), "id", "title")
    before = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    made.append(df.where("id = 2"), "id", "title")
    assert {f: f.stat().st_mtime_ns for f in before} == before
    (path / "commits" / "000000001").unlink()
    assert [r["key"] for r in made.search("matching").collect()] == [1]
    assert not claim(spark, f"{path}/commits/000000000", "x") and made.texts() == 1


def test_a_query_reads_its_slots(index):
    """Slots prune folders, tokens go down to the scan."""
    made, _ = index
    plan = made.postings(["graph"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan and "EqualTo(token,graph)" in plan


def test_postings_of_a_batch_are_not_regrouped(spark, monkeypatch, tmp_path):
    """Texts give a row for each token of several of them (before: a row for each word, grouped
    by a shuffle), in pieces of any size; texts of one key are its parts."""
    df = spark.createDataFrame(ROWS, "id long, title string").coalesce(1)
    made = PostingIndex(spark, str(tmp_path / "i")).append(df, "id", "title")
    assert spark.read.parquet(str(tmp_path / "i" / "postings")).where("token = 'graph'").count() == 1
    pieces = lambda: [r for b in postings._postings([pa.RecordBatch.from_pydict({"key": [1, 2, 3, 4], "text": ["b a b", None, "", "a  c"]})]) for r in b.to_pylist()]
    assert pieces() == [{"token": "b", "keys": [1], "positions": [[0, 2]]}, {"token": "a", "keys": [1, 4], "positions": [[1], [0]]}, {"token": "c", "keys": [4], "positions": [[2]]}]
    monkeypatch.setattr(postings, "BYTES", 1)
    assert sorted((p["token"], p["keys"]) for p in pieces()) == [("a", [1]), ("a", [4]), ("b", [1]), ("c", [4])]
    twice = PostingIndex(spark, str(tmp_path / "j")).append(df.unionByName(df.where("id < 3")), "id", "title")
    assert {r["token"]: r["df"] for r in twice.document_frequencies(["graph", "net"]).collect()} == {"graph": 3} and twice.texts() == 9
    assert {r["key"]: r["positions"] for r in twice.postings(["graph"]).collect()} == {1: [0, 0, 3, 3], 2: [2, 2], 5: [1]}
    assert made.texts() == 7


def test_empty(spark, tmp_path):
    none = PostingIndex(spark, str(tmp_path / "none"))
    assert none.search("graph").count() == 0 and none.texts() == 0 and none.document_frequencies().count() == 0
    with pytest.raises(ValueError):
        none.search(" ".join(f"word{i}" for i in range(64)))
