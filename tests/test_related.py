"""Search over related tables."""

import pytest

from folioforge.operators import fts
from folioforge.operators.related import Relation, search_related
from folioforge.plans.serve import SearchManager


@pytest.fixture(scope="module")
def tables(spark):
    pubs = spark.createDataFrame([(1, "Deep Graphs", 10), (2, "Graph Matching", 11), (3, None, None), (4, "", 99), (None, "Deep Graphs", 10)], "id long, title string, medium long")
    media = spark.createDataFrame([(10, "Journal of Trees", 7), (11, "Große Netze", 8)], "id long, title string, publisher long")
    houses = spark.createDataFrame([(7, "Oak Press"), (8, None)], "id long, name string")
    people = spark.createDataFrame([(1, "Ann Deep"), (2, "Bob Hall"), (3, "Ann Hall")], "id long, name string")
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (3, 2), (3, 2), (4, 77)], "pub long, author long")
    medium = Relation(media, "id", pubs.select("id", "medium"), {"publisher": Relation(houses, "id", media.select("id", "publisher"))})
    return pubs, {"medium": medium, "author": Relation(people, "id", edges)}


FIELDS = ["title", "medium__title", "medium__publisher__name", "author__name"]


@pytest.mark.parametrize(
    ("query", "want"),
    [("deep", [1, 2]), ("+deep +hall", [1]), ("+graph* -oak", [2]), ("+oak +graphs", [1]), ('"ann hall"', [1]), ('"bob hall ann"', []), ("grosse", [2]), ("-deep", []), ("", []), ("+hall -(oak press)", [3]), ("hall", [1, 3]), ("(deep graphs) +bob", [1, 3])],
)
def test_paths(tables, query, want):
    pubs, relations = tables
    found = search_related(pubs, "id", FIELDS, query, relations)
    assert found.columns == pubs.columns and sorted(r["id"] for r in found.collect()) == want


def test_own_columns_as_without_relations(tables):
    pubs, _ = tables
    keyed = pubs.where("id is not null")
    for q in ("graph", "+deep -matching", '"graph matching"', "graph*"):
        got = SearchManager(keyed, ["title"], "id").search(q)
        assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in fts.search(keyed, ["title"], q).collect())


def test_unknown_paths_and_empty_tables(spark, tables):
    pubs, relations = tables
    for bad in ("nosuch", "nosuch__name", "author"):
        with pytest.raises(ValueError, match="no column and no path"):
            search_related(pubs, "id", [bad], "x", relations)
    assert search_related(pubs.limit(0), "id", FIELDS, "deep", relations).count() == 0
