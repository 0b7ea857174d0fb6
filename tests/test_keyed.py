"""Tables in buckets: upserts against plain ones, plans without exchanges."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import upsert
from folioforge.operators.keyed import KeyedTable

SCHEMA = "k string, j long, title string, harvested long, stamp string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(str, df.select("k", "j", "title", "harvested", "stamp").collect()))


@pytest.fixture
def no_broadcast(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_upserts_equal_merges_of_the_whole_table(spark, tmp_path, no_broadcast):
    """Random batches, nulls in values; written by several sessions of the table."""
    rng, path = random.Random(3), str(tmp_path / "t")
    make = lambda n: spark.createDataFrame([(f"k{a}", b, rng.choice(["x", None, "Ünï"]), rng.choice([None, 7]), None) for a, b in {(rng.randrange(30), rng.randrange(3)) for _ in range(n)}], SCHEMA)
    want = spark.createDataFrame([], SCHEMA)
    for i in range(4):
        t = KeyedTable(spark, path, SCHEMA, ["k", "j"], 8, ["harvested"])
        batch, stamp = make(40), {"stamp": F.lit(f"run {i}")}
        assert t.upsert(batch, stamp) == i
        want = upsert.upsert(want, batch, ["k", "j"], ["harvested"], stamp)
        assert rows_of(t.current()) == rows_of(want)
    assert "Exchange" not in plan(t.current())
    small = t.compact(str(tmp_path / "c"))
    assert rows_of(small.current()) == rows_of(want) and small.versions().count() == want.count()
    more = make(20)
    assert rows_of(t.absent(more)) == rows_of(more.join(want, ["k", "j"], "left_anti"))
    assert plan(t.absent(more.na.fill({"j": 0}))).count("Exchange hashpartitioning") == 3  # new ones, and both sides' null keys
    for side in (t.current().select("k", "j").join(more, ["k", "j"]), upsert.upsert(t.current(), more.coalesce(1), ["k", "j"])):
        assert plan(side).count("Exchange hashpartitioning") == 1  # the new rows'
    assert small.upsert(more) == 1 and rows_of(small.current()) == rows_of(upsert.upsert(want, more, ["k", "j"], ["harvested"]))


def test_null_keys_repeated_versions_and_lacking_columns(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], 4)
    assert t.current().count() == 0
    t.upsert(spark.createDataFrame([(None, "a"), ("", "b")], "k string, title string"))
    t.upsert(spark.createDataFrame([(None, "c")], "k string, title string"), version=5)
    t.upsert(spark.createDataFrame([(None, "d"), ("z", "e")], "k string, title string"), version=5)
    assert {(r["k"], r["title"]) for r in t.current().collect()} == {(None, "d"), ("", "b"), ("z", "e")}
    assert t.absent(spark.createDataFrame([(None,), ("",), ("new",)], "k string")).collect() == [("new",)]
    assert t.upsert(spark.createDataFrame([], "k string")) == 6 and t.current().count() == 3


def test_two_writers_get_two_versions(spark, tmp_path):
    a, b = (KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], 4) for _ in range(2))
    got = [x.upsert(spark.createDataFrame([(k, k)], "k string, title string")) for x, k in ((a, "a"), (b, "b"))]
    assert got == [0, 1] and a.current().count() == b.current().count() == 2


def test_another_description_is_refused(spark, tmp_path):
    KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], 4)
    with pytest.raises(ValueError, match="other keys"):
        KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], 8)
    for schema, keys in (("k string, version_no long", ["k"]), (SCHEMA, ["nosuch"]), (SCHEMA, [])):
        with pytest.raises(ValueError, match="must be columns"):
            KeyedTable(spark, str(tmp_path / "u"), schema, keys, 4)
