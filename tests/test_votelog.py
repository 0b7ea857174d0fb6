"""Vote logs against one vote after the other in plain Python."""

import random

import pytest

from folioforge.operators import difftree
from folioforge.operators.votelog import apply_vote_log

SCHEMA = "pub long, attr string, value string, votes int, at long, title string"


def voted(nodes, value, votes):
    nodes = [list(n) for n in nodes]
    for i, n in enumerate(nodes):
        if n[0] == value:
            n[1] += votes
        if n[1] > nodes[0][1]:
            nodes[0], nodes[i] = nodes[i], nodes[0]
    return [tuple(n) for n in nodes]


def make(spark, lists):
    rows = [(pub, list(range(3)), {a: [(v, n, b) for v, n, b in nodes] for a, nodes in attrs.items()}) for pub, attrs in lists.items()]
    return spark.createDataFrame(rows, "pub long, url_ids array<bigint>, attrs map<string,array<struct<value:string,votes:int,bitvector:bigint>>>")


def show(df):
    return {r["pub"]: {a: [tuple(n) for n in nodes] for a, nodes in (r["attrs"] or {}).items()} for r in df.collect()}


@pytest.mark.parametrize(("chunk", "fan"), [(3, 2), (7, 3), (10_000, 1_000)])
def test_random_logs(spark, chunk, fan):
    """Heads without the most votes at the start, values no list has, zero votes, ties in time."""
    rng = random.Random(chunk)
    lists = {p: {a: [(f"v{i}", rng.choice([0, 0, 1, 4]), 1 << i) for i in range(rng.randint(1, 6))] for a in ("title", "doi")} for p in range(6)}
    log = [(rng.choice([0, 0, 0, 1, 2, 3, 4]), rng.choice(["title", "doi", "note"]), f"v{rng.randint(0, 6)}", rng.choice([0, 1, 1, 1, 2, 3]), rng.randint(0, 120), "x") for _ in range(220)]
    want = {p: dict(attrs) for p, attrs in lists.items()}
    for pub, attr, value, votes, _, _ in sorted(log, key=lambda r: (r[4], r[2], r[3])):
        if attr in want[pub]:
            want[pub][attr] = voted(want[pub][attr], value, votes)
    got = apply_vote_log(make(spark, lists), spark.createDataFrame(log, SCHEMA), chunk=chunk, fan=fan)
    assert got.columns == ["pub", "url_ids", "attrs"] and show(got) == want


def test_empty_and_null(spark):
    lists = {1: {"title": [("a", 0, 1), ("b", 0, 2)], "doi": []}}
    df = make(spark, lists)
    assert show(apply_vote_log(df, spark.createDataFrame([], SCHEMA))) == lists
    log = [(1, "title", None, 3, 1, ""), (1, "title", "b", None, 2, ""), (None, "title", "b", 1, 3, ""), (1, None, "b", 1, 4, ""), (9, "title", "b", 1, 5, ""), (1, "doi", "b", 1, 6, "")]
    assert show(apply_vote_log(df, spark.createDataFrame(log, SCHEMA))) == lists
    assert show(apply_vote_log(make(spark, {}), spark.createDataFrame(log, SCHEMA))) == {}


def test_one_vote_is_apply_votes(spark):
    df = make(spark, {1: {"title": [("a", 0, 1), ("b", 1, 2), ("c", 2, 4)]}})
    one = spark.createDataFrame([(1, "title", "a", 5, 1, "")], SCHEMA)
    assert show(apply_vote_log(df, one)) == show(difftree.apply_votes(df, one.select("pub", "attr", "value", "votes")))


def test_negative_votes_are_refused(spark):
    df = make(spark, {1: {"title": [("a", 0, 1)]}})
    with pytest.raises(Exception, match="no negative votes"):
        apply_vote_log(df, spark.createDataFrame([(1, "title", "a", -1, 1, "")], SCHEMA)).collect()
