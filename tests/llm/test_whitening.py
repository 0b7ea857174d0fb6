"""Whitening against exact integers and an eigendecomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm.whitening import FAN, whiten

SCHEMA = "vec_id long, embedding array<double>, n string"


def brute(rows, components=16):
    """Exact deviations, and the eigenvectors of the covariance of the distinct rows."""
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), [int(v) for v in fit.sum(axis=0)]
    dev = [sum((n * int(v) - t) ** 2 for v, t in zip(r, s, strict=True)) for r in x]
    c = (n * fit - np.array(s)) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, x.shape[1])
    return n, dev, (n * x - np.array(s)) / n @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def compare(df, rows):
    n, dev, w, explained = brute(rows)
    got = {}
    for r in whiten(df).collect():
        got.setdefault(r["vec_id"], []).append(r)
    assert set(got) == {r[0] for r in rows}
    signs = None
    errors = set()
    for i, r in enumerate(rows):
        mine = sorted(got[r[0]], key=lambda g: g["component"])
        assert [g["component"] for g in mine] == list(range(1, w.shape[1] + 1))
        assert {(g["n"], g["deviation"]) for g in mine} == {(n, dev[i])}
        values = np.array([g["whitened"] for g in mine])
        signs = np.sign(values * w[i]) if signs is None else signs
        assert np.allclose(values * signs, w[i], rtol=1e-7, atol=1e-7)
        assert np.allclose([g["explained"] for g in mine], explained, rtol=1e-9)
        errors |= {g["identity_error"] for g in mine}
    assert len(errors) == 1 and errors.pop() < 1e-9


@pytest.mark.parametrize("parts", [1, 3 * FAN])
def test_equals_eigendecomposition(spark, parts):
    """Copies count once, over one partition and over a tree of three levels."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 20)) * np.linspace(3, 0.3, 20) + 5
    rows = [(i, [float(v) for v in base[i % 250]], "x") for i in range(600)] + [(600 + i, [float(v) for v in base[250 + i % 50]], "x") for i in range(60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        compare(spark.createDataFrame(rows, SCHEMA).repartition(3), rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    compare(df, [(r["vec_id"], [float(v) for v in r["embedding"]], "") for r in df.collect()])


def test_odd_rows(spark):
    """Null and non-finite entries, other lengths and empty vectors give no row; null
    and repeated ids stay; wide entries keep their exact deviation while a long holds it."""
    rows = [(1, [1.0, 2.0], "a"), (2, [3.0, -1.0], "b"), (2, [3.0, -1.0], "b"), (None, [0.5, 9.0], "c"), (3, None, "d"), (4, [None, 1.0], "e"), (5, [float("nan"), 1.0], "f"), (6, [float("-inf"), 1.0], "g"), (7, [1.0], "h"), (8, [], "i"), (9, [-0.0, 1e-9], "j")]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2), (9, 1), (9, 2)]
    assert {r["n"] for r in got} == {4}
    wide = [(1, [1e300, 0.0], ""), (2, [0.0, 1.0], ""), (3, [2.0**26, 5.0], "")]
    seen = {r["vec_id"]: r["deviation"] for r in whiten(spark.createDataFrame(wide, SCHEMA)).collect()}
    assert seen == {1: None, 2: None, 3: None}
    ordinary = [(1, [2.0**23, 1.0], ""), (2, [0.0, 0.25], ""), (3, [1.0, 5.0], "")]
    _, dev, _, _ = brute(ordinary)
    assert {r["vec_id"]: r["deviation"] for r in whiten(spark.createDataFrame(ordinary, SCHEMA)).collect()} == dict(zip((1, 2, 3), dev, strict=True))


def test_nothing_to_whiten(spark):
    """Empty tables, and one distinct vector alone, have no direction."""
    one = spark.createDataFrame([(1, [1.0, 2.0], ""), (2, [1.0, 2.0], "")], SCHEMA)
    assert whiten(one).count() == 0 and whiten(one.limit(0)).count() == 0 and whiten(one.select("vec_id", F.lit(None).cast("array<float>").alias("embedding"))).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0], "") for i in range(5)], SCHEMA)
    assert {r["component"] for r in whiten(line).collect()} == {1}
