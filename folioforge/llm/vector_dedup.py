"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated by random sign flips and fast Hadamard transforms; its
cross-polytope hash is the signed coordinate of largest size. Several hashes
form the bucket of a table. A vector lives in its bucket and also visits, in
each table, the buckets next in line (multiprobe: one hash replaced by its
second choice). Vectors that meet in any bucket, own or visited, are verified by
their cosine in double precision; each pair counts once, where it meets first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_array, local_components, materialize, sorted_runs, takes_part
from .components import smallest_ids

TABLES, HASHES = 6, 3
PROBES = HASHES
BLOCK = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


@lru_cache(maxsize=4)
def signs(dim: int) -> np.ndarray:
    return np.random.default_rng(11).choice([-1.0, 1.0], size=(TABLES, HASHES, 3, dim))


def codes(x: np.ndarray) -> np.ndarray:
    """Bucket codes (n, TABLES, 1 + PROBES): the own bucket, then the probes."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    flips, base = signs(size), 2 * size
    out = np.empty((len(x), TABLES, 1 + PROBES), dtype=np.int64)
    for t in range(TABLES):
        first, second = [], []
        for h in range(HASHES):
            y = x
            for r in range(3):
                y = hadamard(y * flips[t, h, r])
            top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            vals = np.take_along_axis(y, top, axis=1)
            swap = np.abs(vals[:, 1]) > np.abs(vals[:, 0])
            a, b = np.where(swap, top[:, 1], top[:, 0]), np.where(swap, top[:, 0], top[:, 1])
            rows = np.arange(len(x))
            first.append(a + size * (y[rows, a] < 0))
            second.append(b + size * (y[rows, b] < 0))
        for k in range(1 + PROBES):
            code = np.zeros(len(x), dtype=np.int64)
            for h in range(HASHES):
                code = code * base + (second[h] if k == h + 1 else first[h])
            out[:, t, k] = code
    return out


def vector_components(vecs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row per row of vecs: (id_col, n_links, component_id, kept).

    Vectors are compared where labels are equal and not null and lengths are
    equal; two link at a cosine of at least ``threshold``. n_links counts other
    rows linked directly, component_id is the smallest id reachable by links,
    kept says that it is the row's own id. Vectors that are null, empty, zero
    or hold null or non-finite components, and rows without id or label, link
    with nothing (0 links, their own component). Rows count by themselves: one
    that repeats an id with another vector has its own links. Equal vectors of a
    label form a class that is hashed once and never expanded into pairs.
    Buckets of more than BLOCK vectors are compared in blocks by many tasks, and
    none sends its pairs on: only sums and a spanning forest. An empty table
    gives an empty result; other columns are not read.
    """
    rows = vecs.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).cast("string").alias("label"))
    some = F.col("id").isNotNull() & F.col("label").isNotNull() & takes_part("vec")
    hashed = [F.when(some, F.xxhash64(F.lit(salt), "label", "vec")).alias(f"h{salt}") for salt in (1, 2)]
    members = materialize(rows.select("id", *hashed), "members")  # h1 and h2 are null where a row takes no part
    valid = rows.select("id", "label", "vec", *hashed).where("h1 is not null")
    classes = valid.groupBy("h1", "h2").agg(F.min_by(F.struct("label", "vec"), "id").alias("c"), F.min("id").alias("id"), F.count("id").alias("w"))
    # Numbered once and written: a class keeps its number, whatever runs again.
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cls"), "h1", "h2", "id", "w", "c.label", "c.vec"), "classes")
    # Lengths that share a power of two go together, padded with zeros to the longest; a key keeps them apart.
    power = F.ceil(F.log2(F.size("vec"))).cast("int")
    sums, edges = None, None
    for r in classes.groupBy(power.alias("power")).agg(F.max(F.size("vec")).alias("most")).collect():  # at most 32 rows
        padded = F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(r["most"]) - F.size("vec")))
        part = _links(classes.where(power == r["power"]).select(F.col("cls").alias("id"), "w", F.concat_ws(":", F.size("vec"), "label").alias("label"), padded.alias("vec")), threshold)
        sums = part if sums is None else sums.unionByName(part)
    alone = [F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")]
    if sums is None:
        out = members.select("id", *alone)
    else:
        sums = materialize(sums, "links")
        edges = sums.where("root is not null").select(F.col("id").alias("a"), F.col("root").alias("b"))
        found = smallest_ids(classes, edges).select("cls", F.col("id").alias("component_id"))
        linked = sums.groupBy(F.col("id").alias("cls")).agg(F.sum("n").alias("n"))
        classes = classes.select("cls", "h1", "h2", "id", "w").join(linked, "cls", "left").join(found, "cls", "left")
        classes = materialize(classes.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")), "class_links")
        out = members.join(classes, ["h1", "h2"]).select("id", "n_links", "component_id").unionByName(members.where("h1 is null").select("id", *alone))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(reps: DataFrame, threshold: float) -> DataFrame:
    """(id, n, root): shares of n_links by class weight, and forest edges."""
    coded = T.StructType([*reps.schema.fields, T.StructField("codes", T.ArrayType(T.LongType()))])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = column_array(batch.column(3)).astype(np.float64)
            c = codes(x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(len(x), -1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, c.shape[1]), type=pa.int32()), pa.array(c.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=[*batch.schema.names, "codes"])

    reps = materialize(reps.mapInArrow(code, coded), "codes")
    each = F.posexplode("codes").alias("at", "code")
    stays = reps.select("id", "label", each).select("id", "label", F.expr(f"at div {1 + PROBES}").cast("int").alias("t"), "code")
    key = ["label", "t", "code"]
    busy = stays.groupBy(key).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    stays = materialize(stays.join(busy.select(*key, F.ceil(F.col("m") / BLOCK).cast("int").alias("parts")), key).select("id", *key, "parts"), "meetings")
    # The blocks (i, j), i <= j, of a bucket: each entry goes to those that hold its own block.
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    stays = stays.withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    stays = stays.select("id", "t", "code", "own", F.xxhash64("label").alias("lh"), F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"))
    full = stays.join(reps.select("id", "w", "vec", "codes"), "id").select("lh", "t", "code", "i", "j", "own", "id", "w", "vec", "codes")
    keys = ["lh", "t", "code", "i", "j"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in sorted_runs(batches, 5):
            ids, ns, roots = [], [], []
            for s, e, (_, t, code, i, j, own, vid, w, vec, cod) in runs:
                n, root = _verify(vec[s:e], cod[s:e].reshape(e - s, TABLES, 1 + PROBES), w[s:e], int(t[s]), int(code[s]), None if i[s] == j[s] else own[s:e], threshold)
                v = vid[s:e]
                some = np.flatnonzero((n > 0) | (root != np.arange(e - s)))
                ids.append(v[some])
                ns.append(n[some])
                roots.append(pa.array(v[root[some]], mask=root[some] == some))
            if sum(map(len, ids)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(ns)), pa.concat_arrays(roots)], names=["id", "n", "root"])

    return full.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, "id long, n long, root long")


def _verify(vec: np.ndarray, cod: np.ndarray, w: np.ndarray, t: int, code: int, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of linked partners that count here, and the component roots, of
    the vectors of one block; side: the blocks, if only pairs across count."""
    m = len(vec)
    x = vec.astype(np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sums, ends_a, ends_b = np.zeros(m, dtype=np.int64), [], []
    for lo in range(0, m, 512):
        a, b = np.nonzero(x[lo : lo + 512] @ x[lo:].T >= threshold - 1e-9)
        a, b = a + lo, b + lo
        pick = a < b
        if side is not None:
            pick &= side[a] != side[b]
        a, b = a[pick], b[pick]
        exact = (vec[a].astype(np.float64) * vec[b]).sum(axis=1) / np.sqrt((vec[a].astype(np.float64) ** 2).sum(axis=1) * (vec[b].astype(np.float64) ** 2).sum(axis=1))
        a, b = a[exact >= threshold], b[exact >= threshold]
        first = np.ones(len(a), dtype=bool)
        big = np.iinfo(np.int64).max
        for u in range(t + 1):  # of all buckets that both are in, the first counts the pair
            ca, cb = cod[a, u], cod[b, u]
            least = np.full(len(a), big)
            for k in range(ca.shape[1]):
                least = np.minimum(least, np.where((cb == ca[:, k : k + 1]).any(axis=1), ca[:, k], big))
            first &= least == (code if u == t else big)
        np.add.at(sums, a[first], w[b[first]])
        np.add.at(sums, b[first], w[a[first]])
        ends_a.append(a)
        ends_b.append(b)
    return sums, local_components(m, np.concatenate(ends_a), np.concatenate(ends_b))
