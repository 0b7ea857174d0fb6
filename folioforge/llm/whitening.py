"""Whitening by tall-skinny QR.

Vectors become exact integers, each distinct one counts once. Their sums are
exact, so rows are centred without loss; each partition's centred rows are
reduced to a triangular factor, factors are merged in a tree of groups of a few,
and the right singular vectors of the last factor whiten. No covariance is
formed; only factors, each as wide as a vector, travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, materialize

#: Factors that one task merges, and rows that are factored at once (times the width).
FAN, TALL = 8, 4
STEPS, SHIFT, MOST = 64, 1_000_000, 1 << 61
LONG = 1 << 63


def quantize(c: np.ndarray) -> np.ndarray:
    """x - SHIFT of each entry; entries too large for a long end at MOST."""
    return np.clip(np.floor(c * STEPS), -float(MOST), float(MOST)).astype(np.int64)


def code(y: np.ndarray) -> bytes:
    """One vector in the narrowest integers that hold it: equal vectors, equal bytes."""
    top = int(max(abs(int(y.min())), abs(int(y.max())))) if len(y) else 0
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([width]) + y.astype(f"<i{width}").tobytes()


def decode(codes: list[bytes], d: int) -> np.ndarray:
    """The integers x of vectors of width d, a row each."""
    out = np.empty((len(codes), d), dtype=np.int64)
    for i, c in enumerate(codes):
        out[i] = np.frombuffer(c, dtype=f"<i{c[0]}", offset=1)
    return out + SHIFT


class Centre:
    """Exact sums of n vectors."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n = n
        self.low = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([s % n / n for s in sums])
        self.sums = sums
        self.wrapped = np.array([s % (1 << 64) for s in sums], dtype=np.uint64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n; only the last step rounds."""
        return (x - self.low) - self.rest

    def deviations(self, x: np.ndarray, centred: np.ndarray) -> list[int | None]:
        """Sum over the entries of (n x - S)^2, exact; null where no long holds it.
        Sums modulo 2^64 are exact wherever the true one is below 2^63."""
        with np.errstate(over="ignore"):
            d = x.astype(np.uint64) * np.uint64(self.n % (1 << 64)) - self.wrapped
            out = (d * d).sum(axis=1, dtype=np.uint64).tolist()
            about = ((centred * self.n) ** 2).sum(axis=1)
        for i in np.flatnonzero(about > 0.999 * LONG):
            exact = sum((self.n * int(v) - s) ** 2 for v, s in zip(x[i], self.sums, strict=True))
            out[i] = exact if exact < LONG else None
        return out


def upper(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16) -> DataFrame:
    """One row per vector and component: (id_col, component, n, deviation,
    whitened, explained, identity_error).

    Vectors that are null or hold null or non-finite entries give no row. Where
    lengths differ, the length with the most distinct vectors counts (of several,
    the longest); vectors of other lengths have no place in its space and give no
    row, nor do empty ones. Entries c become floor(64 c) + 1000000; those beyond
    2^61 end there. The fit list is each distinct vector once: n of them, exact
    sums S. Components are numbered by falling variance up to ``components``;
    directions without variance (beyond the rank of the fit list) are none, so one
    distinct vector alone gives an empty result. deviation is the exact sum of (n x
    - S)^2, null where it exceeds a long; whitened is x - S / n on the unit
    component over its deviation; explained the component's share of all variance;
    identity_error the largest entry of whitened's covariance over the fit list
    minus the identity. Ids may be null or repeat, rows stay; an empty table gives
    an empty result; other columns are not read.

    Only the last factor (width x width), the sums and the chosen components are
    on the driver. A lost task runs again from the fit list, which is a written table.
    """
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("v")).where(x.isNotNull() & ~bad & (F.size(x) > 0))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0)
            y, at = quantize(col.flatten().to_numpy()), np.cumsum(np.concatenate([[0], col.value_lengths().to_numpy()]))
            codes = [code(y[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([col.value_lengths().cast(pa.int32()), pa.array(codes, type=pa.binary())], names=["d", "code"])

    every = materialize(rows.select("v").mapInArrow(coded, "d int, code binary").distinct(), "fit_list")
    spark = vectors.sparkSession
    most = every.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).head()
    schema = f"`{id_col}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if most is None:
        return spark.createDataFrame([], schema)
    d, n = most["d"], most["n"]
    fit = every.where(F.col("d") == d).select("code")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for part in by_bytes(batch):
                if part.num_rows:
                    yield decode(part.column(0).to_pylist(), d)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for m in matrices(batches):
            safe = np.abs(m).max() < 1 << 40
            total = [a + int(b) for a, b in zip(total, m.sum(axis=0) if safe else m.astype(object).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), type=pa.int32()), pa.array([str(t) for t in total])], names=["at", "s"])

    sums = fit.mapInArrow(summed, "at int, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    centre = Centre(n, [int(r["s"]) for r in sums.orderBy("at").collect()])

    def factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, r = [], 0, np.zeros((0, d))
        for m in matrices(batches):
            held.append(centre.rows(m))
            waiting += len(m)
            if waiting >= TALL * d:
                held, waiting, r = [], 0, upper(np.vstack([r, *held]))
        if held:
            r = upper(np.vstack([r, *held]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], type=pa.int32()), pa.array([r.tobytes()], type=pa.binary())], names=["node", "r"])

    def merged(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("node").to_numpy())
        parts = [np.frombuffer(group.column("r")[int(i)].as_py()).reshape(-1, d) for i in order]
        return pa.table({"node": pa.array([group.column("node")[0].as_py() // FAN], type=pa.int32()), "r": pa.array([upper(np.vstack(parts)).tobytes()], type=pa.binary())})

    factors, left = fit.mapInArrow(factored, "node int, r binary"), fit.rdd.getNumPartitions()
    while True:
        factors = factors.groupBy(F.expr(f"node div {FAN}")).applyInArrow(merged, "node int, r binary")
        left = -(-left // FAN)
        if left <= 1:
            break
    last = np.frombuffer(factors.collect()[0]["r"]).reshape(-1, d)
    _, s, right = np.linalg.svd(last)
    rank = int((s > s[0] * max(n, d) * np.finfo(float).eps).sum())
    k = min(components, rank)
    if not k:
        return spark.createDataFrame([], schema)
    scaled = right[:k].T / (s[:k] / np.sqrt(n))
    explained = (s[:k] ** 2 / (s**2).sum()).tolist()

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for m in matrices(batches):
            w = centre.rows(m) @ scaled
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), type=pa.int32()), pa.array(total.ravel() / n)], names=["at", "v"])

    cov = fit.mapInArrow(products, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    error = float(np.abs(np.array([r["v"] for r in cov]).reshape(k, k) - np.eye(k)).max())

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                x = quantize(part.column(1).flatten().to_numpy()).reshape(-1, d) + SHIFT
                c = centre.rows(x)
                w, m = c @ scaled, len(x)
                dev = np.repeat(np.array(centre.deviations(x, c), dtype=object), k).tolist()
                ids = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(dev, type=pa.int64()), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.where(F.size("v") == d).mapInArrow(placed, schema)
