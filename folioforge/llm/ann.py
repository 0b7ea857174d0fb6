"""Approximate nearest neighbours by balanced posting lists.

Inner product becomes distance by one more coordinate that gives all vectors
the same norm. Centroids come from hierarchical balanced clustering of a
bounded sample and are searched by a neighbour graph in memory. A vector goes
to the list of its nearest centroid and, at a boundary, to those of others
nearly as near. Distance ratios say which lists a query reads. Let d be how far
its nearest centroid is and s how far its k-th nearest sample row. A vector
within s is stored with a centroid within d + 2 s, by the triangle inequality,
so a ratio of 2 would miss nothing; mostly d + r s with a much smaller r
suffices. Which r, is calibrated on sample queries of like s / d; where there
are few of them it is 2. The graph is searched outward from a query's nearest
centroid as far as that and no farther.
A query's k-th best score over the sample
rows in the lists it reads bounds its result from below, so that lists send on
only rows that can still win.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column_array, finite_vectors, materialize

#: Sample rows that give queries their scale and bound; clustering takes more of
#: them, so that each list has SAMPLED of its own.
SAMPLE, SAMPLED = 16_384, 16
#: Lists grow with the root of the data, up to what a driver clusters and an executor holds.
MOST_LISTS = 16_384
REPLICAS, CLOSE = 3, 1.05
PART = 8192
#: Centroids the graph search begins with, by how much the squared bound is
#: widened for the way through the graph, and where too little is stored.
START, SPREAD, GROW = 16, 1.2, 1.5
#: Classes of queries by scale over the distance of the nearest centroid.
CLASSES, FEW = np.arange(1, 13) / 10, 20
SLACK = 1e-9


def two_level_split(x: np.ndarray, lists: int, rng: np.random.Generator, ways: int = 8) -> np.ndarray:
    """Centroids of about ``lists`` clusters of like size: clusters are split again
    and again by a k-means that charges for size. x lies on a sphere and so do the
    centroids; means as they are would be nearer to all else the looser their
    cluster is."""
    parts, most = [np.arange(len(x))], max(1, len(x) // lists)
    out: list[np.ndarray] = []
    while parts:
        own = parts.pop()
        k = min(ways, -(-len(own) // most))
        if k < 2:
            out.append(own)
            continue
        y = x[own]
        c = y[rng.choice(len(y), k, replace=False)]
        for _ in range(8):
            d = (y**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * y @ c.T
            a, size = d.argmin(axis=1), np.zeros(k)
            size[:] = np.bincount(a, minlength=k)
            charge = d.mean() * 0.5 * (size / len(y) - 1 / k)
            a = (d + charge).argmin(axis=1)
            for j in range(k):
                if (a == j).any():
                    c[j] = y[a == j].mean(axis=0)
        pieces = [own[a == j] for j in range(k) if (a == j).any()]
        if len(pieces) == 1:
            out.append(own)  # equal vectors cannot be told apart
        else:
            parts += pieces
    c = np.array([x[p].mean(axis=0) for p in out])
    size = np.linalg.norm(c, axis=1, keepdims=True)
    return c * np.where(size > 1e-9, np.sqrt((x[0] ** 2).sum()) / np.maximum(size, 1e-9), 1.0)


class Centroids:
    """Centroids and a graph over them: near neighbours plus a ring and long
    jumps that keep every centroid reachable."""

    def __init__(self, points: np.ndarray, degree: int = 24) -> None:
        self.points, n = points, len(points)
        self.square = (points**2).sum(axis=1)
        k = min(degree, n - 1)
        links = np.empty((n, k), dtype=np.int64)
        for lo in range(0, n, 1024):
            d = self.square[None] - 2 * points[lo : lo + 1024] @ points.T
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            links[lo : lo + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
        here, jumps = np.arange(n)[:, None], 2 ** np.arange(max(1, (n - 1).bit_length()))
        self.links = np.hstack([links, (here + jumps) % n]) if n > 1 else np.zeros((1, 1), dtype=np.int64)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all rows of q at once: up to ``width`` centroids
        each, nearest first, and squared distances; -1 and inf where fewer."""
        m, n = len(q), len(self.points)
        width, qq, rows = min(width, n), (q**2).sum(axis=1), np.arange(m)
        seen = np.zeros((m, n), dtype=bool)
        ids, dist = np.full((m, width), -1), np.full((m, width), np.inf)
        open_ = np.zeros((m, width), dtype=bool)
        ids[:, 0], seen[:, 0], open_[:, 0] = 0, True, True
        dist[:, 0] = qq + self.square[0] - 2 * q @ self.points[0]
        while len(go := rows[open_.any(axis=1)]):
            at = np.where(open_[go], dist[go], np.inf).argmin(axis=1)
            open_[go, at] = False
            new = self.links[ids[go, at]]
            fresh = ~seen[go[:, None], new]
            seen[go[:, None], new] = True
            d = qq[go, None] + self.square[new] - 2 * np.einsum("md,mkd->mk", q[go], self.points[new])
            d = np.where(fresh, d, np.inf)
            if new.shape[1] > 1:  # a centroid may be linked twice
                order = np.argsort(new, axis=1, kind="stable")
                twice = np.zeros_like(fresh)
                s = np.take_along_axis(new, order, axis=1)
                np.put_along_axis(twice, order[:, 1:], s[:, 1:] == s[:, :-1], axis=1)
                d[twice] = np.inf
            all_d, all_i = np.hstack([dist[go], d]), np.hstack([ids[go], new])
            all_o = np.hstack([open_[go], np.isfinite(d)])
            best = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            dist[go] = np.take_along_axis(all_d, best, axis=1)
            ids[go] = np.where(np.isfinite(dist[go]), np.take_along_axis(all_i, best, axis=1), -1)
            open_[go] = np.take_along_axis(all_o, best, axis=1) & np.isfinite(dist[go])
        return ids, np.maximum(dist, 0)


    def within(self, q: np.ndarray, scale: np.ndarray, ratios: np.ndarray, stored: np.ndarray, least: int) -> np.ndarray:
        """Which centroids (rows of q by centroids) are within reach of each query,
        by its scale and the ratios: all that the graph reaches from its nearest
        ones over such. A query whose lists have ``least`` vectors or fewer (by
        ``stored``) goes farther."""
        m, n = len(q), len(self.points)
        qq, dist, done = (q**2).sum(axis=1), np.full((m, n), np.inf), np.zeros((m, n), dtype=bool)
        ids, d = self.search(q, START)
        row, col = np.nonzero(ids >= 0)
        dist[row, ids[row, col]] = d[row, col]
        near = np.sqrt(d[:, 0])
        bound = np.maximum(near + ratios[likeness(scale, near)] * scale, CLOSE * near) ** 2 + 1e-12
        while True:
            row, at = np.nonzero(~done & (dist <= SPREAD * bound[:, None]))
            if len(row):
                done[row, at] = True
                new = np.zeros((m, n), dtype=bool)
                new[row[:, None], self.links[at]] = True
                row, at = np.nonzero(new & np.isinf(dist))
                for i in range(0, len(row), 1 << 17):
                    r, c = row[i : i + (1 << 17)], at[i : i + (1 << 17)]
                    dist[r, c] = np.maximum(qq[r] + self.square[c] - 2 * np.einsum("id,id->i", q[r], self.points[c]), 0)
                continue
            inside = dist <= bound[:, None]
            short = (inside @ stored <= least) & ~done.all(axis=1)
            if not short.any():
                return inside
            bound[short] *= GROW


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(axis=1, keepdims=True), 0))])


def homes(index: Centroids, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists a vector is stored in: its nearest, and at most
    REPLICAS - 1 others whose centroids are at most CLOSE times as far."""
    ids, d = index.search(y, max(16, 4 * REPLICAS))
    near = (ids >= 0) & (d <= CLOSE**2 * d[:, :1] + 1e-12)
    near[:, 0], near[:, REPLICAS:] = True, False
    at, col = np.nonzero(near)
    return at, ids[at, col]


def likeness(scale: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Which class of like scale a query is in."""
    return np.searchsorted(CLASSES, scale / np.maximum(near, 1e-9))


def calibrate(index: Centroids, x: np.ndarray, norm: float, k: int, recall: float) -> np.ndarray:
    """For each class of queries the smallest ratio at which all sample queries
    find ``recall`` of their k best sample vectors; every 16th sample row is a
    query, and a class of fewer than FEW has the ratio that misses nothing."""
    out = np.full(len(CLASSES) + 1, 2.0)
    if len(x) <= k:
        return out
    rows, lists = homes(index, lifted(x, norm))
    grouped = list(zip(*_grouped(rows, lists), strict=True))
    found, of = [], []
    for lo in range(0, len(x), 4096):
        own = np.arange(lo, min(lo + 4096, len(x)), 16)
        q = x[own]
        scores = q @ x.T
        scores[np.arange(len(q)), own] = -np.inf
        best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        scale = reach(q, np.take_along_axis(scores, best, axis=1).min(axis=1), norm)
        dist = np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] + index.square[None] - 2 * np.pad(q, ((0, 0), (0, 1))) @ index.points.T, 0))
        near = dist.min(axis=1)
        ratio = np.maximum(dist - near[:, None], 0) / np.maximum(scale, 1e-9)[:, None]
        ratio[dist <= CLOSE * near[:, None]] = 0  # always read
        need = np.full((len(q), len(x)), np.inf, dtype=np.float32)
        for r, c in grouped:
            need[:, r] = np.minimum(need[:, r], ratio[:, [c]])
        found.append(np.sort(np.take_along_axis(need, best, axis=1), axis=1)[:, math.ceil(recall * k) - 1])
        of.append(likeness(scale, near))
    found, of = np.concatenate(found), np.concatenate(of)
    for i in range(len(out)):
        if (of == i).sum() >= FEW:
            out[i] = min(2.0, float(found[of == i].max()))
    return out


def reach(q: np.ndarray, score: np.ndarray, norm: float) -> np.ndarray:
    """How far a lifted vector is that has this score with a query."""
    return np.sqrt(np.maximum((q**2).sum(axis=1) + norm**2 - 2 * score, 0))


def _grouped(rows: np.ndarray, lists: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    order = np.argsort(lists, kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(lists[order]) > 0])
    return np.split(rows[order], at[1:]), lists[order][at].tolist()


def nearest(vecs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, recall: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest other rows found,
    by inner product in double precision; ties go to the smaller id.

    Queries are rows whose id is divisible by ``every``; all rows are indexed.
    Vectors that are null, empty, zero or hold null or non-finite components,
    or whose length is not the most common one (ties: the shorter), and rows
    without id take no part. Of equal vectors only the k + 1 with the smallest
    ids are stored in lists: the others lose every tie. The ratio and the bounds
    use a hashed sample of about SAMPLE rows, clustering one of SAMPLED rows a
    list; lists of more than PART vectors are read in parts. Rows that repeat an
    id count once, with the smallest of their vectors. An empty table gives an
    empty result; other columns are not read.
    """
    spark = vecs.sparkSession
    rows = vecs.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null")
    rows = materialize(finite_vectors(rows, "vec").groupBy("id").agg(F.min("vec").alias("vec")), "vectors")
    empty = "query_id long, rank int, vec_id long, score double"
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))).alias("norm")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], empty)
    dim, total, norm = sizes["d"], sizes["n"], sizes["norm"] * (1 + 1e-9)
    rows = rows.where(F.size("vec") == dim)
    lists = min(MOST_LISTS, max(1, round((total * 16) ** 0.5 / 8)))
    wanted = max(SAMPLE, SAMPLED * lists)
    share = int(1_000_003 * min(1.0, wanted / total)) + 1
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share).limit(2 * wanted).toPandas()
    rng = np.random.default_rng(5)
    sample = sample.sort_values("id").iloc[rng.permutation(len(sample))]
    index = Centroids(two_level_split(lifted(np.stack(sample["vec"].to_numpy()), norm), lists, rng))
    sample = sample.iloc[:SAMPLE]
    sample_ids, x = sample["id"].to_numpy(), np.stack(sample["vec"].to_numpy())
    ratios = calibrate(index, x, norm, k, recall)

    hashed = [F.xxhash64(F.lit(s), "vec").alias(f"h{s}") for s in (1, 2)]
    tied = W.partitionBy("h1", "h2").orderBy("id")
    stored = rows.select("id", "vec", *hashed).withColumn("r", F.row_number().over(tied)).where(F.col("r") <= k + 1).select("id", "vec")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                at, to = homes(index, lifted(column_array(part.column(1)), norm))
                first = np.r_[True, at[1:] != at[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), *part.take(pa.array(at)).columns, pa.array(first.astype(np.float64))], names=["list", "id", "vec", "least"])

    posted = materialize(stored.mapInArrow(post, schema := "list int, id long, vec array<double>, least double"), "postings")
    sizes = posted.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.sum("least").cast("long").alias("own")).collect()  # at most MOST_LISTS rows
    own_size = np.zeros(len(index.points), dtype=np.int64)
    own_size[[r["list"] for r in sizes]] = [r["own"] for r in sizes]
    at, to = homes(index, lifted(x, norm))
    sample_list = to[np.r_[True, at[1:] != at[:-1]]]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                q, own = column_array(part.column(1)), column_array(part.column(0))
                scores = q @ x.T
                scores[own[:, None] == sample_ids[None]] = -np.inf
                scale = np.full(len(q), np.inf)
                if scores.shape[1] > k:
                    scale = reach(q, -np.partition(-scores, k - 1, axis=1)[:, k - 1], norm)
                reads = index.within(np.pad(q, ((0, 0), (0, 1))), scale, ratios, own_size, k)
                scores[~reads[:, sample_list]] = -np.inf
                least = np.full(len(q), -np.inf)
                if scores.shape[1] >= k:
                    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                at, col = np.nonzero(reads)
                yield pa.RecordBatch.from_arrays([pa.array(col.astype(np.int32)), *part.take(pa.array(at)).columns, pa.array(least[at])], names=["list", "id", "vec", "least"])

    parts = F.broadcast(spark.createDataFrame([(r["list"], -(-r["n"] // PART)) for r in sizes], "list int, parts int"))  # at most MOST_LISTS rows
    asked = rows.where(F.col("id") % every == 0).mapInArrow(ask, schema)
    posted = posted.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("query", F.lit(False))
    asked = asked.join(parts, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("query", F.lit(True))
    both = posted.unionByName(asked).select("list", "part", "query", "id", "vec", "least").repartition("list", "part").sortWithinPartitions("list", "part", "query")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held, stack = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            lists_, part, query, vid, vec, least = (column_array(c) for c in batch.columns)
            cut = np.flatnonzero(np.r_[True, (lists_[1:] != lists_[:-1]) | (part[1:] != part[:-1]) | (query[1:] != query[:-1])])
            for s, e in zip(cut, [*cut[1:], len(lists_)], strict=True):
                if (now := (lists_[s], part[s])) != key:
                    key, ids, held, stack = now, [], [], None
                if not query[s]:
                    ids.append(vid[s:e]), held.append(vec[s:e])
                    continue
                if not ids:
                    continue
                if stack is None:
                    stack = np.concatenate(held), np.concatenate(ids)
                for lo in range(s, e, 512):
                    hi = min(e, lo + 512)
                    yield from _best(vid[lo:hi], vec[lo:hi], least[lo:hi], *stack, k)

    found = both.mapInArrow(read, "query_id long, vec_id long, score double").dropDuplicates(["query_id", "vec_id"])
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(qid: np.ndarray, q: np.ndarray, least: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Rows of a list part that can be among a query's k best."""
    scores = q @ x.T
    scores[qid[:, None] == xid[None]] = -np.inf
    floor = least
    if scores.shape[1] > k:
        floor = np.maximum(least, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
    a, b = np.nonzero((scores >= floor[:, None] - SLACK * (1 + np.abs(floor[:, None]))) & np.isfinite(scores))
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(qid[a]), pa.array(xid[b]), pa.array((q[a] * x[b]).sum(axis=1))], names=["query_id", "vec_id", "score"])
