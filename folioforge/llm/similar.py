"""Near copies by the Jaccard similarity of their word shingles, none missed.

Equal shingle sets form a class; only classes are compared. The SimHash byte
index proposes pairs at up to three differing bits. Pairs at more bits come from
a prefix filter: sets whose similarity is at least s share a shingle among the
first n - ceil(s n) + 1 of each under any common order, so those shingles are
the postings. The order puts shingles that are frequent in a sample last, which
keeps postings short; it decides the cost, never the result. Each proposed pair
goes through a bound first: in bitmaps of the parity of shingles on each bit, an
element in only one set flips one bit, so sets differ by no less than their
bitmaps. What passes is verified on the whole sets. Neighbours in a posting are
compared first. Then every pair in it whose ends are not linked yet: by size, by
bitmap and by the whole sets, three steps that keep only the rows of a posting
that some pair still needs, and at last a forest of links, never the pairs.
Postings of shingles that the sample says are long are dealt in blocks, so that
every two blocks meet in one task and none holds a whole posting.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, sorted_runs
from .components import connected_components, smallest_ids
from .simhash import _bit_counts, identified, keep_first, near_pairs_forest

SAMPLE, OFTEN, MOST_FREQUENT = 20_000, 4, 100_000
#: Expected rows of a posting's block, rows that are compared with the rest at once,
#: and pairs that are looked at together.
BLOCK, ROWS, PAIRS = 4096, 64, 1 << 14
#: Pairs a row up to which a posting gives its pairs, and the most bits of a filter.
FEW, FILTER = 2, 1 << 26
NEEDED = ["key", "n", "id", "label", "other"]
EPS = 1e-9


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, k: int, known: WordHashes) -> np.ndarray:
    """Hashes of all k-word shingles, A-Z lower-cased; fewer words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    w = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(k, len(w))
    n = len(w) - k + 1 if k else 0
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + w[i : i + n]
    return _mix(h)


def _fingerprint(h: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 8192):
        ones += _bit_counts(h[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8))
    return int(np.packbits(ones * 2 > len(h)).view(">i8")[0])


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - EPS) + 1 if n else 0


def parity_bits(s: np.ndarray) -> bytes:
    """Of at least 2 n bits, a power of two, the parity of a set's hashes on each."""
    size = 1 << max(6, (2 * len(s) - 1).bit_length())
    at = ((s >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """What two sets differ by at least; the longer bitmap is folded."""
    p, q = sorted((np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)), key=len)
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def frequent_shingles(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Shingles that are frequent in a bounded sample of rows(id, text), sorted,
    how often they occur there, and the sample's share of the rows."""
    share = min(1.0, SAMPLE / max(1, rows.count()))
    sample = rows.where(F.pmod(F.xxhash64("id", "digest"), F.lit(1_000_003)) < int(1_000_003 * share) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingles(text, k, known)).view(np.int64))], names=["h"])

    often = sample.select("text").mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= OFTEN)
    found = often.orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).toPandas()
    h, n = found["h"].to_numpy(dtype=np.int64).view(np.uint64), found["count"].to_numpy(dtype=np.int64)
    order = np.argsort(h)
    return h[order], n[order], share


def sketches(rows: DataFrame, k: int, similarity: float) -> DataFrame:
    """(id, digest, c1, c2, fp, n, prefix, bits) of rows(id, text, digest): the
    set's two digests, fingerprint, size, the postings of its first shingles in the
    common order, and parity bits. A long posting is that of each two blocks of it
    that hold the set's own."""
    often, times, share = frequent_shingles(rows, k)
    blocks = np.ceil(times / share / BLOCK).astype(np.int64)

    def dealt(first: np.ndarray, own: int) -> np.ndarray:
        if not len(often) or not len(first):
            return first
        at = np.minimum(np.searchsorted(often, first), len(often) - 1)
        parts = np.where(often[at] == first, blocks[at], 1)
        out = [first[parts == 1]]
        for h, m in zip(first[parts > 1], parts[parts > 1], strict=True):
            mine, other = np.uint64(own % int(m)), np.arange(m, dtype=np.uint64)
            out.append(_mix(h ^ _mix((np.minimum(mine, other) << np.uint64(32) | np.maximum(mine, other)) + np.uint64(1))))
        return np.concatenate(out)

    def run(cols: list[list]) -> list:
        known = WordHashes()
        out: list[list] = [[] for _ in range(6)]
        for text in cols[1]:
            h = shingles(text, k, known)
            s = np.unique(h)
            first = s
            if len(often) and len(s):
                at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                rank = np.where(often[at] == s, times[at], 0)
                first = s[np.argsort(rank, kind="stable")] if rank.any() else s
            c1, c2 = (int(_mix(s * np.uint64(odd) + np.uint64(len(s))).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for odd in (1, 0xC2B2AE3D27D4EB4F))
            row = (c1, c2, _fingerprint(h) if len(h) else 0, len(s), dealt(first[: prefix_length(len(s), similarity)], c1 & 0x7FFFFFFF).view(np.int64), parity_bits(s))
            for c, v in zip(out, row, strict=True):
                c.append(v)
        return [cols[0], cols[2], *out]

    return map_rows(rows, "id long, digest long, c1 long, c2 long, fp long, n int, prefix array<long>, bits binary", run)


def _neighbours(met: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of neighbours by size in postings met(key, n, id)."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in sorted_runs(batches, 1):
            (s, _, (key, n, ids)), e = runs[0], runs[-1][1]
            i = np.flatnonzero((key[s : e - 1] == key[s + 1 : e]) & (n[s : e - 1] >= similarity * n[s + 1 : e] - EPS)) + s
            yield from _batch(ids[i], ids[i + 1])

    return met.repartition("key").sortWithinPartitions("key", "n", "id").mapInArrow(near, "a long, b long").distinct()


def _open_pairs(n: np.ndarray, label: np.ndarray, similarity: float, least: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In parts, the pairs (a, b), a + least <= b, of one posting by rising size
    whose labels differ and whose sizes allow the similarity."""
    for lo in range(0, len(n), ROWS):
        hi = min(lo + ROWS, len(n))
        top = int(np.searchsorted(n, n[hi - 1] / similarity + EPS, side="right"))
        a, b = np.nonzero((label[lo:hi, None] != label[None, lo:top]) & (n[lo:hi, None] >= similarity * n[None, lo:top] - EPS))
        later = a + least <= b
        yield a[later] + lo, b[later] + lo


def _needed(rows: DataFrame, similarity: float) -> DataFrame:
    """The rows (key, n, id, label, other) of postings that are in an open pair,
    other null; where rows have no bits, not of neighbours, which have been
    compared. Where they have, in one that bits allow; and a posting that has at
    most FEW such pairs a row gives the pairs (id, other) instead, key null."""
    with_bits = "bits" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = (1 - similarity) / (1 + similarity)
        for runs in sorted_runs(batches, 1):
            keep, ends_a, ends_b = [], [], []
            for s, e, (_, n, ids, label, *bits) in runs:
                some, own_n, own, count = np.zeros(e - s, dtype=bool), n[s:e], label[s:e], 0
                held: list[tuple[np.ndarray, np.ndarray]] = []
                if (own != own[0]).any():
                    maps = Bitmaps(bits[0][s:e]) if bits else None
                    for a, b in _open_pairs(own_n, own, similarity, 1 if bits else 2):
                        for i in range(0, len(a), PAIRS):
                            p, q = a[i : i + PAIRS], b[i : i + PAIRS]
                            if maps is not None:
                                near = maps.apart(p, q) <= most * (own_n[p] + own_n[q]) + EPS
                                p, q = p[near], q[near]
                                count += len(p)
                                if count <= FEW * (e - s):
                                    held.append((p, q))
                            some[p] = some[q] = True
                if bits and count <= FEW * (e - s):
                    ends_a += [ids[s + p] for p, _ in held]
                    ends_b += [ids[s + q] for _, q in held]
                else:
                    keep.append(np.flatnonzero(some) + s)
            if keep and len(at := np.concatenate(keep)):
                yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in runs[0][2][:4]), pa.nulls(len(at), pa.int64())], names=NEEDED)
            if ends_a:
                for pairs in _batch(np.concatenate(ends_a), np.concatenate(ends_b)):
                    none = pa.nulls(pairs.num_rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([none, pa.nulls(pairs.num_rows, pa.int32()), pairs.column(0), none, pairs.column(1)], names=NEEDED)

    kept = ["key", "n", "id", "label", *["bits"] * with_bits]
    return rows.select(*kept).repartition("key").sortWithinPartitions("key", "n", "id").mapInArrow(run, "key long, n int, id long, label long, other long")


class Bitmaps:
    """Parity bitmaps of one posting's rows, by width: folded to every power of two
    of words up to a row's own."""

    def __init__(self, bits: np.ndarray) -> None:
        own = [np.frombuffer(b, dtype=np.uint64) for b in bits]
        self.power = np.array([len(x).bit_length() - 1 for x in own])
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        for p in range(int(self.power.max()) + 1):
            rows = np.flatnonzero(self.power >= p)
            place = np.zeros(len(own), dtype=np.int64)
            place[rows] = np.arange(len(rows))
            self.tables.append((place, np.array([np.bitwise_xor.reduce(own[i].reshape(-1, 1 << p), axis=0) for i in rows])))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What the sets of each pair differ by at least: see least_difference."""
        out, power = np.zeros(len(a), dtype=np.int64), np.minimum(self.power[a], self.power[b])
        for p in np.unique(power):
            at, (place, table) = power == p, self.tables[p]
            out[at] = np.bitwise_count(table[place[a[at]]] ^ table[place[b[at]]]).sum(axis=1)
        return out


def _forest(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of postings rows(key, n, id, label, grams): of each posting a
    forest over its labels that joins what its similar pairs join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in sorted_runs(batches, 1):
            ends_a, ends_b = [], []
            for s, e, (_, n, ids, label, grams) in runs:
                sets = [np.frombuffer(x, dtype=np.int64) for x in grams[s:e]]
                root = np.unique(label[s:e], return_inverse=True)[1].astype(np.int64)
                for a, b in _open_pairs(n[s:e], label[s:e], similarity):
                    some = root[a] != root[b]
                    for x, y in zip(a[some].tolist(), b[some].tolist(), strict=True):
                        if root[x] == root[y]:
                            continue  # linked meanwhile
                        shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if shared >= similarity * (len(sets[x]) + len(sets[y]) - shared) - EPS:
                            root[root == root[y]] = root[x]
                            ends_a.append(ids[s + x])
                            ends_b.append(ids[s + y])
            if ends_a:
                yield from _batch(np.array(ends_a), np.array(ends_b))

    ordered = rows.select("key", "n", "id", "label", "grams").repartition("key").sortWithinPartitions("key", "n", "id")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _batch(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
    if len(both):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], names=["a", "b"])


def _possible(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose parity bits allow the similarity; known: (id, n, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
            most = (1 - similarity) / (1 + similarity)
            keep = [least_difference(p, q) <= most * (i + j) + EPS for i, j, p, q in zip(n, m, x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    left, right = (known.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long").distinct()


def _possibly(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose digest can be among wanted(of_digest): a bit for each of the
    digests' values modulo the filter's size, which is bounded. It only spares
    texts the shuffle of the join that follows."""
    size = 1 << max(16, (16 * wanted.count()).bit_length())
    size = min(size, FILTER)
    at = F.pmod(F.col("of_digest"), F.lit(size).cast("long"))
    words = wanted.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toPandas()
    table = np.zeros(size // 64, dtype=np.int64)
    table[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    bits = table.view(np.uint64)
    place = rows.columns.index("digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column(place).to_numpy(zero_copy_only=False) % size
            keep = (bits[d >> 6] >> (d & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            if keep.any():
                yield batch.filter(pa.array(keep))

    return rows.mapInArrow(run, rows.schema)


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose whole sets have at least this Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                p, q = np.frombuffer(x[i].as_py(), dtype=np.int64), np.frombuffer(y[i].as_py(), dtype=np.int64)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                keep[i] = shared >= similarity * (len(p) + len(q) - shared) - EPS
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left, right = (sets.select(F.col("id").alias(c), F.col("grams").alias(f"grams_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "grams_a", "grams_b").mapInArrow(run, "a long, b long")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of docs: (id_col, component_id), the smallest id reachable
    over pairs whose k-word shingle sets have at least this Jaccard similarity.

    Null and blank texts have the empty set and are copies of each other. Rows
    with a null id link like others; a group of such rows only has a null
    component. Rows repeat as in docs; an empty table gives an empty result.
    """
    return _groups(docs, id_col, text_col, k, similarity).select(F.col("id").alias(id_col), "component_id")


def _groups(docs: DataFrame, id_col: str, text_col: str, k: int, similarity: float) -> DataFrame:
    """(id, digest, component_id, root) of each row; root names its component."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    rows = identified(docs, id_col, text_col)
    # Rows are numbered once and written: they keep their numbers, whatever runs again.
    sketched = materialize(sketches(rows, k, similarity).withColumn("row", F.monotonically_increasing_id()), "sketches")
    classes = sketched.groupBy("c1", "c2").agg(F.min("id").alias("id"), F.min(F.struct("id", "digest", "row")).alias("of"), F.min("fp").alias("fp"))
    classes = materialize(classes.withColumn("cls", F.col("of.row")), "classes")
    own = sketched.join(classes.select(F.col("cls").alias("row")), "row", "left_semi").select(F.col("row").alias("id"), "n", "prefix", "bits")
    posted = own.select(F.explode("prefix").alias("key"), "n", "id")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in sorted_runs(batches, 1):
            cols = runs[0][2]
            some = np.concatenate([np.arange(s, e) for s, e, _ in runs])
            yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in cols], names=["key", "n", "id"])

    met = posted.repartition("key").sortWithinPartitions("key", "n", "id").mapInArrow(shared, "key long, n int, id long")
    met = materialize(met, "shared_postings")
    by_bits = near_pairs_forest(classes.select(F.col("cls").alias("id"), "fp")).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = by_bits.union(_neighbours(met, similarity)).distinct()

    def whole(cols: list[list]) -> list:
        known = WordHashes()
        return [cols[0], [np.unique(shingles(t, k, known)).tobytes() for t in cols[1]]]

    def sets(wanted: DataFrame, name: str) -> DataFrame:
        """(id, grams) of the classes wanted(cls)."""
        of = classes.select("cls", "of").join(wanted.distinct(), "cls", "left_semi").select("cls", F.col("of.id").alias("of_id"), F.col("of.digest").alias("of_digest"))
        of = materialize(of, f"{name}_of")
        texts = _possibly(rows, of.select("of_digest")).join(of, F.col("digest").eqNullSafe(F.col("of_digest")) & F.col("id").eqNullSafe(F.col("of_id")))
        texts = texts.select(F.col("cls").alias("id"), "text").dropDuplicates(["id"])
        return materialize(map_rows(texts, "id long, grams binary", whole), name)

    possible = materialize(_possible(first, own, similarity), "possible_pairs")
    links = _similar(possible, sets(possible.select(F.col("a").alias("cls")).union(possible.select("b")), "first_sets"), similarity)
    links = materialize(links, "first_links")
    linked = materialize(connected_components(links), "linked")
    labelled = met.join(linked, "id", "left").select("key", "n", "id", F.coalesce("component", "id").alias("label"))
    open_ = materialize(_needed(labelled, similarity).drop("other"), "open_rows")
    open_ = materialize(_needed(open_.join(own.select("id", "bits"), "id"), similarity), "possible_rows")
    pairs = materialize(open_.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct(), "more_pairs")
    wanted = open_.select(F.col("id").alias("cls")).union(open_.where("other is not null").select("other"))
    grams = sets(wanted, "more_sets")
    more = _similar(pairs, grams, similarity).union(_forest(open_.where("other is null").join(grams, "id"), similarity))
    more = materialize(more, "more_links")
    linked = smallest_ids(classes.select("cls", "id"), links.union(more)).select("cls", F.col("id").alias("component_id"), "root")
    grouped = classes.select("c1", "c2", "cls", "id").join(linked, "cls", "left").select("c1", "c2", F.coalesce("root", "cls").alias("root"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return sketched.select("id", "digest", "c1", "c2").join(materialize(grouped, "class_components"), ["c1", "c2"]).select("id", "digest", "component_id", "root")


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component: see keep_first."""
    return keep_first(docs, _groups(docs, id_col, text_col, k, similarity).select("id", "digest", "root"), id_col, text_col)
