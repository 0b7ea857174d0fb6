"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most d bits differ in at most d of
their eight bytes, so they share at least 8 - d bytes at equal positions. That
is the guaranteed minimum of the count filter. For d = 3 it is five of eight:
split the positions into two halves of four, and one half holds three shared
bytes. The inverted index therefore has, for each half and each three of its
bytes, a posting (positions, three bytes): eight postings for a fingerprint,
and every pair that can pass the filter meets in one of them. There the tally of
shared positional bytes is taken for each pair, pairs below the minimum leave,
and only the rest are verified by their Hamming distance. A posting that is too
long is indexed again by five positions, the guaranteed minimum itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import local_components, map_rows, materialize, sorted_runs
from .components import smallest_ids

BLOCK = 4096
#: Rows of a posting that are tallied against the rest at once.
ROWS = 256


def fingerprint(text: str | None, k: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the k-word shingles of a text, A-Z lower-cased."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < k:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))
    digest = xxhash.xxh64_intdigest
    n, ones = len(grams), np.zeros(64, dtype=np.int64)
    for i in range(0, n, 8192):
        h = np.array([digest(g, seed) for g in grams[i : i + 8192]], dtype=">u8")
        ones += _bit_counts(h.view(np.uint8).reshape(-1, 8))
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _bit_counts(rows: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set; rows: n times 8 bytes."""
    out, bits = np.zeros(64, dtype=np.int64), np.unpackbits(rows, axis=1)
    for i in range(0, len(bits), 255):  # sums of up to 255 fit into bytes
        out += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return out


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, digest): rows are told apart by their id and their text's digest."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.withColumn("digest", F.xxhash64("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id, digest, fp): fp is the fingerprint as a signed long."""

    def run(cols: list[list]) -> list:
        return [cols[0], cols[2], np.array([fingerprint(t, k) for t in cols[1]], dtype=np.uint64).astype(np.int64)]

    return map_rows(identified(docs, id_col, text_col), "id long, digest long, fp long", run)


def _byte(fp: Column, i: int) -> Column:
    return F.shiftright(fp, 56 - 8 * i).bitwiseAND(F.lit(255).cast("long"))


def _keys(positions: list[tuple[int, ...]]) -> Column:
    """An array of (positions' number, those bytes) as structs."""
    fp = F.col("fp")
    out = []
    for n, which in enumerate(positions):
        key = F.lit(0).cast("long")
        for i in which:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, i))
        out.append(F.struct(F.lit(n).alias("which"), key.alias("key")))
    return F.array(*out)


#: Three of either half of the positions: any five of eight positions hold one.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Any five positions, for postings that are too long.
FIVES = list(combinations(range(8), 5))


def near_pairs_forest(reps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Edges (a, b) between ids of reps(id, fp) with distinct fingerprints.

    The edges link exactly what pairs at max_bits or fewer differing bits link,
    but are a forest for each posting: never all pairs of one. A posting of
    more than BLOCK fingerprints is indexed again by five positions; there the
    other 24 bits bound its length, and beyond BLOCK its neighbours are
    enumerated by their bit masks instead of compared in pairs.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the index guarantees pairs at up to 3 differing bits")
    posted = reps.select("id", "fp", F.explode(_keys(TRIPLES)).alias("p")).select("p.which", "p.key", "fp", "id")
    long_ = materialize(posted.groupBy("which", "key").count().where(F.col("count") > BLOCK).drop("count"), "long_postings")
    cold = posted.join(long_, ["which", "key"], "left_anti")
    hot = posted.join(long_, ["which", "key"], "left_semi").select("id", "fp").distinct()
    hot = hot.select("id", "fp", F.explode(_keys(FIVES)).alias("p")).select((F.col("p.which") + len(TRIPLES)).alias("which"), "p.key", "fp", "id")
    rows = cold.select("which", "key", "fp", "id").unionByName(hot).repartition("which", "key").sortWithinPartitions("which", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in sorted_runs(batches, 2):
            a, b = [], []
            for start, end, (_, _, fp, ids) in runs:
                root = near_components(fp[start:end].view(np.uint64), max_bits)
                own = ids[start:end]
                other = np.flatnonzero(root != np.arange(len(root)))
                a.append(own[other])
                b.append(own[root[other]])
            if sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def filtered_pairs(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b), a < b, of one posting that pass the count filter: those that
    share 8 - max_bits bytes or more at equal positions."""
    bytes_ = fp.astype(">u8").view(np.uint8).reshape(-1, 8).T.copy()
    ends_a, ends_b = [], []
    for lo in range(0, len(fp), ROWS):
        tally = np.zeros((len(fp[lo : lo + ROWS]), len(fp) - lo), dtype=np.uint8)
        for own in bytes_:  # how often a pair meets in the postings of one position and byte
            tally += own[lo : lo + ROWS, None] == own[None, lo:]
        a, b = np.nonzero(tally >= 8 - max_bits)
        later = a < b
        ends_a.append(a[later] + lo)
        ends_b.append(b[later] + lo)
    return np.concatenate(ends_a), np.concatenate(ends_b)


def near_components(fp: np.ndarray, max_bits: int) -> np.ndarray:
    """For fingerprints of one posting: the first index linked with each."""
    n = len(fp)
    if n <= BLOCK:
        a, b = filtered_pairs(fp, max_bits)
        near = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
        return local_components(n, a[near], b[near])
    differing = np.bitwise_or.reduce(fp ^ fp[0])
    bits = [np.uint64(1) << np.uint64(i) for i in range(64) if int(differing) >> i & 1]
    order = np.argsort(fp)
    ranked, label = fp[order], np.arange(n)
    masks = [np.bitwise_or.reduce(np.array(c)) for r in range(1, max_bits + 1) for c in combinations(bits, r)]
    ends_a, ends_b = [], []
    for k, mask in enumerate(masks):
        want = ranked ^ mask
        at = np.minimum(np.searchsorted(ranked, want), n - 1)
        hit = np.flatnonzero((ranked[at] == want) & (at > np.arange(n)))
        ends_a.append(label[hit])
        ends_b.append(label[at[hit]])
        if k % 64 == 63 or k == len(masks) - 1:
            label = local_components(n, np.concatenate(ends_a), np.concatenate(ends_b))[label]
            ends_a, ends_b = [], []
    first = np.full(n, n)
    np.minimum.at(first, label, order)
    out = np.empty(n, dtype=np.int64)
    out[order] = first[label]
    return out


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per row of docs: (id_col, fingerprint, component_id).

    fingerprint: 16 hex digits. component_id: the smallest id reachable over
    fingerprints that differ in at most max_bits bits, the row's own included.
    Rows with equal fingerprints form a class; only classes are compared.
    A null or blank text has the fingerprint zero and links like any other. A
    row with a null id keeps its row and takes its class's component. Repeated
    rows stay. An empty table gives an empty result; other columns of docs are
    not read.
    """
    fps, classes = _classes(docs, id_col, text_col, k, max_bits)
    out = fps.join(classes, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(id, digest, fp) of the rows, and (fp, component_id, root) of the classes."""
    fps = materialize(fingerprints(docs, id_col, text_col, k), "fingerprints")
    reps = materialize(fps.groupBy("fp").agg(F.min("id").alias("id")), "classes")
    edges = near_pairs_forest(reps.select(F.col("fp").alias("id"), "fp"), max_bits)
    linked = smallest_ids(reps.select(F.col("fp").alias("cls"), "id"), edges).select(F.col("cls").alias("fp"), F.col("id").alias("component_id"), "root")
    classes = reps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "id").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return fps, materialize(classes, "class_components")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, max_bits: int = 3) -> DataFrame:
    """docs with one row of each component: see keep_first."""
    fps, classes = _classes(docs, id_col, text_col, k, max_bits)
    return keep_first(docs, fps.join(classes, "fp").select("id", "digest", "root"), id_col, text_col)


def keep_first(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row of each group of found(id, digest, root).

    The row with the smallest id stays, a null id after all others; of equal ids
    the one with the smallest text digest, of equal texts the one whose columns
    come first (any, if a column has no order). Rows that repeat an id with a
    text of another group stay. Texts are shuffled once: rows are first combined
    by id and text, then those that go are joined away by the same partitioning,
    with one plan at any number of them.
    """
    found = materialize(found, "groups")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    first = found.groupBy("root").agg(F.min(order).alias("first"))
    gone = found.join(first, "root").where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest"))))
    key = [F.col(id_col).cast("long").alias("__id"), F.xxhash64(F.col(text_col).cast("string")).alias("__digest")]
    whole = F.struct(*[F.col(c) for c in docs.columns])
    some = F.any_value(whole) if any("map<" in f.dataType.simpleString() or f.dataType.simpleString() == "variant" for f in docs.schema) else F.min(whole)
    rows = docs.groupBy(*key).agg(some.alias("__row"))
    gone = gone.select(F.col("id").alias("__gone"), F.col("digest").alias("__digest")).distinct().hint("merge")
    rows = rows.join(gone, rows["__digest"].eqNullSafe(gone["__digest"]) & rows["__id"].eqNullSafe(gone["__gone"]), "left_anti")
    return rows.select("__row.*")
