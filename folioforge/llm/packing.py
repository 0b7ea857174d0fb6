"""Packing along a space-filling curve.

Each document becomes a hashed token vector, projected to a few dimensions; its
place on the Hilbert curve through them is its sort key. Documents are dealt to
ranges of the curve, sorted along it, and their tokens fill sequences one after
the other, so that neighbours share sequences. A document is cut only where a
sequence is full, and the last sequence of a range is cut into powers of two,
which need no padding.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes
from .wordbpe import compiled

BUCKETS, DIMS, BITS = 256, 4, 6
SALT_BITS = 30
#: Tokens of a range, and the most documents of a sample.
RANGE, MOST_SAMPLE = 1 << 25, 1 << 20


def project(ids: np.ndarray) -> np.ndarray:
    """A few coordinates of a bag of token ids: hashed to signed buckets,
    damped, normalised, and multiplied by a fixed random matrix."""
    h = (ids.astype(np.uint64) + 1) * np.uint64(0x9E3779B97F4A7C15)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    v = np.bincount((h >> np.uint64(48)).astype(np.int64) % BUCKETS, weights=sign, minlength=BUCKETS)
    v = np.sign(v) * np.log1p(np.abs(v))
    return (v / (np.linalg.norm(v) or 1.0)) @ _matrix()


def _matrix() -> np.ndarray:
    if "m" not in _made:
        _made["m"] = np.random.default_rng(7).normal(size=(BUCKETS, DIMS))
    return _made["m"]


_made: dict[str, np.ndarray] = {}


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of integer cells (n by dims)."""
    x = cells.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the excess rotations from the highest bit down
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def salt(doc_id: int | None) -> int:
    """Spreads documents of one curve cell, such as copies, along the range."""
    return zlib.crc32(str(doc_id).encode()) >> (32 - SALT_BITS)


def keys(coords: np.ndarray, cuts: np.ndarray, doc_ids: list) -> np.ndarray:
    """Sort keys: the curve's cell, then the salt. cuts: dims by 2**BITS - 1."""
    cells = np.stack([np.searchsorted(cuts[d], coords[:, d], side="right") for d in range(DIMS)], axis=1)
    return hilbert(cells) << SALT_BITS | np.array([salt(i) for i in doc_ids], dtype=np.int64)


def pack(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1, max_sample: int = 4096, partitions: int | None = None) -> DataFrame:
    """One row per piece: (id_col, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, ids).

    A document's tokens are its text's ids and then end_id; a null text counts
    as empty. Every token of every row of docs is in exactly one piece, and the
    pieces of a sequence fill it from offset 0 without gaps. Sequences have
    ``length`` tokens, or a smaller power of two. Curve cells and range bounds
    come from a hashed sample of about ``max_sample`` documents; they move only
    the order and the balance, never a token. Equal keys are ordered by id, and
    the salt spreads copies over ranges. There are as many ranges as shuffle
    partitions, or more, so that none has much over RANGE tokens; for very many
    the sample grows to MOST_SAMPLE documents. Ids may be null or repeat; an empty
    table gives an empty result; other columns are not read. The token ids are
    shuffled once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.count()
    wanted = max(max_sample, min(MOST_SAMPLE, total // 1000))
    share = int(1_000_003 * min(1.0, wanted / max(total, 1))) + 1
    picked = rows.where(F.pmod(F.xxhash64("id", F.length("text")), F.lit(1_000_003)) < share)

    def coords(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                ids = [np.frombuffer(x, dtype="<u2") for x in compiled(vocab).encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) + 1 for x in ids], type=pa.int64()), pa.array([project(x).tolist() for x in ids], type=pa.list_(pa.float64()))], names=["id", "n", "x"])

    # Ordered, so that the bound holds in one job: each task keeps its first rows only.
    sample = picked.mapInArrow(coords, "id long, n long, x array<double>").orderBy(F.xxhash64("id", "n"), "id", "n").limit(2 * wanted).toPandas()
    most = total * float(sample["n"].mean()) / RANGE if len(sample) else 0
    n = partitions or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(most))
    if len(sample):
        x = np.array(sample["x"].tolist()).reshape(-1, DIMS)
        cuts = np.quantile(x, np.arange(1, 1 << BITS) / (1 << BITS), axis=0).T
        key = keys(x, cuts, sample["id"].tolist())
        order = np.argsort(key)
        weight = np.cumsum(sample["n"].to_numpy()[order])
        bounds = np.unique(key[order][np.minimum(np.searchsorted(weight, weight[-1] * np.arange(1, n) / n), len(key) - 1)])
    else:
        cuts, bounds = np.zeros((DIMS, (1 << BITS) - 1)), np.zeros(0, dtype=np.int64)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            for part in by_bytes(batch):
                doc = part.column(0).to_pylist()
                ids = compiled(vocab).encode(part.column(1).to_pylist())
                key = keys(np.array([project(np.frombuffer(i, dtype="<u2")) for i in ids]).reshape(-1, DIMS), cuts, doc)
                pid = np.searchsorted(bounds, key, side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(pid), pa.array(key), part.column(0), pa.array([i + end for i in ids], type=pa.binary())], names=["pid", "key", "id", "ids"])

    tokens = rows.mapInArrow(tokenize, "pid int, key long, id long, ids binary")
    ranged = tokens.repartitionById(n, F.col("pid")).sortWithinPartitions("pid", "key", "id")
    schema = f"`{id_col}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, used = None, 0, 0
        held: list[tuple] = []  # pieces of the open sequence

        def closed(pieces: list[tuple], number: int, pid: int) -> list[tuple]:
            out, at = [], 0
            for doc, start, total, ids in pieces:
                wide = np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()
                out.append((doc, start, len(ids) // 2, zlib.crc32(wide), total, pid << 32 | number, at, ids))
                at += len(ids) // 2
            return out

        def last(pieces: list[tuple], number: int, pid: int) -> tuple[list[tuple], int]:
            """What a range leaves over, in sequences of falling powers of two."""
            out, left = [], sum(len(p[3]) // 2 for p in pieces)
            pieces = list(pieces)
            while left:
                size, part, room = 1 << (left.bit_length() - 1), [], 1 << (left.bit_length() - 1)
                while room:
                    doc, start, total, ids = pieces.pop(0)
                    take = min(room, len(ids) // 2)
                    part.append((doc, start, total, ids[: 2 * take]))
                    if 2 * take < len(ids):
                        pieces.insert(0, (doc, start + take, total, ids[2 * take :]))
                    room -= take
                out += closed(part, number, pid)
                number, left = number + 1, left - size
            return out, number

        def batch_of(rows_: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.binary()]
            cols = list(zip(*rows_, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in (part for whole in batches for part in by_bytes(whole)):
            out: list[tuple] = []
            for pid, doc, ids in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if pid != now:
                    if now is not None:
                        more, _ = last(held, seq, now)
                        out += more
                    now, seq, used, held = pid, 0, 0, []
                total, start = len(ids) // 2, 0
                while start < total:
                    take = min(length - used, total - start)
                    held.append((doc, start, total, ids[2 * start : 2 * (start + take)]))
                    start, used = start + take, used + take
                    if used == length:
                        out += closed(held, seq, now)
                        seq, used, held = seq + 1, 0, []
            if out:
                yield batch_of(out)
        if held:
            yield batch_of(last(held, seq, now)[0])

    return ranged.mapInArrow(fill, schema)
