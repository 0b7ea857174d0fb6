"""Best-fit packing by bin completion.

Pieces of equal length are alike, so what has to be packed is a table of counts
by length, whose size is that of a sequence, however many documents there are.
Best fit decreasing over that table gives the incumbent; branch and bound then
fills sequences around the longest piece left, trying the undominated fillings of
least waste first, each as many times as the counts allow, and leaves a branch
where its waste, or a bound on the rest, cannot beat the incumbent. Its answer is
a plan: fillings and how often each is used. Every piece takes its place in the
plan by its rank among the pieces of its length, which partitions count by
themselves and offsets complete.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytebpe import byte_bpe
from .common import by_bytes, materialize

Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first
#: Branches, fillings tried at a branch, and steps to find fillings of one sum.
NODES, WIDTH, STEPS = 6000, 8, 300


def least_bins(counts: np.ndarray) -> int:
    """A lower bound: for each threshold k, pieces over half need bins of their own,
    those that fit with none of at least k take none of these, the rest of the pieces
    of at least k fill what is left; and for each k, a bin holds at most k pieces of
    over a (k + 1)-th of it. counts: by length, 0 to the size of a bin."""
    size = len(counts) - 1
    length = np.arange(size + 1)
    many = np.concatenate([[0], np.cumsum(counts)])  # many[i]: pieces shorter than i
    much = np.concatenate([[0], np.cumsum(counts * length)])
    k, half = np.arange(size // 2 + 1), size // 2 + 1
    alone = many[-1] - many[size - k + 1]
    large = many[size - k + 1] - many[half]
    over = much[half] - much[k] - (large * size - (much[size - k + 1] - much[half]))
    weights, scale = _shares(size)
    return int(max((alone + large + np.maximum(0, -(-over // size))).max(), (-(-(weights @ counts) // scale)).max()))


@lru_cache(maxsize=2)
def _shares(size: int, most: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """By k: what a piece of each length takes of a bin, in k * size-ths, where as
    many (k + 1)-ths as it holds count as k-ths, whole ones as themselves."""
    k, length = np.arange(1, most + 1)[:, None], np.arange(size + 1)
    parts = (k + 1) * length
    return np.where(parts % size == 0, length * k, parts // size * size), k[:, 0] * size


def best_fit(counts: np.ndarray) -> list[tuple[Filling, int]]:
    """Best fit decreasing, alike bins together: each piece goes where least room remains."""
    size = len(counts) - 1
    open_: dict[int, list[tuple[Filling, int]]] = {}
    rooms: list[int] = []  # rising

    def put(room: int, filling: Filling, bins: int) -> None:
        if room not in open_:
            insort(rooms, room)
        open_.setdefault(room, []).append((filling, bins))

    for l in range(size, 0, -1):
        left = int(counts[l])
        while left:
            at = bisect_left(rooms, l)
            if at == len(rooms):  # as many new bins as are needed
                put(size, (), left)
            room = rooms[at]
            filling, bins = open_[room].pop()
            if not open_[room]:
                del open_[rooms.pop(at)]
            most = room // l
            full, part = min(bins, left // most), left % most if bins > left // most else 0
            if full:
                put(room - most * l, (*filling, (l, most)), full)
            if part:
                put(room - part * l, (*filling, (l, part)), 1)
            bins, left = bins - full - (part > 0), left - full * most - part
            if filling and bins:
                put(room, filling, bins)
    return [x for some in open_.values() for x in some]


def dominates(a: list[int], b: list[int]) -> bool:
    """Whether the pieces of b can be dealt into bins as large as those of a."""
    if sum(b) > sum(a):
        return False
    if not b:
        return True
    tried = set()
    for i, room in enumerate(a):
        if b[0] <= room and room not in tried:
            tried.add(room)
            if dominates([*a[:i], room - b[0], *a[i + 1 :]], b[1:]):
                return True
    return False


def exact(counts: np.ndarray, total: int, most: int, steps: list[int]) -> Iterator[list[int]]:
    """Pieces, longest first and none over ``most``, of exactly this total: one
    alone, which dominates all others, or else those that begin with the longest."""
    if total <= most and counts[total]:
        yield [total]
        return
    for l in np.flatnonzero(counts[1 : min(most, total - 1) + 1])[::-1].tolist():
        steps[0] -= 1
        if steps[0] < 0:
            return
        counts[l + 1] -= 1
        for rest in exact(counts, total - l - 1, l + 1, steps):
            counts[l + 1] += 1
            yield [l + 1, *rest]
            counts[l + 1] -= 1
        counts[l + 1] += 1


def greedy(counts: np.ndarray, room: int) -> list[int]:
    """The longest piece that fits, again and again."""
    out, counts = [], counts.copy()
    while len(fit := np.flatnonzero(counts[1 : room + 1])):
        out.append(int(fit[-1]) + 1)
        counts[out[-1]] -= 1
        room -= out[-1]
    return out


def fillings(counts: np.ndarray, room: int, slack: int) -> list[list[int]]:
    """Undominated fillings of a room, least waste first, none wasting over slack:
    those that the steps find, and the greedy one."""
    found: list[list[int]] = []
    last, left = greedy(counts, room), STEPS
    for waste in range(min(slack, room - sum(last)) + 1):
        if waste == room or left <= 0:
            break
        steps = [min(left, STEPS // 4)]
        left -= steps[0]
        for f in exact(counts.copy(), room - waste, room - waste, steps):
            if not any(dominates(g, f) for g in found):
                found.append(f)
            if len(found) == WIDTH or len(f) == 1:  # one piece dominates all that is shorter
                return found
        left += max(0, steps[0])
    if room - sum(last) <= slack and not any(dominates(g, last) for g in found):
        found.append(last)
    return found


def complete(counts: np.ndarray, nodes: int = NODES) -> tuple[list[tuple[Filling, int]], int]:
    """A plan for all pieces, and a bound that no plan's number of bins is below.

    The search ends when the plan reaches that bound or after ``nodes`` branches;
    every piece is in the plan in either case."""
    size, counts = len(counts) - 1, counts.astype(np.int64).copy()
    counts[0] = 0
    plan, low = best_fit(counts), least_bins(counts)
    best, total = sum(times for _, times in plan), int((counts * np.arange(size + 1)).sum())
    used = wasted = 0

    def branches() -> Iterator[tuple[Filling, int]]:
        top = int(np.flatnonzero(counts)[-1])
        counts[top] -= 1
        choices = fillings(counts, size - top, (best - 1) * size - total - wasted)
        counts[top] += 1
        for f in choices:
            filling = tuple((l, len(list(g))) for l, g in groupby([top, *f]))
            times, waste = min(int(counts[l]) // m for l, m in filling), size - top - sum(f)
            if waste:
                times = min(times, ((best - 1) * size - total - wasted) // waste)
            if times > 0:
                yield filling, times

    def move(step: tuple[Filling, int], sign: int) -> None:
        nonlocal used, wasted
        filling, times = step
        for l, m in filling:
            counts[l] -= sign * m * times
        used += sign * times
        wasted += sign * times * (size - sum(l * m for l, m in filling))

    stack: list[tuple[Iterator, tuple[Filling, int] | None]] = [(branches(), None)] if best > low else []
    while stack and nodes > 0 and best > low:
        step = next(stack[-1][0], None)
        if step is None:
            if came := stack.pop()[1]:
                move(came, -1)
            continue
        nodes -= 1
        move(step, 1)
        deeper: Iterator = iter(())
        if counts.any():
            deeper = branches() if used + least_bins(counts) < best else deeper
        elif used < best:
            best, plan = used, [*(came for _, came in stack if came), step]
        stack.append((deeper, step))
    return plan, low


class Places:
    """Where in the plan the i-th piece of a length is."""

    def __init__(self, plan: list[tuple[Filling, int]]) -> None:
        rows, base, seen = [], 0, {}
        for filling, times in plan:
            at = 0
            for l, m in filling:
                rows.append((l, seen.get(l, 0), m, base, at))
                seen[l] = seen.get(l, 0) + m * times
                at += l * m
            base += times
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        self.length, self.first, self.each, self.base, self.at = table.T
        self.key = self.length << 48 | self.first

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset in it)."""
        k = np.searchsorted(self.key, length << 48 | rank, side="right") - 1
        within = rank - self.first[k]
        return self.base[k] + within // self.each[k], self.at[k] + within % self.each[k] * length


def pack_best(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 0, nodes: int = NODES) -> DataFrame:
    """One row per piece: (id_col, piece, start, length, ids_crc32, sequence_id,
    offset, ids).

    A document's tokens are its text's ids and then end_id; a null text counts as
    empty. Documents over ``length`` are cut into pieces of it, of which the first
    may be shorter; no other is cut. Sequences hold at most ``length`` tokens, their
    pieces lie from offset 0 without gaps, and there are as few as ``nodes`` branches
    of the search find, never more than best fit decreasing needs. ids are
    little-endian, of 16 bits where the vocabulary allows it, else 32. Ids may be null
    or repeat, every row is packed; an empty table gives an empty result; other
    columns are not read.

    The pieces are a written table, so that a lost task never changes a piece's rank.
    The driver sees one count for each length, ``length`` at most.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bpe, part = [0] * (length + 1), byte_bpe(vocab), TaskContext.get().partitionId()
        for batch in batches:
            for some in by_bytes(batch):
                out: list[tuple] = []
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids = np.append(bpe.encode(text), np.array([end_id], dtype=bpe.dtype))
                    bounds = [0, *range(len(ids) % length or min(length, len(ids)), len(ids) + 1, length)]
                    for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                        out.append((doc, p, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), part, seen[b - a], ids[a:b].tobytes()))
                        seen[b - a] += 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names = ["id", "piece", "start", "length", "ids_crc32", "part", "local", "ids"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    pieces = materialize(rows.mapInArrow(cut, "id long, piece int, start long, length long, ids_crc32 long, part int, local long, ids binary"), "pieces")
    counts = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    table = np.zeros(length + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        table[r["length"]] = r["n"]
    places = Places(complete(table, nodes)[0])
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counts.select("part", "length", before.alias("before")), ["part", "length"])

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, at = places.of(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": seq, "offset": at})

    ranked = ranked.withColumn("place", placed("length", F.col("before") + F.col("local")))
    return ranked.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset", "ids")
