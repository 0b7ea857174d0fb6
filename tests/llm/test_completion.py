"""Bin completion against exhaustive search, and the library's ids."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from folioforge.llm import completion
from folioforge.llm.bytebpe import byte_bpe
from folioforge.llm.queries import BYTE_BPE


def fewest(items, size):
    """The optimal number of bins by dynamic programming over subsets."""
    n = len(items)
    best = [(n + 1, 0)] * (1 << n)
    best[0] = (1, 0)
    for s in range(1, 1 << n):
        for i in range(n):
            if s >> i & 1:
                bins, fill = best[s ^ (1 << i)]
                best[s] = min(best[s], (bins, fill + items[i]) if fill + items[i] <= size else (bins + 1, items[i]))
    return best[-1][0] if n else 0


def used(plan, counts):
    """Bins of a plan that holds all pieces and overfills no bin."""
    size, back = len(counts) - 1, np.zeros_like(counts)
    for filling, times in plan:
        assert sum(l * m for l, m in filling) <= size
        for l, m in filling:
            back[l] += m * times
    assert (back == counts).all()
    return sum(times for _, times in plan)


def test_optimal_on_small_instances():
    rng = np.random.default_rng(5)
    for _ in range(150):
        size = int(rng.integers(8, 40))
        items = rng.integers(1, size + 1, rng.integers(0, 10)).tolist()
        counts = np.bincount(items, minlength=size + 1)
        plan, low = completion.complete(counts)
        want = fewest(items, size)
        assert used(plan, counts) == want and low <= want


@pytest.mark.parametrize(("low", "high", "n"), [(1, 2049, 300), (500, 800, 600), (700, 701, 1000), (1, 60, 20000)])
def test_never_over_best_fit(low, high, n):
    counts = np.bincount(np.random.default_rng(n).integers(low, high, n), minlength=2049)
    plan, bound = completion.complete(counts, nodes=600)
    assert bound <= used(plan, counts) <= used(completion.best_fit(counts), counts)


def test_search_beats_best_fit():
    """Best fit takes 4 bins, the search 3."""
    counts = np.bincount([14, 12, 11, 11, 10, 8, 4, 2], minlength=25)
    assert used(completion.best_fit(counts), counts) == 4 and used(completion.complete(counts)[0], counts) == 3


def test_bound_and_dominance():
    assert completion.least_bins(np.bincount([700] * 1000, minlength=2049)) == 500
    assert completion.dominates([7, 4], [5, 4, 2]) and not completion.dominates([6, 5], [4, 4, 3]) and completion.dominates([3], [])
    assert not completion.dominates([5, 5], [6])


def test_many_pieces_in_a_small_plan():
    """Counts of 10^12 pieces take no longer, and ranks find their places."""
    counts = np.zeros(2049, dtype=np.int64)
    counts[[1500, 500, 48, 2048]] = 10**12
    plan, low = completion.complete(counts)
    assert used(plan, counts) == low and len(plan) < 50
    seq, at = completion.Places(plan).of(np.array([48, 1500]), np.array([10**12 - 1, 5]))
    assert (seq >= 0).all() and (at + [48, 1500] <= 2048).all()


def check(rows, got):
    """Whole tokens of every row, cut as agreed, packed without gaps."""
    library = Tokenizer.from_file(BYTE_BPE)
    want = defaultdict(int)
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048 if len(ids) > 2048 else len(ids)
        for p, (a, b) in enumerate(itertools.pairwise([0, *range(first, len(ids) + 1, 2048)])):
            want[doc_id, p, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    have, sequences = defaultdict(int), defaultdict(list)
    for r in got:
        have[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(np.frombuffer(r["ids"], dtype="<u2").astype("<u4").tobytes()) == r["ids_crc32"]
    assert have == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    counts = np.bincount([r["length"] for r in got], minlength=2049)
    assert len(sequences) <= used(completion.best_fit(counts), counts)
    return len(sequences), completion.least_bins(counts)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    found, bound = check([(r["doc_id"], r["text"]) for r in df.collect()], completion.pack_best(df, BYTE_BPE).collect())
    assert found == bound


def test_odd_documents(spark, odd_docs, no_docs):
    more = spark.createDataFrame([(20, "a<|endoftext|>b  <|endoftext|>", "x"), (21, "!" * 2047 * 8, "x"), (22, " " * 3_000_000, "x")], "doc_id long, text string, offset string")
    for df in (odd_docs, more):
        check([(r["doc_id"], r["text"]) for r in df.collect()], completion.pack_best(df, BYTE_BPE).collect())
    assert completion.pack_best(no_docs, BYTE_BPE).count() == 0


def test_ids_are_the_library_s():
    """Every code point, alone, between letters, digits and blanks."""
    bpe, library = byte_bpe(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    assert bpe.ranked is not None
    texts = ["".join(f"a{chr(c)}a 1{chr(c)}1 {chr(c)}  {chr(c)}." for c in range(b, b + 64)) for b in range(0, 0x110000, 64) if not 0xD800 <= b < 0xE000]
    for text, enc in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert bpe.encode(text).tolist() == enc.ids
