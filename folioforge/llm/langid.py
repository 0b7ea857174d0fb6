"""Language identification as multilingual mixture inference.

Each language has a smoothed distribution over hashed character trigrams. A
document is a mixture of languages; expectation-maximisation estimates its
proportions from the trigram likelihoods. The language set is grown greedily
and a language joins only if the log-likelihood gains more than a penalty that
grows with the logarithm of the document's length. A text is in no known language
if trigrams of any kind, all equally likely, explain it better by the same penalty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, map_rows

BITS = 15
CHUNK = 1 << 20
#: A training document counts as so many trigrams at most, whole texts read, so that
#: a long or repetitive one does not stand for its language; sums are in 1 / UNIT.
MOST_WEIGHT, UNIT = 4096, 1024


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Lower-case letter of each code point; 0 for all that are not letters."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of a whole text's letter trigrams (any non-letter is a blank;
    trigrams around blanks only are left out), their counts, and the letters."""
    if not text:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    c = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    n_letters = int(np.count_nonzero(c))
    counts = np.zeros(1 << BITS, dtype=np.int64)
    c = np.concatenate([np.zeros(1, dtype=np.uint32), c, np.zeros(1, dtype=np.uint32)])
    for i in range(0, max(len(c) - 2, 0), CHUNK):
        x, y, z = c[i : i + CHUNK + 2][:-2], c[i + 1 : i + CHUNK + 2][: len(c[i : i + CHUNK + 2]) - 2], c[i + 2 : i + CHUNK + 2]
        h = (x * np.uint32(0x9E3779B1)) ^ (y * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F)) ^ (z * np.uint32(0xC2B2AE35))
        h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        counts += np.bincount(h[(y != 0) | ((x != 0) & (z != 0))], minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at], n_letters


def em(like: np.ndarray, counts: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Mixture proportions of the rows of ``like`` (languages by trigrams,
    relative likelihoods) and the log-likelihood."""
    k = len(like)
    share = np.full(k, 1.0 / k)
    for _ in range(rounds):
        joint = share[:, None] * like
        new = (joint / joint.sum(axis=0)) @ counts
        new /= new.sum()
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-3:
            break
    return share, float(np.log(share @ like) @ counts)


def infer(logp: np.ndarray, at: np.ndarray, counts: np.ndarray, penalty: float) -> tuple[np.ndarray, list[int], float]:
    """Proportions over all languages (0 outside the selected set), the set, and by
    how much its log-likelihood is above that of trigrams of any kind.

    The set begins with the likeliest language and grows as long as some language
    gains more than the penalty. The log-likelihood is concave in the proportions,
    so that a language gains at most its derivative above the number of trigrams:
    those that cannot pass the penalty are not tried.
    """
    part = logp[:, at]
    top = part.max(axis=0)
    like = np.exp(part - top)
    single = np.log(np.maximum(like, 1e-300)) @ counts
    chosen, best = [int(single.argmax())], float(single.max())
    share, n = np.ones(1), counts.sum()
    cost = penalty * np.log(n + 1.0)
    refused: set[int] = set()
    while len(chosen) + len(refused) < len(logp):
        most = like @ (counts / np.maximum(share @ like[chosen], 1e-300)) - n
        j = max((j for j in range(len(logp)) if j not in chosen and j not in refused), key=lambda j: most[j])
        if most[j] <= cost:
            break
        new, ll = em(like[[*chosen, j]], counts)
        if ll - best <= cost:
            refused.add(j)
            continue
        chosen, best, share, refused = [*chosen, j], ll, new, set()
    out = np.zeros(len(logp))
    out[chosen] = share
    return out, chosen, best + float(top @ counts) + float(n) * BITS * np.log(2)


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def fit(train: DataFrame, max_per_lang: int = 5000, smoothing: float = 0.1) -> dict:
    """Language models of train(id, text, lang): {langs, logp}.

    At most about ``max_per_lang`` documents of a language are read, picked by
    a hash of the id; trigram counts are summed on the executors and only the
    table of languages by 2**BITS buckets comes to the driver.
    """
    train = train.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {"langs": [], "logp": np.zeros((0, 1 << BITS))}
    langs = sorted(sizes)
    limit = F.create_map(*[F.lit(x) for k in langs for x in (k, int(1_000_003 * min(1.0, max_per_lang / sizes[k])) + 1)])
    sample = train.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < limit[F.col("lang")]).select("lang", "text")
    place = {k: i for i, k in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), 1 << BITS), dtype=np.int64)
        for batch in batches:
            for part in by_bytes(batch):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    at, counts, _ = trigrams(text)
                    share = min(1.0, MOST_WEIGHT / max(int(counts.sum()), 1))
                    total[place[lang], at] += np.rint(counts * share * UNIT).astype(np.int64)
        rows, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[rows, at])], names=["l", "bucket", "n"])

    summed = sample.mapInArrow(run, "l int, bucket int, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((len(langs), 1 << BITS))
    total[summed["l"].to_numpy(), summed["bucket"].to_numpy()] = summed["n"].to_numpy() / UNIT
    some = total.sum(axis=1) > 0
    total, langs = total[some], [k for k, s in zip(langs, some, strict=True) if s]
    return {"langs": langs, "logp": np.log((total + smoothing) / (total + smoothing).sum(axis=1, keepdims=True))}


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = 3.0, max_per_lang: int = 5000) -> DataFrame:
    """One row per row of docs: (id_col, held_out, lang_pred, score, languages,
    shares, known).

    Models come from rows with a language, text and id whose crc32(id) mod 4 is
    not 2 (a bounded sample, see fit); a prediction reads only the text.
    lang_pred is the language with the largest proportion, score that
    proportion (ties: the alphabetically first), languages the selected set by
    falling proportion; known says that the text is in a known language at all. A text that is null or has no letter, and any text
    where nothing could be learned, is ``und`` with score 0. Rows repeat as in
    docs; a null id is not held out. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = fit(rows.where(F.col("id").isNotNull() & ~held_out("id")), max_per_lang)
    langs, logp = model["langs"], model["logp"]

    def run(cols: list[list]) -> list:
        pred, score, sets, shares, known = [], [], [], [], []
        for text in cols[1]:
            at, counts, n = trigrams(text)
            if not n or not langs:
                pred.append("und"), score.append(0.0), sets.append([]), shares.append([]), known.append(False)
                continue
            share, chosen, above = infer(logp, at, counts, penalty)
            known.append(above >= -penalty * np.log(counts.sum() + 1.0))
            chosen.sort(key=lambda j: (-share[j], langs[j]))
            pred.append(langs[chosen[0]]), score.append(min(1.0, float(share[chosen[0]])))
            sets.append([langs[j] for j in chosen]), shares.append([float(share[j]) for j in chosen])
        held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in cols[0]]
        return [cols[0], held, pred, score, sets, shares, known]

    out = map_rows(rows.select("id", "text"), "id long, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>, known boolean", run)
    return out.withColumnRenamed("id", id_col)


def keep_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = 3.0, max_per_lang: int = 5000) -> DataFrame:
    """The rows of docs whose text is in a known language (see identify), in one
    pass without a shuffle; a null lang_col becomes the prediction.

    Null, empty and blank texts, texts without a letter and, for instance, encoded
    bytes go; where nothing could be learned, all go. Whole texts are read however
    long, rows that repeat are treated alike, ids may be null, and an empty table
    gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = fit(rows.where(F.col("id").isNotNull() & ~held_out("id")), max_per_lang)
    langs, logp = model["langs"], model["logp"]
    place, where = docs.columns.index(text_col), docs.columns.index(lang_col)

    def predict(text: str | None) -> str | None:
        at, counts, n = trigrams(text)
        if not n or not langs:
            return None
        share, _, above = infer(logp, at, counts, penalty)
        return langs[share.argmax()] if above >= -penalty * np.log(counts.sum() + 1.0) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                pred = pa.array([predict(t) for t in part.column(place).to_pylist()], type=part.schema.field(where).type)
                part = part.set_column(where, part.schema.field(where), pc.coalesce(part.column(where), pred))
                yield part.filter(pc.is_valid(pred))

    return docs.mapInArrow(run, docs.schema)
