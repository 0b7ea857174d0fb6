"""A positional index that grows by batches.

On disk: ``postings/batch=b/slot=s`` holds (token, keys, positions), sorted by token,
a row for each token of some texts, with the texts' keys; ``counts`` in the same folders holds in how many
texts of the batch each token is. A token's slot comes from its first two letters,
so a query reads the slots of its tokens (and of a prefix) only, and in them, by
Parquet's statistics, little more than its tokens' rows. A batch is written to a
folder of its own and counts once its number is claimed in ``commits``; nothing
that was written before is read or written again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_title
from ..storage import claim, names_in
from .fts import Term, best_matches, parse

#: Slots of an index, and parts that a slot is dealt to, so that none is one task's.
SLOTS, PARTS = 64, 8
#: Terms of a query and words of a phrase: one bit each.
MOST = 63
#: Bytes of texts whose words are sorted at once, at most, or one text.
BYTES = 16 << 20
POSTINGS, COUNTS = "token string, keys array<{}>, positions array<array<int>>, batch string, slot int", "token string, df long, batch string, slot int"


def slot_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(token, 1, 2)), F.lit(SLOTS)).cast("int")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, keys, positions) of some texts at a time, of (key, normalised text)."""
    for b in batches:
        b = b.filter(pc.is_valid(b.column("text")))
        part = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64) // BYTES
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
        for start, size in zip(starts, np.diff(np.append(starts, len(part))), strict=True):
            yield _postings_of(b.slice(start, size))


def _postings_of(texts: pa.RecordBatch) -> pa.RecordBatch:
    words = pc.split_pattern(texts.column("text"), " ")
    coded = words.flatten().dictionary_encode()
    sizes = pc.list_value_length(words).to_numpy()
    code, row = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    blank = coded.dictionary.index("").as_py()
    code, row, at = (x[code != blank] for x in (code, row, at))
    # Words come in order of text and place, which a stable sort keeps.
    order = np.argsort(code, kind="stable")
    code, row, at = code[order], row[order], at[order]
    new = np.append(True, code[1:] != code[:-1])[: len(code)]
    first = np.flatnonzero(new | np.append(True, row[1:] != row[:-1])[: len(code)])  # of a token in a text
    tokens = np.flatnonzero(new[first])
    lists = lambda starts, values: pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)
    positions = lists(tokens, lists(first, pa.array(at, pa.int32())))
    token, keys = coded.dictionary.take(pa.array(code[first][tokens])), lists(tokens, texts.column("key").take(pa.array(row[first])))
    return pa.RecordBatch.from_arrays([token, keys, positions], ["token", "keys", "positions"])


def _by_key(rows: DataFrame, *kept: str) -> DataFrame:
    """(kept, key, positions): rows of the index, one for each text."""
    return rows.select(*kept, F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("positions").alias("positions"))).alias("one")).select(*kept, "one.key", "one.positions")


class PostingIndex:
    """The index at a path. Keys are of one type; a text is indexed once, and texts
    of one key count as its parts."""

    def __init__(self, spark: SparkSession, path: str, key_type: str = "long") -> None:
        self.spark, self.path, self.key_type = spark, path, key_type

    def commits(self) -> list[dict]:
        """What each committed batch wrote: its folder and its number of texts."""
        names = names_in(self.spark, f"{self.path}/commits")
        rows = self.spark.read.text([f"{self.path}/commits/{n}" for n in names], wholetext=True).collect() if names else []
        return [json.loads(r["value"]) for r in rows]

    def append(self, df: DataFrame, key: str, text: Column | str) -> PostingIndex:
        """Add the texts of df. Null texts and texts without words count as texts, and
        have no token. Of writers at the same time each gets a number of its own."""
        n, batch = len(names_in(self.spark, f"{self.path}/commits")), uuid.uuid4().hex
        rows = df.select(F.col(key).cast(self.key_type).alias("key"), normalize_title(text).alias("text"))
        texts, most = rows.groupBy("key").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
        each = rows.mapInArrow(_postings, f"token string, keys array<{self.key_type}>, positions array<array<int>>")
        if most > 1:  # only then can a token and key come twice
            parts = _by_key(each, "token").groupBy("token", "key").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
            each = parts.select("token", F.array("key").alias("keys"), F.array("positions").alias("positions"))
        each = each.withColumn("slot", slot_of(F.col("token")))
        dealt = each.repartition("slot", F.pmod(F.xxhash64("keys"), F.lit(PARTS))).sortWithinPartitions("slot", "token")
        dealt.write.partitionBy("slot").parquet(f"{self.path}/postings/batch={batch}")
        # Read back with its schema: a batch without tokens has no files.
        df_of = self._read("postings", [batch]).groupBy("slot", "token").agg(F.sum(F.size("keys")).alias("df"))
        df_of.repartition("slot").sortWithinPartitions("token").write.partitionBy("slot").parquet(f"{self.path}/counts/batch={batch}")
        content = json.dumps({"batch": batch, "texts": texts})
        while not claim(self.spark, f"{self.path}/commits/{n:09d}", content):
            n += 1
        return self

    def _read(self, kind: str, batches: list[str]) -> DataFrame:
        schema = POSTINGS.format(self.key_type) if kind == "postings" else COUNTS
        if not batches:
            return self.spark.createDataFrame([], schema)
        # One basePath, so that batch and slot are columns that prune folders.
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/batch={b}" for b in batches])

    def _all(self, kind: str) -> DataFrame:
        return self._read(kind, [c["batch"] for c in self.commits()])

    def texts(self) -> int:
        return sum(c["texts"] for c in self.commits())

    def postings(self, tokens: list[str]) -> DataFrame:
        """(token, key, positions) of a few tokens."""
        return _by_key(self._of("postings", tokens), "token")

    def document_frequencies(self, tokens: list[str] | None = None) -> DataFrame:
        """(token, df): in how many texts each token is, from the batches' counts."""
        rows = self._all("counts") if tokens is None else self._of("counts", tokens)
        return rows.groupBy("token").agg(F.sum("df").alias("df"))

    def _of(self, kind: str, tokens: list[str]) -> DataFrame:
        return self._all(kind).where(F.col("slot").isin([slot_of(F.lit(t)) for t in tokens]) & F.col("token").isin(tokens))

    @staticmethod
    def _leaf(rows: DataFrame, words: tuple[str, ...], prefix: bool) -> DataFrame:
        """(key): texts that hold the words one after the other, of which the last may go on."""
        hits = []
        for i, w in enumerate(words):
            open_end = prefix and i == len(words) - 1
            mine = rows if open_end and len(w) < 2 else rows.where(F.col("slot") == slot_of(F.lit(w)))
            hits.append(mine.where(F.startswith("token", F.lit(w)) if open_end else F.col("token") == w))
        if len(words) == 1:
            return hits[0].select(F.explode("keys").alias("key")).distinct()
        # A place where the phrase begins is one that every word names.
        named = [_by_key(h).select("key", F.explode("positions").alias("at")).select("key", (F.col("at") - i).alias("start"), F.lit(1 << i).cast("long").alias("bit")) for i, h in enumerate(hits)]
        places = reduce(DataFrame.unionByName, named).groupBy("key", "start").agg(F.bit_or("bit").alias("seen"))
        return places.where(F.col("seen") == (1 << len(words)) - 1).select("key").distinct()

    def search(self, query: str, mode: str | None = None, rows: DataFrame | None = None) -> DataFrame:
        """(key): texts that match a query (see fts.parse and fts.matches). Each word
        or phrase gives its keys; a key's set of them decides. MOST bounds them."""
        leaves: list[tuple[tuple[str, ...], bool]] = []
        decision = decide(parse(query, mode), leaves)
        if not leaves:
            return self.spark.createDataFrame([], f"key {self.key_type}")
        rows = self._all("postings") if rows is None else rows
        hits = [self._leaf(rows, w, p).select("key", F.lit(1 << i).cast("long").alias("bit")) for i, (w, p) in enumerate(leaves)]
        return reduce(DataFrame.unionByName, hits).groupBy("key").agg(F.bit_or("bit").alias("bits")).where(decision).select("key")

    def search_many(self, queries: list[str], mode: str | None = None) -> DataFrame:
        """(query, key) for a few queries."""
        rows = self._all("postings")
        return reduce(DataFrame.unionByName, [self.search(q, mode, rows).select(F.lit(q).alias("query"), "key") for q in queries])

    def best(self, queries: DataFrame, qkey: str, qtokens: str, limit: int | None = 5) -> DataFrame:
        """(qkey, key, score, rank) as fts.best_matches, from the kept counts and the
        postings of the queries' tokens."""
        asked = queries.select(F.explode(qtokens).alias("token")).where("token != ''").distinct()
        slots = [r[0] for r in asked.select(slot_of(F.col("token"))).distinct().collect()]  # SLOTS at most
        rows = self._all("postings").where(F.col("slot").isin(slots)).join(asked, "token", "left_semi").select("token", F.explode("keys").alias("key"))
        counts = self._all("counts").where(F.col("slot").isin(slots)).groupBy("token").agg(F.sum("df").alias("df"))
        return best_matches(queries, qkey, qtokens, rows, "key", self.texts(), limit, weights=counts)


def decide(terms: list[Term] | tuple[Term, ...], leaves: list[tuple[tuple[str, ...], bool]]) -> Column:
    """Whether a text's set of leaves matches; leaves are numbered as they come."""
    any_of, all_of = F.lit(False), F.lit(True)
    for t in terms:
        if t.kind == "group":
            own = decide(t.terms, leaves)
        else:
            leaf = (t.words, t.kind == "prefix")
            if leaf not in leaves:
                if len(leaves) == MOST or len(t.words) > MOST:
                    raise ValueError(f"a query has at most {MOST} terms, a phrase at most {MOST} words")
                leaves.append(leaf)
            own = F.col("bits").bitwiseAND(F.lit(1 << leaves.index(leaf)).cast("long")) != 0
        if t.sign == "+":
            all_of = all_of & own
        elif t.sign == "-":
            all_of = all_of & ~own
        else:
            any_of = any_of | own
    return all_of if any(t.sign == "+" for t in terms) else all_of & any_of
