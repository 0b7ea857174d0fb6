"""What a batch's records become when each sees all records before it.

A record's outcome depends on the clusters and authors that earlier safe records
of the same batch create. A batch is taken in parts that grow, and what a part
creates is in the store of the next. So of a family of near-equal titles only those
are compared that earlier parts' clusters do not meet yet, and all others with these
clusters alone: where a family's records are spread over the batch, its pairs do not
grow with its square. In a part all pairs that can ever matter are found once, between
distinct titles and distinct names; then outcomes are computed for the whole part
from the entities that the last outcomes create, again and again until they no
longer change. Outcomes depend on earlier records only, so what does not change is
what record after record gives, and every round settles at least one record more;
in practice a few rounds settle all. For an outcome it is enough to know the two
earliest entities that a title, name or alias meets: none, one, or several.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.distance import BITS, LONGS, edit_distances, letter_pairs
from ..functions.names import same_author
from ..functions.text import author_tokens, relevant_words, title_similarity
from ..storage import written
from .match import AMB_ALIAS, AMB_CLUSTER, AMB_NAME_BLOCK, AMB_PUB, LIMBO, MULTI_MATCH, NO_MATCH, SAFE, SINGLE_MATCH, all_tokens_match


def similar_titles(asked: DataFrame, held: DataFrame, key: str, threshold: int = 80) -> DataFrame:
    """(name, key, other): titles held(key, other) that are similar to asked(name)
    and have one of its search words. All titles are normalised; asked is distinct.

    The join is by word and class of length, which similar titles share or have next
    to each other; where many of held share both, they are dealt out, and those asked go
    to all of their shares. A pair leaves it once, at the first search word that it shares, if
    its sets of letter pairs are near enough; then edit distances are taken of many
    pairs at once, or by the join's condition where both titles have over BITS letters.
    """
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = math.log(100 / threshold)
    size = lambda c: F.floor(F.log(F.length(c)) / step).cast("int")
    asked, held = asked.where("name != ''"), held.where("other != ''")
    words = F.explode(F.array_distinct(F.split("other", " "))).alias("word")
    shares = held.select(size("other").alias("size"), words).groupBy("word", "size").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    shares = F.broadcast(shares.where("shares > 1"))
    asked = _marked(asked if _MARKS in asked.columns else asked.repartition(parts, "name"), "name", "a").withColumn("_search", F.col(_MARKS)["search"])
    asked = asked.select("name", *_BITS_OF["a"], "an", "_search", F.explode(F.array(*[size("name") + i for i in (-1, 0, 1)])).alias("size"))
    asked = asked.select("name", *_BITS_OF["a"], "an", "size", "_search", F.posexplode("_search").alias("i", "word"))
    asked = asked.select("name", *_BITS_OF["a"], "an", "size", "word", F.slice("_search", F.lit(1), F.col("i")).alias("past")).join(shares, ["word", "size"], "left")
    asked = asked.select("name", *_BITS_OF["a"], "an", "size", "word", "past", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share"))
    held = _marked(held if _MARKS in held.columns else held.repartition(parts, key, "other").distinct(), "other", "b")
    held = held.select(key, "other", *_BITS_OF["b"], "bn", size("other").alias("size"), words).join(shares, ["word", "size"], "left")
    held = held.withColumn("share", F.pmod(F.xxhash64("other"), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares")
    longer, shorter = F.greatest("an", "bn"), F.least("an", "bn")
    # An edit takes at most two elements from a set and adds at most two.
    gone = lambda x, y: sum((F.bit_count(F.col(i).bitwiseAND(F.bitwise_not(F.col(j)))) for i, j in zip(_BITS_OF[x], _BITS_OF[y], strict=True)), F.lit(0))
    near = 100 * F.abs(F.col("an") - F.col("bn")) <= (100 - threshold) * longer
    near = near & (100 * gone("a", "b") <= 2 * (100 - threshold) * longer) & (100 * gone("b", "a") <= 2 * (100 - threshold) * longer)
    near = near & ((F.size("past") == 0) | ~F.arrays_overlap("past", F.split("other", " "))) & ((shorter <= BITS) | (title_similarity("name", "other") >= threshold))
    by = ["word", "size", "share"]
    pairs = asked.repartition(parts, *by).join(held.repartition(parts, *by), by).where(near).select("name", key, "other")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                a, b = part.column(0).to_pylist(), part.column(2).to_pylist()
                sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)])
                found = sizes.min(axis=1) > BITS
                ask = np.flatnonzero(~found)
                if len(ask):
                    d = edit_distances([a[i] for i in ask], [b[i] for i in ask])
                    found[ask] = np.floor((1 - d / sizes[ask].max(axis=1)) * 100) >= threshold
                yield part.filter(pa.array(found))

    return pairs.mapInArrow(similar, pairs.schema)


#: Pairs of titles that are compared in one step.
CHUNK = 4096
#: Titles with a word and class of length that are compared in one place.
SHARE = 1000
#: Columns of a title's set of letter pairs, by side of the join.
_BITS_OF = {side: [f"_{side}{i}" for i in range(LONGS)] for side in "ab"}
#: Column of what a comparison needs of a title: its length, the set of its letter pairs, and its search words.
_MARKS = "_marks"


def marks(titles: DataFrame, name: str) -> DataFrame:
    """titles with _MARKS."""
    at, bits = titles.columns.index(name), [f"b{i}" for i in range(LONGS)]

    def with_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = letter_pairs([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(sets[:, i]) for i in range(LONGS)]], names=[*batch.schema.names, *bits])

    made = titles.mapInArrow(with_bits, StructType([*titles.schema, *[StructField(b, LongType()) for b in bits]])).withColumn("_words", relevant_words(name))
    few = F.forall("_words", lambda w: F.length(w) < 4)
    search = F.array_distinct(F.when(few, F.split(name, " ")).otherwise(F.col("_words"))).alias("search")
    return made.withColumn(_MARKS, F.struct(F.length(name).alias("n"), *bits, search)).drop("_words", *bits)


def _marked(titles: DataFrame, name: str, side: str) -> DataFrame:
    """titles with _MARKS, and columns of its bits and length for a side of the join.
    They are made here, not for each of a title's words."""
    made = titles if _MARKS in titles.columns else marks(titles, name)
    return made.withColumns({**{c: F.col(_MARKS)[f"b{i}"] for i, c in enumerate(_BITS_OF[side])}, f"{side}n": F.col(_MARKS)["n"]})


def similar_authors(asked: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """(normal, key, other): names held(key, other) that have all telling words of
    asked(normal) and can be the same person's. All names are normalised; asked is distinct."""
    need = asked.select("normal", author_tokens("normal").alias("need"))
    blocks = held.select(key, "other", F.split("other", " ").alias("has"))
    pairs = all_tokens_match(need, "normal", "need", blocks, key, "has").join(held.select(key, "other"), key)
    return pairs.where(same_author("normal", "other")).select("normal", key, "other")


def _two(rows: DataFrame, by: str, kept: list[str] = ()) -> DataFrame:
    """(by, first, second): of rows(by, id, since, *kept) the two earliest ids; a
    null since is before all records. Spark keeps two rows of each group and task
    before it shuffles them."""
    order = W.partitionBy(by).orderBy(F.asc_nulls_first("since"), "id")
    top = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 2)
    pick = lambda i: F.max(F.when(F.col("r") == i, F.struct("id", "since", *kept)))
    return top.groupBy(by).agg(pick(1).alias("first"), pick(2).alias("second"))


def _aliases(named: DataFrame) -> DataFrame:
    return named.select("url_id", "id", F.explode(F.array("original_name", "parsed_name")).alias("alias")).where("alias is not null")


def _there(x: str, at: Column) -> Column:
    """1 if the entity x is there before the record at, else 0."""
    return F.when(F.col(x).isNotNull() & (F.col(f"{x}.since").isNull() | (F.col(f"{x}.since") < at)), 1).otherwise(0)


def _match(n: Column) -> Column:
    return F.when(n == 0, NO_MATCH).when(n == 1, SINGLE_MATCH).otherwise(MULTI_MATCH)


#: Records of a batch's first part, and how many times as many are done with after each part as before it.
FIRST, GROWTH = 16384, 4


class Batch:
    """One batch: records(url_id, name), who(url_id, priority, original_name,
    parsed_name, normal), and the store's clusters(id, name), publications(cluster_id),
    authors(id, block_name), aliases(alias, id). Records come in the order of url_id."""

    def __init__(self, records: DataFrame, who: DataFrame, clusters: DataFrame, publications: DataFrame, authors: DataFrame, aliases: DataFrame) -> None:
        self.records, self.who, self.store = written(records, "records"), who, (clusters, publications, authors, aliases)

    def resolve(self) -> tuple[DataFrame, DataFrame]:
        """(titles, people): the outcomes that record after record gives."""
        records, store, found, n, done = self.records, self.store, [], self.records.count(), [FIRST]
        while done[-1] < n:
            done.append(done[-1] * GROWTH)
        shares = [x / n for x in done[:-1]]
        ends = sorted(set(records.select(F.percentile_approx("url_id", shares)).first()[0])) if shares else []
        for after, last in zip([None, *ends], [*ends, None], strict=True):
            at = (F.lit(True) if after is None else F.col("url_id") > after) & (F.lit(True) if last is None else F.col("url_id") <= last)
            part = Part(records.where(at), self.who.where(at), *store)
            found.append(part.resolve())
            if last is not None:
                store = tuple(df.unionByName(new) for df, new in zip(store, part.created(*found[-1]), strict=True))
        titles, people = (reduce(DataFrame.unionByName, parts) for parts in zip(*found, strict=True))
        return titles.select("url_id", "status", "match", "id", "reason"), people


class Part:
    """The pairs of one part of a batch, in the form of Batch."""

    def __init__(self, records: DataFrame, who: DataFrame, clusters: DataFrame, publications: DataFrame, authors: DataFrame, aliases: DataFrame) -> None:
        # A title goes by the hash of itself that is the id of the cluster it creates.
        self.records, self.who, self.nobody = records.withColumn("k", F.xxhash64("name")), who, who.isEmpty()
        parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        names = written(marks(records.select("name").repartition(parts, "name").distinct(), "name"), "titles")
        pubs = publications.groupBy("cluster_id").agg(F.count("*").alias("pubs"))
        stored = similar_titles(names, clusters.select("id", F.col("name").alias("other")), "id").join(pubs.withColumnRenamed("cluster_id", "id"), "id", "left")
        equal = F.col("name") == F.col("other")
        exact = F.max(equal).over(W.partitionBy("name"))
        stored = stored.withColumn("exact", equal).withColumn("any", exact).where(F.col("exact") | ~F.col("any")).select("name", "id", F.coalesce("pubs", F.lit(0)).alias("pubs"), "exact")
        self.stored = written(stored, "stored_titles")
        # A title that the store has meets nothing but itself, and one that meets any of the store's is never created.
        asked = names.join(self.stored.where("exact").select("name"), "name", "left_anti")
        new = names.join(self.stored.select("name"), "name", "left_anti").select(F.col("name").alias("other"), F.lit(0).alias("k"), _MARKS)
        inside = similar_titles(asked, new, "k")
        self.titles = written(inside.select(F.xxhash64("name").alias("k"), F.xxhash64("other").alias("o")), "title_pairs")
        if self.nobody:
            none = lambda schema: records.sparkSession.createDataFrame([], schema)
            self.people, self.pairs, self.aliases = none("normal string, id long"), none("normal string, other string"), none("alias string, id long")
            return
        people = written(who.select("normal").distinct(), "names")
        held = authors.select("id", F.col("block_name").alias("other"))
        self.people = written(similar_authors(people, held, "id").select("normal", "id"), "stored_names")
        # The other name stands for itself: all_tokens_match needs a key of its own. A name that meets any of the store's is never created.
        other = people.join(self.people.select("normal"), "normal", "left_anti").select(F.col("normal").alias("other"), F.col("normal").alias("k"))
        self.pairs = written(similar_authors(people, other, "k").select("normal", "other"), "name_pairs")
        asked = who.select(F.col("original_name").alias("alias")).distinct()
        self.aliases = written(aliases.select("alias", "id").join(asked, "alias", "left_semi").distinct(), "aliases")

    def titles_after(self, state: DataFrame | None) -> DataFrame:
        """(url_id, status, match, id, reason) by what the records of a state create."""
        since = F.lit(None).cast("long").alias("since")
        hits = self.stored.select(F.xxhash64("name").alias("k"), "id", since, "pubs")
        own = None
        if state is not None:
            made = state.where("safe and title_match = 'NO_MATCH'").groupBy(F.col("k").alias("o")).agg(F.min("url_id").alias("since"))
            near = self.titles.join(made, "o")
            new = near.where("k != o").select("k", F.col("o").alias("id"), "since", F.lit(1).cast("long").alias("pubs"))
            hits, own = hits.unionByName(new), near.where("k = o").select("k", F.col("since").alias("own"))
        both = self.records.select("url_id", "k").join(_two(hits, "k", ["pubs"]), "k", "left")
        both = both.join(own, "k", "left") if own is not None else both.withColumn("own", F.lit(None).cast("long"))
        n = _there("first", F.col("url_id")) + _there("second", F.col("url_id"))
        n, pubs, id_ = F.when(F.col("own") < F.col("url_id"), 1).otherwise(n), F.when(F.col("own") < F.col("url_id"), 1).otherwise(F.col("first.pubs")), F.when(F.col("own") < F.col("url_id"), F.col("k")).otherwise(F.col("first.id"))
        both = both.select("url_id", "k", n.alias("n"), pubs.alias("pubs"), id_.alias("id"))
        lone = (F.col("n") == 1) & (F.col("pubs") != 1)  # one cluster, but not one publication
        ok = (F.col("n") <= 1) & ~F.coalesce(lone, F.lit(False))
        return both.select("url_id", "k", F.when(ok, SAFE).otherwise(LIMBO).alias("status"), F.when(ok, _match(F.col("n"))).otherwise(MULTI_MATCH).alias("match"), F.when(ok & (F.col("n") == 1), F.col("id")).alias("id"), F.when(~ok, F.when(F.col("n") == 1, AMB_PUB).otherwise(AMB_CLUSTER)).alias("reason"))

    def people_after(self, state: DataFrame | None, people: DataFrame | None) -> DataFrame:
        """(url_id, priority, status, match, id, reason) likewise: by alias, and for
        names without one by name block."""
        since = F.lit(None).cast("long").alias("since")
        aliases, blocks = self.aliases.select("alias", "id", since), self.people.select("normal", "id", since)
        if state is not None:
            safe = self._named(people, state.where("safe"))
            new = _aliases(safe).groupBy("alias", "id").agg(F.min("url_id").alias("since")).join(self.aliases, ["alias", "id"], "left_anti")
            made = safe.where("match = 'NO_MATCH'").groupBy(F.col("normal").alias("other")).agg(F.min("url_id").alias("since"))
            aliases = aliases.unionByName(new.select("alias", "id", "since"))
            blocks = blocks.unionByName(self.pairs.join(made, "other").select("normal", F.xxhash64("other").alias("id"), "since"))
        at = F.col("url_id")
        by_alias = self.who.select("url_id", "priority", F.col("original_name").alias("alias"), "normal").join(_two(aliases, "alias"), "alias", "left")
        by_alias = by_alias.select("url_id", "priority", "normal", (_there("first", at) + _there("second", at)).alias("n_alias"), F.col("first.id").alias("alias_id"))
        both = by_alias.join(_two(blocks, "normal"), "normal", "left").withColumn("n_block", _there("first", at) + _there("second", at))
        n, id_ = F.when(F.col("n_alias") > 0, F.col("n_alias")).otherwise(F.col("n_block")), F.when(F.col("n_alias") > 0, F.col("alias_id")).otherwise(F.col("first.id"))
        reason = F.when(F.col("n_alias") > 1, AMB_ALIAS).otherwise(AMB_NAME_BLOCK)
        return both.select("url_id", "priority", F.when(n <= 1, SAFE).otherwise(LIMBO).alias("status"), _match(n).alias("match"), F.when(n == 1, id_).alias("id"), F.when(n > 1, reason).alias("reason"))

    def resolve(self) -> tuple[DataFrame, DataFrame]:
        """(titles, people) likewise, when nothing changes any more; titles with what they are for created."""
        state = people = None
        mark = None
        while True:
            found = people if self.nobody and people is not None else written(self.people_after(state, people), "people")
            held = found.where("status = 'LIMBO'").select("url_id").distinct().withColumn("held", F.lit(True))
            titles = self.titles_after(state).join(held, "url_id", "left")
            titles = written(titles.withColumn("safe", (F.col("status") == SAFE) & F.col("held").isNull()).drop("held"), "titles")
            state, people = titles.withColumnRenamed("match", "title_match"), found
            last, mark = mark, [df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first() for df in (titles, found)]
            if mark == last:
                return titles, people

    def created(self, titles: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(clusters, publications, authors, aliases) that the outcomes add to the store."""
        safe = titles.where("safe")
        clusters = self.records.join(safe.where("match = 'NO_MATCH'").select("url_id"), "url_id", "left_semi").select(F.col("k").alias("id"), "name").where("name is not null").distinct()
        clusters = written(clusters, "clusters")
        named = people.withColumns({"normal": F.lit(""), "original_name": F.lit(""), "parsed_name": F.lit("")}) if self.nobody else written(self._named(people, safe), "named")
        authors = named.where("match = 'NO_MATCH'").select("id", F.col("normal").alias("block_name")).distinct()
        aliases = _aliases(named).select("alias", "id").distinct()
        return clusters, clusters.select(F.col("id").alias("cluster_id")), authors, aliases

    def _named(self, people: DataFrame, safe: DataFrame) -> DataFrame:
        """The people of safe records, each with the id of the author found or created."""
        rows = people.join(safe.select("url_id"), "url_id", "left_semi").join(self.who.select("url_id", "priority", "original_name", "parsed_name", "normal"), ["url_id", "priority"])
        return rows.withColumn("id", F.coalesce("id", F.xxhash64("normal")))
