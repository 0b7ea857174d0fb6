"""Ingestion of a batch of canonical records into the integrated store.

Every record sees the store and the records before it in its batch, in the order
of record ids (see operators.sequence): one batch gives the store that batches of
one record give.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_title
from ..operators import difftree, entities, match, sequence, upsert
from ..schemas import SEED_TYPES
from ..storage import claim, names_in, written
from .canonical import REGISTRY

STORE_SCHEMAS = {
    "source_records": "url_id long, source string, local_url string, type_id long, cluster_id long",
    "clusters": "id long, name string",
    "publications": "id long, cluster_id long",
    "authors": "id long, main_name string, block_name string",
    "author_aliases": "author_id long, alias string, url_id long",
    "author_edges": "url_id long, author_id long, priority int",
    "media": "id long, main_name string, block_name string",
    "media_aliases": "id long, alias string",
    "keywords": "id long, main_name string, block_name string",
    "keyword_aliases": "id long, alias string",
    "keyword_edges": "url_id long, keyword_id long",
    "values": "pub long, url_id long, seq long, attr string, value string, place int",
    "limbo": "source string, local_url string, title string, reason string",
    "tombstones": "url_id long, at long",
    "limbo_authors": "source string, local_url string, priority int, name string, reason string",
}


@dataclass
class Store:
    """The integrated store as named DataFrames.

    On disk a batch is a folder of every table, with a name of its own, and counts
    only once its number is claimed in ``commits``: a save that breaks off leaves
    the store as it was. Only new rows are written. Of two writers that loaded the
    same store the second to save gets an error, as its batch has not seen the
    first's. ``tombstones`` names records that no longer count.
    """

    tables: dict[str, DataFrame] = field(default_factory=dict)
    fresh: dict[str, list[DataFrame]] = field(default_factory=dict)
    path: str | None = None
    batches: int = 0

    @classmethod
    def empty(cls, spark: SparkSession) -> Store:
        return cls({n: spark.createDataFrame([], s) for n, s in STORE_SCHEMAS.items()})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Store:
        """The store at a path; an empty one where none was saved."""
        names = names_in(spark, f"{path}/commits")
        if not names:
            return replace(cls.empty(spark), path=path)
        batches = [r["value"] for r in spark.read.text([f"{path}/commits/{n}" for n in names], wholetext=True).collect()]
        number = F.create_map(*[F.lit(x) for i, b in enumerate(batches) for x in (b, i)])
        of = lambda n, s: spark.read.schema(f"{s}, batch string").option("basePath", f"{path}/{n}").parquet(*[f"{path}/{n}/batch={b}" for b in batches]).withColumn("batch", number[F.col("batch")])
        tables = {n: of(n, s) for n, s in STORE_SCHEMAS.items()}
        dead = tables["tombstones"].groupBy("url_id").agg(F.max("at").alias("at"))
        if dead.isEmpty():
            return cls({n: df.drop("batch") for n, df in tables.items()}, {}, path, len(names))
        return cls(_without(tables, dead, F.col("batch") < F.col("at"), ["batch"]), {}, path, len(names))

    def save(self, path: str) -> Store:
        """Write what is new since the store was loaded from this path, or all of
        it to another one; the store as it is there now."""
        own, spark = path == self.path, self._spark()
        if not own and names_in(spark, f"{path}/commits"):
            raise ValueError(f"there is another store at {path}")
        n, batch = self.batches if own else 0, uuid.uuid4().hex
        for name, df in self.tables.items():
            new = reduce(DataFrame.unionByName, self.fresh.get(name, []), spark.createDataFrame([], STORE_SCHEMAS[name])) if own else df
            new.write.parquet(f"{path}/{name}/batch={batch}")
        if not claim(spark, f"{path}/commits/{n:09d}", batch):
            raise ValueError(f"another writer saved batch {n} at {path}: load the store and ingest again")
        return Store.load(spark, path)

    def forget(self, records: DataFrame) -> Store:
        """The store without records(url_id): their values, names and edges go, and
        clusters, publications and authors that only they had. A tombstone keeps them
        away from what is on disk; they can be ingested again."""
        gone = written(self["source_records"].join(records.select("url_id").distinct(), "url_id", "left_semi").select("url_id", F.lit(self.batches).cast("long").alias("at")), "gone")
        dead = gone.select("url_id", "at")
        fresh = {n: [_apart(p, dead) if "url_id" in p.columns else p for p in parts] for n, parts in self.fresh.items()}
        orphans = {n: df.select("id") for n, df in self.tables.items() if n in ORPHANS}
        tables = _without(self.tables, dead, F.lit(True), [])
        lost = {n: ids.join(tables[n], "id", "left_anti") for n, ids in orphans.items()}
        fresh = {n: [p.join(lost[n], "id", "left_anti") if n in lost else p for p in parts] for n, parts in fresh.items()}
        return Store({n: written(df, n) for n, df in tables.items()}, {n: [written(p, n) for p in parts] for n, parts in fresh.items()}, self.path, self.batches).plus(tombstones=gone)

    def _spark(self) -> SparkSession:
        return next(iter(self.tables.values())).sparkSession

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def plus(self, **new: DataFrame) -> Store:
        """The store with more rows, which are written once to the shared folder."""
        tables, fresh = dict(self.tables), {n: list(parts) for n, parts in self.fresh.items()}
        for n, df in new.items():
            part = written(df.select(*[F.col(f.name).cast(f.dataType) for f in tables[n].schema]), n)
            tables[n] = tables[n].unionByName(part)
            fresh.setdefault(n, []).append(part)
        return Store(tables, fresh, self.path, self.batches)


def _apart(df: DataFrame, dead: DataFrame, older: Column | None = None, drop: list[str] = ()) -> DataFrame:
    """Rows whose record is not dead, or younger than its tombstone."""
    hit = df.join(dead, "url_id", "left")
    gone = F.col("at").isNotNull() & (F.lit(True) if older is None else older)
    return hit.where(~gone).select(*[c for c in df.columns if c not in drop])


#: Entities that go with the last record that names them: the table of their records, and its column.
ORPHANS = {"clusters": ("source_records", "cluster_id"), "publications": ("source_records", "cluster_id"), "authors": ("author_edges", "author_id")}


def _without(tables: dict[str, DataFrame], dead: DataFrame, older: Column, drop: list[str]) -> dict[str, DataFrame]:
    """Tables without what dead(url_id, at) records left in them."""
    out = {}
    for name, df in tables.items():
        if "url_id" in df.columns and name != "tombstones":
            out[name] = _apart(df, dead, older, drop)
        else:
            out[name] = df.drop(*drop)
    for name, (used, column) in ORPHANS.items():
        # What dead records named and no living one does.
        was = tables[used].select(F.col(column).alias("k")).join(out[used].select(F.col(column).alias("k")), "k", "left_anti").distinct()
        out[name] = out[name].join(was, out[name]["cluster_id" if name == "publications" else "id"] == was["k"], "left_anti")
    return out


def change(store: Store, batch: DataFrame, source: str) -> tuple[Store, DataFrame]:
    """Ingest a batch of new and changed records: what the store has of them is
    forgotten first, so that the result is the new state's."""
    ids = batch.select(F.xxhash64(F.lit(source), "local_url").alias("url_id"))
    return ingest(store.forget(ids), batch, source)


def ingest_source(store: Store, raw: DataFrame, name: str) -> tuple[Store, DataFrame]:
    """Ingest raw rows of a registered source."""
    if name not in REGISTRY:
        raise ValueError(f"no source {name!r}; there are {sorted(REGISTRY)}")
    return ingest(store, REGISTRY[name].to_canonical(raw), name)


def first_of(batch: DataFrame, key: str) -> DataFrame:
    """One record of each key: the one whose columns come first."""
    rest = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*").select(*batch.columns)


def ingest(store: Store, batch: DataFrame, source: str) -> tuple[Store, DataFrame]:
    """The store with a batch of canonical records, and outcome counts
    (added, limbo, duplicate).

    Values arrive in the order of batches, within one in the order of record ids.
    Of records that repeat a url in a batch the first by its columns counts.
    """
    spark = batch.sparkSession
    seq = store["values"].agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("seq"))
    rows = first_of(batch, "local_url").withColumn("source", F.lit(source)).withColumn("url_id", F.xxhash64("source", "local_url"))
    fresh = match.skip_known(rows, store["source_records"], ["source", "local_url"])
    fresh = written(fresh.withColumn("title", F.col("publication.title")).withColumn("name", normalize_title("title")), "fresh")

    who = written(entities.exploded_authors(fresh), "names")
    aliases = store["author_aliases"].select("alias", F.col("author_id").alias("id"))
    titles, people = sequence.Batch(fresh.select("url_id", "name"), who, store["clusters"], store["publications"], store["authors"], aliases).resolve()

    bad = titles.where("status = 'LIMBO'").select("url_id").union(people.where("status = 'LIMBO'").select("url_id")).distinct()
    bad = written(bad, "bad")
    held = fresh.join(bad, "url_id", "left_semi")
    reasons = titles.select("url_id", F.col("reason"))
    limbo = held.join(reasons, "url_id").select("source", "local_url", "title", F.coalesce("reason", F.lit("None")).alias("reason"))
    limbo_authors = held.select("url_id", "source", "local_url").join(who.select("url_id", "priority", F.col("original_name").alias("name")), "url_id").join(people.select("url_id", "priority", "reason"), ["url_id", "priority"], "left")
    limbo_authors = limbo_authors.withColumn("reason", F.coalesce("reason", F.lit("None")))

    safe = fresh.join(bad, "url_id", "left_anti").join(titles.select("url_id", F.col("id").alias("cluster_hit")), "url_id")
    new_clusters = entities.create_clusters(safe.where("cluster_hit is null").select("name"), store["clusters"])
    safe = written(safe.withColumn("cluster_id", F.coalesce("cluster_hit", F.xxhash64("name"))), "safe")
    new_pubs = entities.create_publications(safe, store["publications"])
    ok_people = people.join(bad, "url_id", "left_anti")
    new_authors, aliases, edges = entities.create_authors(ok_people, who, store["authors"], ["url_id", "priority"])

    edges = written(edges, "edges")
    types = spark.createDataFrame(SEED_TYPES, "id long, name string")
    typed = match.match_type(safe.withColumn("kind", F.col("publication.type_ids")), "url_id", "kind", types)
    media, media_aliases, medium_of = _named(safe.select("url_id", F.col("pub_release.key").alias("name_")), "url_id", store["media"], store["media_aliases"])
    words = safe.select("url_id", F.explode("keywords").alias("name_")).distinct()
    keywords, keyword_aliases, keyword_of = _named(words, "url_id", store["keywords"], store["keyword_aliases"])

    facts = safe.join(typed, "url_id").join(medium_of.select("url_id", F.col("id").alias("medium_id")), "url_id", "left")
    people_of = edges.groupBy("url_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("priority", "author_id"))), lambda x: x["author_id"]).alias("author_ids"))
    words_of = keyword_of.groupBy("url_id").agg(F.array_sort(F.collect_set("id")).alias("keyword_ids"))
    facts = written(facts.join(people_of, "url_id", "left").join(words_of, "url_id", "left"), "facts")
    p = F.col("publication")
    wide = facts.select(
        F.xxhash64("cluster_id").alias("pub"), "url_id", p["title"].alias("title"), p["pages"].alias("pages"), p["note"].alias("note"), p["doi"].alias("doi"), p["abstract"].alias("abstract"), p["copyright"].alias("copyright"),
        p["date_published"].alias("date_published"), p["volume"].alias("volume"), p["number"].alias("number"), F.col("type_id").alias("type_ids"), F.col("medium_id").alias("pub_source_ids"), "author_ids", "keyword_ids", F.col("study_fields").alias("study_field_ids"),
    )
    wide = wide.withColumn("seq", seq.scalar())
    each = difftree.melt(wide, "pub", "url_id", "seq", difftree.ATTRIBUTES).withColumnRenamed("at", "place")

    outcome = rows.select("url_id").join(fresh.select("url_id", F.lit(True).alias("is_new")), "url_id", "left").join(bad.withColumn("is_bad", F.lit(True)), "url_id", "left")
    counts = outcome.groupBy(F.when(F.col("is_new").isNull(), "duplicate").when(F.col("is_bad"), "limbo").otherwise("added").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    grown = store.plus(
        source_records=facts.select("url_id", "source", "local_url", "type_id", "cluster_id"), clusters=new_clusters, publications=new_pubs, authors=new_authors, author_aliases=aliases, author_edges=edges, media=media, media_aliases=media_aliases,
        keywords=keywords, keyword_aliases=keyword_aliases, keyword_edges=keyword_of.select("url_id", F.col("id").alias("keyword_id")).distinct(), values=each, limbo=limbo, limbo_authors=limbo_authors,
    )
    return grown, counts


def _named(rows: DataFrame, key: str, known: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new entities, new aliases, (key, id)) of media or keywords by the block ladder."""
    named = rows.where(F.col("name_").isNotNull()).withColumn("k", F.struct(key, "name_"))
    found = match.block_ladder(named, "k", "name_", known, aliases).select(F.col("k").getField(key).alias(key), "k.name_", "id", "how", "blocks")
    found = written(found, "found")
    # A block that nobody has gets one entity; where several share it, a name that the ladder cannot place gets its own.
    own = F.xxhash64("block_name", F.when(F.col("blocks") > 1, F.col("name_")))
    made = found.withColumn("block_name", normalize_title("name_")).withColumn("id", F.coalesce("id", F.when(F.col("how") == "create", own)))
    new = made.where("how = 'create'").groupBy("id", "block_name").agg(F.min_by("name_", F.struct(key, "name_")).alias("main_name"))
    new = upsert.insert_absent(known, new, ["id"])
    links = made.select("id", F.col("name_").alias("alias")).distinct()
    return new, upsert.insert_absent(aliases, links, ["id", "alias"]), made.select(key, "id")


def trees(store: Store) -> DataFrame:
    """Difference trees of all merged publications, from the stored values."""
    v = store["values"]
    places = difftree.source_bits(v, "pub", "url_id", "seq")
    from ..functions.values import bit  # noqa: PLC0415

    each = v.join(places.select("pub", "url_id", bit("place").alias("bit")), ["pub", "url_id"])
    nodes = each.groupBy("pub", "attr", "value").agg(F.lit(0).alias("votes"), F.bit_or("bit").alias("bitvector"), F.min(F.struct("seq", "url_id", "place")).alias("ord"))
    lists = nodes.groupBy("pub", "attr").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct("value", "votes", "bitvector").alias("node")))).alias("nodes"))
    attrs = lists.groupBy("pub").agg(F.map_from_entries(F.collect_list(F.struct("attr", F.transform("nodes", lambda x: x["node"])))).alias("attrs"))
    return places.select("pub", "url_ids").distinct().join(attrs, "pub", "left")


def merged_only(store: Store, name: str = "source_records") -> DataFrame:
    """Rows of a table of the store whose record was merged into a publication;
    records in quarantine, and their rows, are left out."""
    merged = store["source_records"].join(store["publications"].select("cluster_id"), "cluster_id", "left_semi").select("url_id").distinct()
    return store[name].join(merged, "url_id", "left_semi")


def merged_publications(store: Store) -> DataFrame:
    """Publications with their default values."""
    return store["publications"].join(difftree.defaults(trees(store)).withColumnRenamed("pub", "id"), "id")
