"""Entity creation: what a batch adds to the integrated store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import metaphone_name
from ..functions.text import normalize_author, normalize_title
from .match import NO_MATCH
from .upsert import insert_absent, numbered


def exploded_authors(records: DataFrame, key: str = "url_id") -> DataFrame:
    """(key, priority, original_name, parsed_name, normal): authors with their place."""
    each = records.select(key, F.posexplode("authors").alias("priority", "a"))
    return each.select(key, "priority", "a.original_name", "a.parsed_name", normalize_author("a.parsed_name").alias("normal"))


def create_authors(matches: DataFrame, rows: DataFrame, authors: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new authors, aliases, edges) of safely matched author rows.

    Names without a match become one author for each normalised name of the
    batch; both written forms become aliases. Edges keep the source order.
    """
    safe = rows.join(matches.where("status = 'SAFE'").select(*key, "match", F.col("id").alias("hit")), key)
    named = safe.withColumn("author_id", F.when(F.col("match") == NO_MATCH, F.xxhash64("normal")).otherwise(F.col("hit")))
    new = named.where(F.col("match") == NO_MATCH).groupBy("author_id", F.col("normal").alias("block_name")).agg(F.min_by("parsed_name", F.struct(*key)).alias("main_name"))
    new = insert_absent(authors, new.select(F.col("author_id").alias("id"), "main_name", "block_name"), ["id"])
    aliases = named.select("author_id", F.explode(F.array_distinct(F.array("original_name", "parsed_name"))).alias("alias"), "url_id").distinct()
    edges = named.groupBy("url_id", "author_id").agg(F.min("priority").alias("priority"))
    return new, aliases, edges


def create_clusters(titles: DataFrame, clusters: DataFrame) -> DataFrame:
    """New clusters(id, name) of titles(name) that the store lacks."""
    return insert_absent(clusters, numbered(titles.select("name").distinct(), ["name"]), ["name"]).select("id", "name")


def create_publications(records: DataFrame, publications: DataFrame) -> DataFrame:
    """One publication(id, cluster_id) for each cluster without one."""
    new = records.select("cluster_id").distinct().withColumn("id", F.xxhash64("cluster_id"))
    return insert_absent(publications.select("cluster_id"), new, ["cluster_id"]).select("id", "cluster_id")


def clusters_of_log(log: DataFrame) -> DataFrame:
    """(id, name): clusters of an evaluation log's (kind, id, title) lines."""
    return log.select(F.conv("id", 16, 10).cast("bigint").alias("id"), normalize_title("title").alias("name")).dropDuplicates(["id"])


def name_table(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, main_name, normal_name, metaphone_name); null and empty names are left out."""
    named = rows.where(F.length(name) > 0).select(key, F.col(name).alias("main_name"), normalize_author(name).alias("normal_name"))
    return named.withColumn("metaphone_name", metaphone_name("normal_name"))
