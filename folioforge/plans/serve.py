"""Read-side views: search, detail, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import difftree, fts
from ..operators.related import Relation, search_related

PER_PAGE = 10


def page_of(df: DataFrame, order: str, page: int, per_page: int = PER_PAGE) -> DataFrame:
    return df.orderBy(order).offset((page - 1) * per_page).limit(per_page)


def search_publications(df: DataFrame, column: str, part: str, order: str, page: int = 1) -> DataFrame:
    """Rows whose column holds a text, any case; one page of them."""
    return page_of(df.where(F.contains(F.lower(column), F.lit(part.lower()))), order, page)


class SearchManager:
    """Full-text search over fixed columns of a table; with a key also over those of
    related tables, as ``relation__column``."""

    def __init__(self, df: DataFrame, fields: list[str], key: str | None = None, relations: dict[str, Relation] | None = None) -> None:
        self.df, self.fields, self.key, self.relations = df, fields, key, relations

    def search(self, query: str, fields: list[str] | None = None, mode: str | None = None) -> DataFrame:
        if self.key is None:
            return fts.search(self.df, fields or self.fields, query, mode)
        return search_related(self.df, self.key, fields or self.fields, query, self.relations, mode)

    def count(self, query: str) -> int:
        return self.search(query).count()


def _only(df: DataFrame, column: str, value: int | None) -> DataFrame:
    return df if value is None else df.where(F.col(column) == value)


def publication_detail(publications: DataFrame, author_edges: DataFrame, authors: DataFrame, keyword_edges: DataFrame, keywords: DataFrame, pub: int | None = None) -> DataFrame:
    """Publications (one or all) with their authors in order and their keywords;
    author_edges(pub_id, author_id, priority), keyword_edges(pub_id, keyword_id)."""
    a = _only(author_edges, "pub_id", pub).join(authors.select(F.col("id").alias("author_id"), "main_name"), "author_id")
    a = a.groupBy("pub_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("priority", "main_name"))), lambda x: x["main_name"]).alias("authors"))
    k = _only(keyword_edges, "pub_id", pub).join(keywords.select(F.col("id").alias("keyword_id"), F.col("main_name").alias("keyword")), "keyword_id")
    k = k.groupBy("pub_id").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    return _only(publications, "id", pub).join(a.withColumnRenamed("pub_id", "id"), "id", "left").join(k.withColumnRenamed("pub_id", "id"), "id", "left")


def author_detail(author_edges: DataFrame, publications: DataFrame, author: int | None = None) -> DataFrame:
    """(author_id, columns of publications): each publication of an author, or of all, once."""
    own = _only(author_edges, "author_id", author).select("author_id", F.col("pub_id").alias("id")).distinct()
    return own.join(publications, "id").select("author_id", *publications.columns)


def cited_by(edges: DataFrame, publications: DataFrame, reference: int | None = None) -> DataFrame:
    """(reference, columns of publications): what cites a cluster, or each of all."""
    own = _only(edges, "reference", reference).select("reference", F.col("source").alias("id")).distinct()
    return own.join(publications, "id").select("reference", *publications.columns)


def references_of(edges: DataFrame, clusters: DataFrame, source: int | None = None) -> DataFrame:
    """(source, columns of clusters): what a publication, or each of all, cites."""
    own = _only(edges, "source", source).select("source", F.col("reference").alias("id")).distinct()
    return own.join(clusters, "id").select("source", *clusters.columns)


def source_urls(records: DataFrame, domains: DataFrame) -> DataFrame:
    """(url_id, url): where each source record is, as its domain and local part;
    records(url_id, local_url, domain_id), domains(domain_id, domain)."""
    return records.join(domains, "domain_id").select("url_id", F.concat_ws("/", "domain", "local_url").alias("url"))


def provenance(trees: DataFrame, sources: DataFrame, authors: DataFrame) -> DataFrame:
    """Each source's values of a record, author ids resolved to names."""
    rows = difftree.per_source(trees, sources)
    names = authors.select(F.col("id").cast("string").alias("value"), "main_name")
    ids = rows.where("attr = 'author_ids'").select("pub", "url_id", F.posexplode("values").alias("at", "value")).join(names, "value", "left")
    named = ids.groupBy("pub", "url_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("main_name", "value").alias("n")))), lambda x: x["n"]).alias("names"))
    return rows.join(named, ["pub", "url_id"], "left").withColumn("values", F.when(F.col("attr") == "author_ids", F.col("names")).otherwise(F.col("values"))).drop("names")


def vote(trees: DataFrame, pub: int, attr: str, value: str, votes: int = 1) -> DataFrame:
    """All trees after votes for one value of one record."""
    cast = trees.sparkSession.createDataFrame([(pub, attr, value, votes)], "pub long, attr string, value string, votes int").withColumn("pub", F.col("pub").cast(trees.schema["pub"].dataType))
    return difftree.apply_votes(trees, cast)
