"""OAI-PMH: feeds page by page, and saved pages through Spark's XML reader."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import join_list
from ..functions.values import parse_mdate
from ..schemas import RAW_OAI, RAW_PREPRINT

PREPRINT_XML = """
header STRUCT<identifier: STRING, datestamp: STRING, _status: STRING>,
metadata STRUCT<arXiv: STRUCT<id: STRING, created: STRING, updated: STRING, title: STRING, categories: STRING, comments: STRING, `report-no`: STRING, `journal-ref`: STRING, `msc-class`: STRING, `acm-class`: STRING,
doi: STRING, abstract: STRING, authors: STRUCT<author: ARRAY<STRUCT<keyname: STRING, forenames: STRING>>>>>
"""
#: Dublin Core elements and the raw table's columns.
CORE = {"creator": "author", "title": "title", "description": "description", "contributor": "contributor", "coverage": "coverage", "date": "dates", "format": "formats", "language": "languages", "publisher": "publisher", "relation": "relation", "rights": "rights", "source": "sources", "subject": "subjects", "type": "type"}
CORE_LISTS = {"creator", "date", "subject", "contributor", "relation", "source", "format", "language"}


CORE_XML = f"header STRUCT<identifier: STRING, datestamp: STRING, _status: STRING>, metadata STRUCT<dc: STRUCT<{', '.join(f'`{k}`: ARRAY<STRING>' for k in CORE)}>>"


def is_empty(page: str) -> bool:
    """Whether a response says that no record matches; other errors are raised."""
    error = re.search(r"<error\s[^>]*code=[\"'](\w+)[\"']", page)
    if error and error[1] != "noRecordsMatch":
        raise ValueError(f"the feed answers {error[1]}")
    return error is not None


def following(page: str) -> dict[str, str] | None:
    """The request for the page after this one; None after the last."""
    token = re.search(r"<resumptionToken[^>]*>\s*([^<\s][^<]*?)\s*</resumptionToken>", page)
    return {"verb": "ListRecords", "resumptionToken": html.unescape(token[1])} if token else None


class Feed:
    """A feed's ListRecords pages: ``fetch`` gives the response to a request's
    parameters as text. Pages follow each other by resumption token."""

    def __init__(self, fetch: Callable[[dict[str, str]], str], prefix: str = "oai_dc") -> None:
        self.fetch, self.prefix = fetch, prefix

    def pages(self, start: str | None = None, end: str | None = None, limit: int | None = None) -> Iterator[str]:
        """Pages of records from ``start`` until ``end`` (dates, both included),
        until ``limit`` records or more have come; none if no record matches."""
        if limit is not None and limit < 1:
            raise ValueError("limit must be 1 or more")
        asked, n = {"verb": "ListRecords", "metadataPrefix": self.prefix, **{k: v for k, v in (("from", start), ("until", end)) if v}}, 0
        while True:
            page = self.fetch(asked)
            if is_empty(page):
                return
            yield page
            n += len(re.findall(r"<record[\s>]", page))
            asked = following(page)
            if asked is None or limit is not None and n >= limit:
                return

    def save(self, spark: SparkSession, folder: str, start: str | None = None, end: str | None = None, limit: int | None = None) -> int:
        """Write the pages to a folder, a file each, and say how many there were."""
        n = 0
        for n, page in enumerate(self.pages(start, end, limit), 1):
            spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("append").text(folder)
        return n


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.orderBy("identifier").limit(limit)


def read_core(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Dublin Core records in the raw table's shape: lists as ``a;b;``, other
    elements as their last value; deleted records left out. ``limit`` takes the
    first so many by identifier."""
    raw = spark.read.format("xml").option("rowTag", "record").option("attributePrefix", "_").option("ignoreNamespace", "true").schema(CORE_XML).load(path)
    m = F.col("metadata.dc")
    rows = raw.where(m.isNotNull() & F.col("header.identifier").isNotNull() & ~F.col("header._status").eqNullSafe("deleted"))
    some = lambda k: F.filter(F.transform(m[k], lambda v: F.trim(v)), lambda v: v != "")
    cols = {v: join_list(some(k)) if k in CORE_LISTS else F.try_element_at(some(k), F.lit(-1)) for k, v in CORE.items()}
    rows = rows.select(F.trim("header.identifier").alias("identifier"), *[c.alias(k) for k, c in cols.items()], F.current_timestamp().alias("last_updated"), F.lit(None).cast("timestamp").alias("last_harvested"))
    return _first(rows.select(*[F.col(f.name).cast(f.dataType) for f in RAW_OAI.fields]), limit)


def read_preprints(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Preprint records in the raw table's shape; records without metadata left
    out. Authors as ``keyname,forenames;``; a keyname of ``;`` alone is dropped."""
    raw = spark.read.format("xml").option("rowTag", "record").option("attributePrefix", "_").option("ignoreNamespace", "true").schema(PREPRINT_XML).load(path)
    m = F.col("metadata.arXiv")
    rows = raw.where(m.isNotNull() & m["id"].isNotNull() & ~F.col("header._status").eqNullSafe("deleted"))
    named = F.filter(m["authors"]["author"], lambda a: F.trim(a["keyname"]) != ";")
    entry = F.transform(named, lambda a: F.when(F.trim(F.coalesce(a["forenames"], F.lit(""))) == "", F.trim(a["keyname"])).otherwise(F.concat(F.trim(a["keyname"]), F.lit(","), F.trim(a["forenames"]))))
    none = F.lit(None).cast("timestamp")
    rows = rows.select(
        F.trim(m["id"]).alias("identifier"), parse_mdate(m["created"]).alias("created"), parse_mdate(m["updated"]).alias("updated"), join_list(entry).alias("author"), F.trim(F.regexp_replace(m["title"], r"\s+", " ")).alias("title"),
        m["msc-class"].alias("mscclass"), m["acm-class"].alias("acmclass"), m["report-no"].alias("reportno"), m["journal-ref"].alias("journalref"), m["comments"].alias("comments"), F.trim(m["abstract"]).alias("description"),
        m["categories"].alias("categories"), m["doi"].alias("doi"), parse_mdate(F.col("header.datestamp")).alias("mdate"), F.current_timestamp().alias("last_updated"), none.alias("last_harvested"), none.alias("last_referenced"),
    )
    return _first(rows.select(*[F.col(f.name).cast(f.dataType) for f in RAW_PREPRINT.fields]), limit)
