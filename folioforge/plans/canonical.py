"""Raw tables to the canonical record, one function for each source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_authors, strip_years
from ..functions.values import parse_date_or_year
from ..schemas import AUTHOR, CANONICAL, PUBLICATION, RELEASE


def _struct(schema, **known: Column) -> Column:
    return F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def _authors(c: str) -> Column:
    return F.transform(split_authors(c), lambda a: _struct(AUTHOR, original_name=a, parsed_name=strip_years(a)))


def _some(c: str) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))


def _row(df: DataFrame, url: Column, publication: Column, release: Column, authors: Column, keywords: Column | None = None, fields: Column | None = None) -> DataFrame:
    cols = {"local_url": url, "publication": publication, "pub_release": release, "authors": authors, "keywords": F.coalesce(keywords, F.array()) if keywords is not None else F.array(), "study_fields": F.coalesce(fields, F.array()) if fields is not None else F.array()}
    return df.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in CANONICAL.fields])


def from_dump(df: DataFrame, added: Column | None = None) -> DataFrame:
    """The medium's key is the school of a thesis, the book of a conference
    paper, the journal of an article."""
    t = F.col("type")
    key = F.when(t.isin("phdthesis", "mastersthesis"), _some("school")).when(t == "inproceedings", _some("booktitle")).when(t == "article", _some("journal"))
    pub = _struct(PUBLICATION, title=F.col("title"), pages=F.col("pages"), volume=F.col("volume"), number=F.col("journal_number"), date_published=F.year("pub_year"), type_ids=t, date_added=added if added is not None else F.lit(None))
    rel = _struct(RELEASE, key=key, series=F.col("series"), publisher=F.col("publisher"), school=F.col("school"), address=F.col("address"), isbn=F.col("isbn"), book_title=F.col("booktitle"), journal=F.col("journal"))
    return _row(df, F.col("dblp_key"), pub, rel, _authors("author"))


def from_dump_again(df: DataFrame) -> DataFrame:
    """Records harvested before, under new keys."""
    again = df.where("last_harvested is not null").withColumn("dblp_key", F.concat(F.lit("XX"), "dblp_key"))
    return from_dump(again, F.year("last_harvested"))


def from_preprints(df: DataFrame) -> DataFrame:
    pub = _struct(PUBLICATION, title=F.col("title"), doi=F.col("doi"), note=F.col("comments"), abstract=F.col("description"), date_published=F.year("created"), type_ids=F.lit("misc"))
    return _row(df, F.col("identifier"), pub, _struct(RELEASE), _authors("author"), fields=F.array_compact(F.array("categories")))


def from_core(df: DataFrame) -> DataFrame:
    """The year comes from the last date; a missing one leaves it null."""
    dates = F.split("dates", ";")
    year = F.year(parse_date_or_year(F.try_element_at(dates, F.lit(-2))))
    pub = _struct(PUBLICATION, title=F.col("title"), abstract=F.col("description"), copyright=F.col("rights"), date_published=year, type_ids=F.lit("misc"))
    rel = _struct(RELEASE, publisher=F.col("publisher"))
    return _row(df, F.replace("identifier", F.lit(";"), F.lit("")), pub, rel, _authors("author"), keywords=F.filter(split_authors("subjects"), lambda k: F.trim(k) != ""))


@dataclass(frozen=True)
class SourceMapping:
    """A pluggable source: its name and raw-to-canonical function."""

    name: str
    to_canonical: Callable[[DataFrame], DataFrame]
    domain: str = ""


REGISTRY: dict[str, SourceMapping] = {}


def register(mapping: SourceMapping) -> SourceMapping:
    REGISTRY[mapping.name] = mapping
    return mapping


register(SourceMapping("dump", from_dump, "dblp.uni-trier.de"))
register(SourceMapping("preprints", from_preprints, "arxiv.org"))
register(SourceMapping("core", from_core, "citeseerx.ist.psu.edu"))
