"""Schemas of raw tables, the canonical record and the integrated store."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


#: Record tags of a bibliography dump.
DUMP_TAGS = ["article", "inproceedings", "proceedings", "book", "incollection", "phdthesis", "mastersthesis", "www", "person", "data"]

#: Child elements of a record.
DUMP_FIELDS = ["pages", "year", "volume", "journal", "number", "ee", "url", "cite", "crossref", "booktitle", "school", "address", "publisher", "isbn", "series"]
#: As read: every child as an array, of which the last entry counts.
DUMP_XML = T.StructType([*_strings("_key", "_mdate"), *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("author", "title", *DUMP_FIELDS)]])

#: The columns of the raw tables.
RAW_DUMP = T.StructType(
    [
        *_strings("dblp_key"), T.StructField("mdate", T.DateType()), *_strings("author", "title", "pages"), T.StructField("pub_year", T.DateType()),
        *_strings("volume", "journal", "journal_number", "ee", "url", "cite", "crossref", "booktitle", "school", "address", "publisher", "isbn", "series", "type"),
        T.StructField("last_updated", T.TimestampType()), T.StructField("last_harvested", T.TimestampType()),
    ]
)

RAW_OAI = T.StructType(
    [
        *_strings("identifier", "author", "title", "description", "contributor", "coverage", "dates", "formats", "languages", "publisher", "relation", "rights", "sources", "subjects", "type"),
        T.StructField("last_updated", T.TimestampType()), T.StructField("last_harvested", T.TimestampType()),
    ]
)

RAW_PREPRINT = T.StructType(
    [
        *_strings("identifier"), T.StructField("created", T.DateType()), T.StructField("updated", T.DateType()),
        *_strings("author", "title", "mscclass", "acmclass", "reportno", "journalref", "comments", "description", "categories", "doi"), T.StructField("mdate", T.DateType()),
        *[T.StructField(n, T.TimestampType()) for n in ("last_updated", "last_harvested", "last_referenced")],
    ]
)

#: The fields of a canonical record.
PUBLICATION = T.StructType(
    [
        *_strings("title", "pages", "note", "doi", "abstract", "copyright"), T.StructField("date_added", T.IntegerType()), T.StructField("date_published", T.IntegerType()),
        *_strings("volume", "number", "type_ids"),
    ]
)
RELEASE = T.StructType(_strings("key", "series", "edition", "location", "publisher", "institution", "school", "address", "isbn", "howpublished", "book_title", "journal"))
AUTHOR = T.StructType(_strings("original_name", "parsed_name", "website", "contact", "about", "modified", "orcid_id"))
CANONICAL = T.StructType(
    [
        *_strings("local_url"), T.StructField("publication", PUBLICATION), T.StructField("pub_release", RELEASE), T.StructField("authors", T.ArrayType(AUTHOR)),
        T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("study_fields", T.ArrayType(T.StringType())),
    ]
)

#: Seed dimensions.
SEED_SOURCES = [(1, "publications"), (2, "users")]
SEED_TYPES = [(1, "article"), (2, "misc"), (3, "inproceedings"), (4, "mastersthesis"), (5, "phdthesis")]
