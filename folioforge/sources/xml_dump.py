"""Bibliography dumps: XML files with one tag for each kind of record."""

from __future__ import annotations

import html.entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import without_tags
from ..functions.values import parse_mdate, parse_year
from ..schemas import DUMP_FIELDS, DUMP_TAGS, DUMP_XML, RAW_DUMP
from ..storage import written


def expand_entities(xml: str | None) -> str | None:
    """Named entities of a document type as characters, XML's own ones kept, and
    unknown ones as their name. Spark's reader does not load document type
    definitions."""
    keep = {"amp", "lt", "gt", "quot", "apos"}
    known = html.entities.name2codepoint
    return None if xml is None else re.sub(r"&(\w+);", lambda m: m[0] if m[1] in keep else chr(known[m[1]]) if m[1] in known else m[1], xml)


SCANNED = "path string, block long, kind string, tag string, xml string"


def _cut(tags: list[str]):
    """A function on batches of a split's pieces, in order, that gives its records
    whole, the end of one that an earlier split began, and the begin of one that a
    later split ends."""
    whole = re.compile(rf"<({'|'.join(tags)})(?=[\s/>])(?:[^>]*/>|.*?</\1\s*>)", re.DOTALL)
    begin = re.compile(rf"<(?:{'|'.join(tags)})(?=[\s/>])")
    end = re.compile(rf"</(?:{'|'.join(tags)})\s*>")

    def head(text: str) -> str:
        """What may end a record of an earlier split."""
        first, close = begin.search(text), end.search(text)
        return text[: close.end()] if close and (first is None or close.start() < first.start()) else text[: first.start()] if first else text

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rest, pending = None, "", False  # pending: no record has begun in this split yet
        for batch in batches:
            out = []
            for (path, block), pieces in batch.groupby(["path", "block"], sort=False)["value"]:
                if (path, block) != at:
                    if at and rest:
                        out.append((*at, "head" if pending else "tail", None, rest))
                    at, rest, pending = (path, block), "", True
                text, done = rest + "".join(v + ">" for v in pieces), 0
                if pending and (begin.search(text) or end.search(text)):
                    done = len(head(text))
                    out.append((*at, "head", None, text[:done]))
                    pending = False
                for m in whole.finditer(text, done):
                    out.append((*at, "record", m[1], expand_entities(m[0])))
                    done = m.end()
                left = None if pending else begin.search(text, done)
                rest = text if pending else text[left.start() :] if left else ""
            yield pd.DataFrame(out, columns=["path", "block", "kind", "tag", "xml"])
        if at and rest:
            yield pd.DataFrame([(*at, "head" if pending else "tail", None, rest)], columns=["path", "block", "kind", "tag", "xml"])

    return scan


def scan_records(spark: SparkSession, path: str, tags: list[str] | None = None) -> DataFrame:
    """(tag, xml): the elements of all tags, from one pass over the files.

    Files are read in splits, as pieces between closing brackets, so that neither
    long lines nor large files meet one task. A record that a split cuts is put
    together from the end of its first split, the splits it fills and the begin of
    its last. Named entities are expanded. A record inside another is its part.
    """
    known = list(dict.fromkeys([*DUMP_TAGS, *(tags or [])]))  # all, so that a split's first record is soon found
    pieces = spark.read.option("lineSep", ">").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    scanned = written(pieces.mapInPandas(_cut(known), SCANNED), "dump")
    order = W.partitionBy("path").orderBy("block", F.col("kind") == "tail")
    # Every tail opens a group; heads after it belong to it until a split has another tail.
    parts = scanned.where("kind <> 'record'").withColumn("group", F.count(F.when(F.col("kind") == "tail", 1)).over(order)).where("group > 0")
    joined = parts.groupBy("path", "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", (F.col("kind") == "head").alias("later"), "xml"))), lambda p: p["xml"]), "").alias("text"))
    cut = joined.select("path", F.col("group").alias("block"), F.expr("substr(text, 1, length(text) - 1)").alias("value"))
    stitched = cut.mapInPandas(_stitch(_cut(known)), SCANNED)
    found = scanned.unionByName(stitched).where("kind = 'record'")
    return found.where(F.col("tag").isin(tags or DUMP_TAGS)).select("tag", "xml")


def _stitch(scan):
    """The records of texts that begin with one."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from scan(iter([batch]))

    return each


def read_records(spark: SparkSession, path: str, tags: list[str] | None = None) -> DataFrame:
    """Raw elements of the given tags with their kind; every child as an array. The
    files are read once. Records that cannot be parsed have no key."""
    raw = scan_records(spark, path, tags).select(F.from_xml("xml", DUMP_XML, {"attributePrefix": "_", "mode": "PERMISSIVE"}).alias("r"), F.col("tag").alias("type"))
    return raw.select(*[F.col(f"r.{f.name}").alias(f.name) for f in DUMP_XML.fields], "type")


def last(c: str) -> Column:
    """Of repeated children the last, trimmed; null if empty."""
    v = F.trim(F.try_element_at(F.col(c), F.lit(-1)))
    return F.when(v != "", v)


def parse_records(raw: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Valid records in the raw table's shape.

    Records with an unreadable date or one outside [start, end], an unreadable
    year, no author or no title are left out.
    """
    title = F.trim(without_tags(F.try_element_at("title", F.lit(-1))))
    rows = raw.select(
        F.col("_key").alias("dblp_key"), parse_mdate("_mdate").alias("mdate"), F.filter("author", lambda a: F.trim(a) != "").alias("authors"), title.alias("title"), "type",
        parse_year(F.when(last("year").isNotNull(), last("year"))).alias("pub_year"), last("year").alias("_year"), *[last(f).alias({"number": "journal_number"}.get(f, f)) for f in DUMP_FIELDS if f != "year"],
    )
    rows = rows.where(F.col("mdate").isNotNull() & in_range("mdate", start, end))
    rows = rows.where((F.col("_year").isNull() | F.col("pub_year").isNotNull()) & (F.size("authors") > 0) & (F.coalesce("title", F.lit("")) != ""))
    rows = rows.withColumn("author", F.concat(F.array_join(F.transform("authors", lambda a: F.trim(a)), ";"), F.lit(";")))
    none = F.lit(None).cast("timestamp")
    rows = rows.withColumns({"last_updated": F.current_timestamp(), "last_harvested": none})
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in RAW_DUMP.fields])


def with_title(rows: DataFrame, default: str = "Test") -> DataFrame:
    """Raw rows with a title where it is null."""
    return rows.withColumn("title", F.coalesce("title", F.lit(default)))


def in_range(c: str, start: str | None, end: str | None) -> Column:
    """Closed range; a missing bound is open."""
    v = F.col(c)
    return (F.lit(True) if start is None else v >= F.lit(start).cast("date")) & (F.lit(True) if end is None else v <= F.lit(end).cast("date"))


def harvest(spark: SparkSession, path: str, tags: list[str] | None = None, start: str | None = None, end: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, counts): counts has success and overall. A limit counts records
    in range, valid or not; 0 takes none."""
    raw = read_records(spark, path, tags)
    tried = raw.where(parse_mdate("_mdate").isNotNull() & F.coalesce(in_date(raw, start, end), F.lit(False)))
    if limit is not None:
        tried = tried.orderBy("type", "_key").limit(limit)
    good = parse_records(tried, start, end)
    counts = tried.agg(F.count(F.lit(1)).alias("overall")).join(good.agg(F.count(F.lit(1)).alias("success")))
    return good, counts.select("success", "overall")


def in_date(raw: DataFrame, start: str | None, end: str | None) -> Column:
    d = parse_mdate("_mdate")
    return (F.lit(True) if start is None else d >= F.lit(start).cast("date")) & (F.lit(True) if end is None else d <= F.lit(end).cast("date"))
