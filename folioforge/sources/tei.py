"""References from TEI documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dotted
from ..functions.values import year_date

PERSON = "STRUCT<forename: ARRAY<STRUCT<_VALUE: STRING, _type: STRING>>, surname: STRING>"
PART = f"STRUCT<title: ARRAY<STRUCT<_VALUE: STRING, _type: STRING, _level: STRING>>, author: ARRAY<STRUCT<persName: {PERSON}>>, imprint: STRUCT<date: ARRAY<STRUCT<_VALUE: STRING, _type: STRING, _when: STRING>>>>"
SCHEMA = f"analytic {PART}, monogr {PART}"


def _name(p: Column) -> Column:
    """All forenames of type ``first``, then all others, then the surname."""
    part = lambda first: F.array_join(F.transform(F.filter(p["forename"], lambda f: F.coalesce(f["_type"] == "first", F.lit(False)) == first), lambda f: dotted(F.trim(f["_VALUE"]))), " ")
    return F.array_join(F.filter(F.array(part(True), part(False), F.trim(p["surname"])), lambda x: x.isNotNull() & (x != "")), " ")


def _facts(c: Column) -> Column:
    """The last title and the last date count."""
    title = F.trim(F.element_at(F.filter(c["title"], lambda t: F.trim(t["_VALUE"]) != ""), -1)["_VALUE"])
    title = F.when(F.size(F.filter(c["title"], lambda t: F.trim(t["_VALUE"]) != "")) > 0, title)
    dates = c["imprint"]["date"]
    year = F.substring(F.when(F.size(dates) > 0, F.element_at(dates, -1)["_when"]), 1, 4).try_cast("int")
    people = F.transform(F.filter(c["author"], lambda a: a["persName"].isNotNull()), lambda a: _name(a["persName"]))
    return F.struct(title.alias("title"), year.alias("year"), people.alias("authors"))


def read_references(spark: SparkSession, path: str, source: int) -> DataFrame:
    """(source, title, date, authors, status, tries): one row per reference.

    The article's own part is preferred to the volume's, its year falls back to
    the volume's; references without title or authors are left out. Each
    element is read by itself.
    """
    raw = spark.read.format("xml").option("rowTag", "biblStruct").option("attributePrefix", "_").option("valueTag", "_VALUE").schema(SCHEMA).load(path)
    a, m = _facts(F.col("analytic")), _facts(F.col("monogr"))
    rows = raw.select(F.when(F.col("analytic").isNotNull(), a).otherwise(m).alias("x"), m["year"].alias("volume_year"))
    rows = rows.select(F.lit(source).cast("long").alias("source"), "x.title", year_date(F.coalesce("x.year", "volume_year")).alias("date"), F.array_join("x.authors", ";").alias("authors"), F.lit("OP").alias("status"), F.lit(0).alias("tries"))
    return rows.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("authors", F.lit("")) != ""))
