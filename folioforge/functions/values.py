"""Dates, numbers, bit sets and encodings as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_mdate(c: Column | str) -> Column:
    """A ``y-m-d`` date with one or two digits for month and day; null if none."""
    return F.try_to_date(c, "y-M-d")


def parse_year(c: Column | str) -> Column:
    """January 1 of a year from 1 to 9999; null if none."""
    y = (F.col(c) if isinstance(c, str) else c).try_cast("int")
    return F.when(y.between(1, 9999), F.make_date(y, F.lit(1), F.lit(1)))


def parse_date_or_year(c: Column | str) -> Column:
    return F.coalesce(F.try_to_date(c, "y-M-d"), parse_year(c))


def year_date(c: Column | str) -> Column:
    """January 1 of an integer year, null-safe."""
    return F.when((F.col(c) if isinstance(c, str) else c).between(1, 9999), F.make_date(c, F.lit(1), F.lit(1)))


def node_time(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def parse_node_time(c: Column | str) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))


def from_hex(c: Column | str) -> Column:
    return F.conv(c, 16, 10).cast("bigint")


def to_hex8(c: Column | str) -> Column:
    return F.lpad(F.hex(c), 8, "0")


def bit(index: Column | str) -> Column:
    """The bit of a source; indexes beyond 62 are refused."""
    i = F.col(index) if isinstance(index, str) else index
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))
    return F.when(i.between(0, 62), one).otherwise(F.raise_error(F.lit("more than 63 sources in one record")).cast("bigint"))


def bit_indexes(bits: Column | str) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.getbit(bits, i) == 1)
