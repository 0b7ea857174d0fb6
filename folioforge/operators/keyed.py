"""Tables of one row per key that grow by upserts without shuffling what is there.

A table is a log of versions, each dealt to the same buckets by key. An upsert
writes its own rows and reads none; the rows as they stand are grouped bucket by
bucket, and joins on the key start from the buckets, so neither has an exchange on
the table's side.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import claim, names_in
from .upsert import VERSION, newest


class KeyedTable:
    """A table at a path, made where there is none; every session names its keys,
    columns and buckets, which must be those that it was made with.

    A null key is a key like others. Values of ``keep`` are those of a key's first
    version. Numbers of versions are claimed before they are written: of two writers
    the one with the later number has the last word, and a write that breaks off
    leaves a number without rows. A bucket is a task's, so choose their number for
    the table that is to come; a key has one row a version.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], buckets: int = 64, keep: list[str] = (), name: str | None = None) -> None:
        self.spark, self.path, self.keys, self.keep, self.buckets = spark, path.rstrip("/"), list(keys), list(keep), buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        lacking = {*self.keys, *self.keep} - {*self.schema.names}
        if not self.keys or lacking or VERSION in self.schema.names:
            raise ValueError(f"keys and kept columns must be columns, and none is named {VERSION}; lacking: {sorted(lacking)}")
        made = json.dumps([self.keys, buckets, self.schema.jsonValue()])
        if not claim(spark, f"{self.path}/_keyed/table.json", made) and spark.read.text(f"{self.path}/_keyed/table.json", wholetext=True).first()[0] != made:
            raise ValueError(f"the table at {path} has other keys, columns or buckets")
        self.name = name or "keyed_" + hashlib.md5(self.path.encode()).hexdigest()
        by = ", ".join(f"`{k}`" for k in self.keys)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({self.schema.toDDL()}, {VERSION} BIGINT) USING parquet PARTITIONED BY ({VERSION}) CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{self.path}'")
        self.refresh()

    def refresh(self) -> None:
        """See the versions that others wrote."""
        self.spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")
        self.spark.catalog.refreshTable(self.name)

    def upsert(self, new: DataFrame, stamp: dict[str, Column] | None = None, version: int | None = None) -> int:
        """Write rows, one for each key, as the next version, and its number. Columns
        that new lacks are null; ``stamp`` sets columns. A given version is written
        over, as a stream's batch that is run again needs it."""
        number = self._next() if version is None else version
        stamp = stamp or {}
        cols = [stamp.get(f.name, F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]
        self._write(new.select(*cols).repartition(self.buckets, *self.keys), number)
        return number

    def _next(self) -> int:
        taken = [int(n) for n in names_in(self.spark, f"{self.path}/_versions")]
        written = [int(n.split("=")[1]) for n in names_in(self.spark, self.path) if n.startswith(f"{VERSION}=")]
        number = max([-1, *taken, *written]) + 1
        while not claim(self.spark, f"{self.path}/_versions/{number}", ""):
            number += 1
        return number

    def _write(self, rows: DataFrame, number: int) -> None:
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION ({VERSION} = {number}) SELECT * FROM {{rows}}", rows=rows)

    def versions(self) -> DataFrame:
        return self.spark.table(self.name)

    def current(self) -> DataFrame:
        """The rows as they stand, dealt by key."""
        return newest(self.versions(), self.schema.names, self.keys, self.keep)

    def absent(self, new: DataFrame) -> DataFrame:
        """Rows of new whose key the table lacks. Only new is shuffled, and what has
        a null in its key: a join that is safe for nulls cannot start from buckets."""
        whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in self.keys])
        log = self.versions()
        rest = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in self.keys]
        found = new.where(whole).join(log.where(whole).select(*self.keys), self.keys, "left_anti")
        return found.select(*new.columns).unionByName(new.where(~whole).alias("n").join(log.where(~whole).select(*self.keys).alias("o"), rest, "left_anti"))

    def compact(self, to: str) -> KeyedTable:
        """The rows as they stand as the first version of a table at another path,
        bucket by bucket. This table stays until its readers have moved."""
        other = KeyedTable(self.spark, to, self.schema, self.keys, self.buckets, self.keep)
        other._write(self.current(), other._next())
        return other
