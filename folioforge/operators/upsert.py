"""Upserts and insert-if-absent as joins and aggregates of whole batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written


#: Partition column of a log; tables must not have one of that name.
VERSION = "version_no"


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key. An aggregate, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Insert-ignore: the first row of each key stays."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = (), stamp: dict[str, Column] | None = None) -> DataFrame:
    """old with new merged by key. Columns in ``keep`` stay as they are in old
    rows; ``stamp`` sets columns of new and updated rows. New has one row per
    key (see latest_per_key)."""
    rest = [c for c in old.columns if c not in keys]
    stamp = stamp or {}
    mark = F.lit(True).alias("_there")
    o = old.select(*keys, F.struct(*rest).alias("_old"), mark)
    n = new.select(*keys, F.struct(*[stamp.get(c, F.col(c) if c in new.columns else F.lit(None)).alias(c) for c in rest]).alias("_new"), F.lit(True).alias("_fresh"))
    both = o.join(n, keys, "full_outer")
    pick = lambda c: F.when(F.col("_fresh").isNull() | (F.lit(c in keep) & F.col("_there").isNotNull()), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}"))
    return both.select(*keys, *[pick(c).cast(old.schema[c].dataType).alias(c) for c in rest])


def newest(log: DataFrame, names: list[str], keys: list[str], keep: list[str] = ()) -> DataFrame:
    """The table of a log of versions: each key's latest row, but its first values
    of ``keep``. Versions before a key's latest are combined before the shuffle."""
    new = [c for c in names if c not in keys and c not in keep]
    parts = [F.max_by(F.struct(*new), VERSION).alias("new")] if new else []
    parts += [F.min_by(F.struct(*keep), VERSION).alias("old")] if keep else []
    found = log.groupBy(*keys).agg(*parts) if parts else log.select(*keys).distinct()
    of = {**dict.fromkeys(new, "new"), **dict.fromkeys(keep, "old")}
    return found.select(*[F.col(of[c])[c].alias(c) if c in of else F.col(c) for c in names])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """get-or-create: new rows whose key old lacks, once per key."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def mark_harvested(rows: DataFrame, done: DataFrame, keys: list[str], at: Column, column: str = "last_harvested") -> DataFrame:
    """rows with ``column`` set where the key is in done."""
    hit = done.select(*keys).distinct().withColumn("_done", F.lit(True))
    return rows.join(hit, keys, "left").withColumn(column, F.when(F.col("_done"), at).otherwise(F.col(column))).select(*rows.columns)


def numbered(rows: DataFrame, keys: list[str], start: int = 0, name: str = "id") -> DataFrame:
    """Deterministic ids from the natural key, without a global sort."""
    return rows.withColumn(name, F.xxhash64(*keys) + start)


def running_index(rows: DataFrame, partition: list[str], order: list[Column], step: int = 500) -> DataFrame:
    """Bucket of every ``step`` rows of a partition, in order; rows of equal order are
    told apart by a hash of all their columns.

    No task sorts a whole partition: rows are dealt to ranges of (partition, order),
    counted by range, and numbered in their range from the counts before it. The
    ranges are a written table, so that they stay as they were counted.
    """
    order = [*order, F.xxhash64(*rows.columns)]
    names = [f"__o{i}" for i in range(len(order))]
    keyed = rows.withColumns(dict(zip(names, order, strict=True)))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(keyed.repartitionByRange(n, *partition, *names).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*partition, "__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*partition).orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(partition)], F.col("__range").alias("__r"), F.coalesce(before, F.lit(0)).alias("__before"))
    same = [F.col(c).eqNullSafe(F.col(f"__p{i}")) for i, c in enumerate(partition)]
    numbered_ = dealt.withColumn("__i", F.row_number().over(W.partitionBy("__range", *partition).orderBy(*names)))
    numbered_ = numbered_.join(counts, [F.col("__range") == F.col("__r"), *same])
    return numbered_.select(*rows.columns, (F.floor((F.col("__before") + F.col("__i") - 1) / step) * step).alias("bucket"))


def times_by_bucket(rows: DataFrame, partition: list[str], order: list[Column], seconds: str, step: int = 500) -> DataFrame:
    """(partition, bucket, n, seconds): how many rows each bucket of a partition
    has and how long they took together."""
    return running_index(rows, partition, order, step).groupBy(*partition, "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(seconds).alias(seconds))
