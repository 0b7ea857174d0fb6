"""Incremental harvesting: windows of a schedule, and streams of new files."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.upsert import VERSION, latest_per_key, newest

#: Days of a harvest window.
CADENCES = {"all": None, "monthly": 30, "weekly": 7, "daily": 1}


@dataclass(frozen=True)
class Schedule:
    """A harvest window and how it moves on."""

    cadence: str
    min_date: dt.date | None = None
    max_date: dt.date | None = None
    start: dt.date | None = None
    end: dt.date | None = None
    enabled: bool = True
    limit: int | None = None

    def __post_init__(self) -> None:
        if self.cadence not in CADENCES:
            raise ValueError(f"cadence is one of {sorted(CADENCES)}")
        if self.cadence != "all" and self.min_date is None:
            raise ValueError("min_date is needed unless all is harvested at once")
        if self.min_date and self.max_date and self.max_date < self.min_date:
            raise ValueError("max_date is before min_date")
        if self.limit is not None and self.limit < 1:
            raise ValueError("limit is 1 or more")

    def first(self) -> Schedule:
        """With the first window, cut at max_date."""
        days = CADENCES[self.cadence]
        if days is None:
            return replace(self, start=self.min_date, end=self.max_date)
        return replace(self, start=self.min_date, end=self._cut(self.min_date + dt.timedelta(days=days)))

    def due(self, today: dt.date) -> bool:
        return self.enabled and (self.end is None or self.end <= today)

    def after_success(self) -> Schedule:
        """The next window: from the day after the last end. ``all`` is done."""
        days = CADENCES[self.cadence]
        if days is None:
            return replace(self, enabled=False)
        start = self._cut(self.end + dt.timedelta(days=1))
        return replace(self, start=start, end=self._cut(start + dt.timedelta(days=days)))

    def _cut(self, day: dt.date) -> dt.date:
        return min(day, self.max_date) if self.max_date else day


class Running:
    """Guard against overlapping runs of one schedule: whoever makes the mark of
    ``name`` under ``path`` first has the schedule until the end of its block. A
    mark left by a run that was killed is taken over after ``stale`` seconds."""

    def __init__(self, spark: SparkSession, path: str, name: str, stale: float = 86_400.0) -> None:
        jvm = spark.sparkContext._jvm
        self.folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.running")
        self.mark = jvm.org.apache.hadoop.fs.Path(self.folder, "mark")
        self.fs = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.stale, self.held = stale, False

    def __enter__(self) -> bool:
        """Whether this run has the schedule."""
        self.fs.mkdirs(self.folder)
        if self.fs.exists(self.mark) and time.time() - self.fs.getFileStatus(self.mark).getModificationTime() / 1000 > self.stale:
            self.fs.delete(self.mark, False)
        try:
            self.fs.create(self.mark, False).close()  # fails where it exists
            self.held = True
        except Py4JJavaError:
            self.held = False
        return self.held

    def __exit__(self, *_) -> None:
        if self.held:
            self.fs.delete(self.folder, True)


def in_window(df: DataFrame, column: str, schedule: Schedule) -> DataFrame:
    c = F.to_date(column)
    if schedule.start:
        df = df.where(c >= F.lit(schedule.start))
    return df.where(c <= F.lit(schedule.end)) if schedule.end else df


def upsert_stream(spark: SparkSession, source: str, schema: StructType, target: str, keys: list[str], order: list[Column], checkpoint: str) -> StreamingQuery:
    """Append the changes of new files to a table's log, exactly once.

    Each batch writes its latest row of each key to ``target/version_no=<batch id>`` and
    nothing else; a batch that is run again writes the same folder again. Read the
    table with ``current``.
    """
    raw = spark.readStream.schema(schema).parquet(source)

    def merge(batch: DataFrame, n: int) -> None:
        latest_per_key(batch, keys, order).write.mode("overwrite").parquet(f"{target}/{VERSION}={n}")

    return raw.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, schema: StructType, target: str, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """The table of a log, see operators.upsert.newest."""
    rows = spark.read.schema(StructType([*schema.fields, StructField(VERSION, LongType())])).parquet(target)
    return newest(rows, schema.names, keys, keep)


def compact(spark: SparkSession, schema: StructType, target: str, keys: list[str], to: str, keep: list[str] = ()) -> int:
    """Write the table of a log to another folder as its first version, from which a
    log goes on with later ones; the number of the last version in it. The log
    itself stays until its readers have moved."""
    last = spark.read.parquet(target).agg(F.max(VERSION)).first()[0]
    current(spark, schema, target, keys, keep).write.mode("overwrite").parquet(f"{to}/{VERSION}={last}")
    return last


def ingest_stream(spark: SparkSession, source: str, schema: StructType, to_batch: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
    """Any batch function over new files, once each, with a checkpoint as the mark of what was harvested."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return raw.writeStream.foreachBatch(to_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "7 days", value: str | None = None) -> DataFrame:
    """Counts by tumbling window and type, and sums of ``value`` if given; on a
    stream, rows later than ``late`` are left out."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark(time, late)
    sums = [F.sum(value).alias("total")] if value else []
    return e.groupBy(F.window(time, width).alias("window"), "event_type").agg(F.count(F.lit(1)).alias("n"), *sums)


def new_keys(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """First rows of each key; a stream forgets keys after ``late``."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)
