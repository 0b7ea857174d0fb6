"""References and the download queue as streams: state by bucket of keys, with timers.

Attempts arrive as files; what became of each key is appended to a log by batch, as
streaming.harvest.upsert_stream does, and read with ``current``. The state, its
timers and the log's batch number come from the same checkpoint: a batch that is
run again writes the same folder again. Rows of a batch count in order of time,
whole batches in order of arrival. Keys that are null are left out; a time that is
null counts as the first of all.

Rows of one key are combined in each piece of a file before the shuffle, and after it
folded piece by piece, so that a key may have any share of the rows; a task holds
what counts of one bucket's keys. Spark takes rows of a group one by one in Python;
so a bucket's rows of a piece go there packed as one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.upsert import latest_per_key
from ..plans.weave import BAD, FINISHED, INCOMPLETE, LIMIT, MAX_TRIES, MISSING, OPEN
from .harvest import VERSION, current

#: Attempts at a reference: how many clusters were found (null: none was made yet), and the least of them.
ATTEMPTS = "key long, n int, hit long, at timestamp"
#: What a reference's log holds; ``due``: it may be tried (again).
REFERENCES = "key long, status string, tries long, cluster_id long, at timestamp, due boolean"

#: Answers to requests (null: the source is put in the queue).
ANSWERS = "source string, http_status int, at timestamp"
#: What the queue's log holds; ``status`` is queued, successful or invalid.
QUEUE = "source string, status string, tries long, at timestamp, due boolean"

# Inside, times are microseconds and nothing is null: integers with nulls would become floats in pandas.
# Packed rows: key, n, hit, known and at; or source, queued, ended, end_status, skipped and last.
_NONE = -1  # no attempt, no answer
_NEVER, _BEFORE = 2**63 - 1, -(2**63)

#: Buckets that the keys are dealt to, whatever their number; with another number a
#: stream needs a new checkpoint.
BUCKETS = 1024
#: Rows that are combined at a time, at least, where there are as many.
PIECE = 1 << 17


def _batch(rows: pd.DataFrame) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(rows, preserve_index=False).replace_schema_metadata()


def _packed(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= PIECE:
            yield pd.concat(held)
            held = []
    if held:
        yield pd.concat(held)


def _packed_by_bucket(combine: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(bucket, rows): the combined rows of each bucket of a piece, without their bucket."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in _pieces(b for b in batches if len(b)):
            rows = combine(piece).sort_values("bucket", kind="stable")
            bucket, batch = rows["bucket"].to_numpy(), _batch(rows.drop(columns="bucket"))
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            sizes = np.diff(np.append(starts, len(bucket)))
            yield pd.DataFrame({"bucket": bucket[starts], "rows": [_packed(batch.slice(i, n)) for i, n in zip(starts.tolist(), sizes.tolist(), strict=True)]})

    return pack


def _unpacked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of packed ones, by PIECE at most or a packed one more."""
    held, n = [], 0
    for part in parts:
        for packed in part["rows"]:
            held.append(pa.ipc.open_stream(packed).read_all())
            n += held[-1].num_rows
            if n >= PIECE:
                yield pa.concat_tables(held).to_pandas()
                held, n = [], 0
    if held:
        yield pa.concat_tables(held).to_pandas()


class _Bucket(StatefulProcessor):
    """The keys of one bucket: their states as one table, and one timer at the
    earliest of their times. A key's own state costs several calls to the state
    store, a bucket's costs the same for all of its keys."""

    key: str
    #: A new key's state; ``due`` is when its wait ends, in milliseconds.
    first: dict

    def __init__(self, retry_seconds: int) -> None:
        self.wait = retry_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "rows binary, timer long")

    def _keep(self, rows: dict[str, np.ndarray], old: int | None) -> None:
        """A bucket's states, and its one timer at another time, or none. Deleting
        one that fired changes nothing."""
        new = int(rows["due"].min(initial=_NEVER))
        new = None if new == _NEVER else new
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
        self.state.update((_packed(_batch(pd.DataFrame(rows))), new))

    def _with(self, was: pd.DataFrame | None, keys: pd.Series) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """The columns of states and of first states for new keys, and which are new."""
        index = pd.Index(keys.unique())
        added = index if was is None else index.difference(pd.Index(was[self.key]), sort=False)
        more = pd.DataFrame({self.key: added.to_numpy(), **{c: np.full(len(added), v) for c, v in self.first.items()}})
        rows = more if was is None else pd.concat([was, more], ignore_index=True)
        return {c: rows[c].to_numpy(copy=True) for c in rows.columns}, np.arange(len(rows)) >= len(rows) - len(added)

    def _folded(self, parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
        """What counts of all rows. Folded once as many rows wait as were kept, so
        that a row is folded a few times, however many batches there are."""
        new, waiting, n = None, [], 0
        for part in parts:
            waiting.append(part)
            n += len(part)
            if new is None or n >= len(new):
                new, waiting, n = self.fold(pd.concat([*([] if new is None else [new]), *waiting])), [], 0
        return self.fold(pd.concat([new, *waiting])) if waiting else new

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = self._folded(_unpacked(rows))
        kept = self.state.get()
        states, changed = self.after(pa.ipc.open_stream(kept[0]).read_pandas() if kept else None, new)
        if changed.any():
            self._keep(states, kept[1] if kept else None)
            yield self.out(states, changed, self.due(states))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        packed, timer = self.state.get()
        rows = pa.ipc.open_stream(packed).read_pandas()
        states = {c: rows[c].to_numpy(copy=True) for c in rows.columns}
        over = states["due"] <= timerValues.getCurrentProcessingTimeInMs()
        states["due"][over] = _NEVER
        self._keep(states, timer)
        if over.any():
            yield self.out(states, over, np.ones(len(over), dtype=bool))

    def close(self) -> None:
        pass


class References(_Bucket):
    """The rules of weave.resolve_references for references. A try without a hit
    sets a time, at which the reference is due again."""

    key = "key"
    names = np.array([OPEN, INCOMPLETE, FINISHED, LIMIT], dtype=object)
    first = {"status": 0, "tries": 0, "hit": 0, "known": False, "at": _NEVER, "due": _NEVER}

    def fold(self, rows: pd.DataFrame) -> pd.DataFrame:
        return _first_of_keys(rows)

    def after(self, was: pd.DataFrame | None, new: pd.DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray]:
        s, fresh = self._with(was, new["key"])
        status, tries, at = s["status"], s["tries"], s["at"]
        new = new.assign(place=pd.Index(s["key"]).get_indexer(new["key"]))
        new = new[status[new["place"]] <= 1]  # what is closed stays
        made = new["n"] != _NONE
        attempts, tried = new[made], np.zeros(len(status), dtype=bool)
        tried[attempts["place"]] = True
        added = new[~made & fresh[new["place"]]]
        np.minimum.at(at, added["place"].to_numpy(), added["at"].to_numpy())
        rank = attempts.groupby("key").cumcount().to_numpy()
        for i in range(MAX_TRIES):
            r = attempts[rank == i]
            r = r[status[r["place"]] <= 1]
            p, n = r["place"].to_numpy(), r["n"].to_numpy()
            at[p] = r["at"]
            tries[p[n == 0]] += 1
            status[p] = np.select([n == 0, n == 1], [np.where(tries[p] < MAX_TRIES, 1, 3), 2], 3)
            hit = n == 1
            s["hit"][p[hit]], s["known"][p[hit]] = r["hit"].to_numpy()[hit], r["known"].to_numpy()[hit]
        s["due"][tried] = np.where(status[tried] == 1, at[tried] // 1000 + self.wait, _NEVER)
        return s, tried | fresh

    def due(self, s: dict[str, np.ndarray]) -> np.ndarray:
        return s["status"] == 0

    def out(self, s: dict[str, np.ndarray], some: np.ndarray, due: np.ndarray) -> pd.DataFrame:
        hit = pd.arrays.IntegerArray(s["hit"][some], ~s["known"][some])
        return pd.DataFrame({"key": s["key"][some], "status": self.names[s["status"][some]], "tries": s["tries"][some], "cluster_id": hit, "at": s["at"][some], "due": due[some]})


class Downloads(_Bucket):
    """The rules of weave.after_download for sources. The first answer that ends
    a request decides; refused requests count tries and set a time. A source that
    left stays away; answers for sources that were never queued change nothing."""

    key = "source"
    names = np.array(["queued", "successful", "invalid"], dtype=object)
    first = {"status": 0, "tries": 0, "at": _NEVER, "due": _NEVER}

    def fold(self, rows: pd.DataFrame) -> pd.DataFrame:
        return _summed_answers(rows)

    def after(self, was: pd.DataFrame | None, new: pd.DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray]:
        there = new["queued"] != _NEVER
        new = new[there if was is None else there | new["source"].isin(was["source"])]
        s, fresh = self._with(was, new["source"])
        status, at, changed = s["status"], s["at"], np.zeros(len(fresh), dtype=bool)
        new = new.assign(place=pd.Index(s["source"]).get_indexer(new["source"]))
        new = new[(status[new["place"]] == 0) & (fresh[new["place"]] | (new["ended"] != _NEVER) | (new["skipped"] > 0))]
        p, ended, skipped = new["place"].to_numpy(), (new["ended"] != _NEVER).to_numpy(), new["skipped"].to_numpy()
        status[p] = np.where(ended, np.where(new["end_status"] < BAD, 1, 2), 0)
        s["tries"][p] += np.where(ended, 0, skipped)
        at[p] = np.select([ended, skipped > 0], [new["ended"], new["last"]], new["queued"])
        s["due"][p] = np.where(~ended & (skipped > 0), at[p] // 1000 + self.wait, _NEVER)
        changed[p] = True
        return s, changed

    def due(self, s: dict[str, np.ndarray]) -> np.ndarray:
        return (s["status"] == 0) & (s["due"] == _NEVER)

    def out(self, s: dict[str, np.ndarray], some: np.ndarray, due: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"source": s["source"][some], "status": self.names[s["status"][some]], "tries": s["tries"][some], "at": s["at"][some], "due": due[some]})


def _first_of_keys(b: pd.DataFrame) -> pd.DataFrame:
    """Of each key the attempts that can count, in order, and one row that adds it."""
    made = (b["n"] != _NONE).to_numpy()
    order = np.lexsort([*(b[c].to_numpy() for c in ("hit", "n", "at")), made, b["key"].to_numpy()])
    key, made, place = b["key"].to_numpy()[order], made[order], np.arange(len(order))
    first = np.append(True, (key[1:] != key[:-1]) | (made[1:] != made[:-1]))[: len(order)]
    rank = place - np.maximum.accumulate(np.where(first, place, 0))
    return b.iloc[order[rank < np.where(made, MAX_TRIES, 1)]]


def _summed_answers(b: pd.DataFrame) -> pd.DataFrame:
    """One row for each source; before the shuffle with its bucket."""
    by = b.sort_values(["ended", "end_status"], kind="stable").groupby([c for c in ("bucket", "source") if c in b], as_index=False)
    return by.agg(queued=("queued", "min"), ended=("ended", "first"), end_status=("end_status", "first"), skipped=("skipped", "sum"), last=("last", "max"))


def _combined_answers(b: pd.DataFrame) -> pd.DataFrame:
    """One row for each source of a piece."""
    none = b["http_status"] == _NONE
    ends = ~none & ((b["http_status"] < BAD) | (b["http_status"] == MISSING))
    skips = ~none & ~ends
    return _summed_answers(b.assign(queued=b["at"].where(none, _NEVER), ended=b["at"].where(ends, _NEVER), end_status=b["http_status"].where(ends, _NONE), skipped=skips.astype("int64"), last=b["at"].where(skips, _BEFORE)))


def _session(spark: SparkSession) -> SparkSession:
    """A session whose state stores can hold timers; the caller's stays as it is."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def _run(spark: SparkSession, source: str, schema: str, given: list[Column], combine: Callable, processor: StatefulProcessor, out: str, target: str, checkpoint: str, every: str | None) -> StreamingQuery:
    own = _session(spark)
    if every is None:
        # Where a run ends with its files, timers wait for the next one's.
        own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    key = out.split()[0]
    at = F.coalesce(F.unix_micros("at"), F.lit(0)).alias("at")
    rows = own.readStream.schema(schema).parquet(source).where(F.col(key).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket"), key, *given, at)
    changes = rows.mapInPandas(_packed_by_bucket(combine), "bucket int, rows binary").groupBy("bucket").transformWithStateInPandas(processor, out.replace("timestamp", "long"), "Update", "ProcessingTime")
    changes = changes.withColumn("at", F.timestamp_micros("at"))

    def append(batch: DataFrame, n: int) -> None:
        order: list[Column] = [F.col("due")]  # a timer's row comes after the change that set it
        latest_per_key(batch, [key], order).write.mode("overwrite").parquet(f"{target}/{VERSION}={n}")

    writer = changes.writeStream.foreachBatch(append).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def reference_stream(spark: SparkSession, source: str, target: str, checkpoint: str, retry_seconds: int = 86_400, every: str | None = None) -> StreamingQuery:
    """Follow the ATTEMPTS that are written to ``source``; a reference without a hit
    is due again ``retry_seconds`` after its last attempt. Runs on every ``every``,
    or ends with the files that are there."""
    given = [F.coalesce("n", F.lit(_NONE)).alias("n"), F.coalesce("hit", F.lit(0)).cast("long").alias("hit"), F.col("hit").isNotNull().alias("known")]
    return _run(spark, source, ATTEMPTS, given, _first_of_keys, References(retry_seconds), REFERENCES, target, checkpoint, every)


def download_stream(spark: SparkSession, source: str, target: str, checkpoint: str, retry_seconds: int = 86_400, every: str | None = None) -> StreamingQuery:
    """Follow the ANSWERS that are written to ``source``, as reference_stream does."""
    given = [F.coalesce("http_status", F.lit(_NONE)).alias("http_status")]
    return _run(spark, source, ANSWERS, given, _combined_answers, Downloads(retry_seconds), QUEUE, target, checkpoint, every)


def references(spark: SparkSession, target: str) -> DataFrame:
    """The references of a log as they stand."""
    return current(spark, _schema(REFERENCES), target, ["key"])


def queue(spark: SparkSession, target: str) -> DataFrame:
    """The sources of a log as they stand."""
    return current(spark, _schema(QUEUE), target, ["source"])


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
