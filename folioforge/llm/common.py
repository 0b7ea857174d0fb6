"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is missing and Spark
    runs in a single process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="folioforge-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def _clean() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            pass


atexit.register(_clean)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without running
    the steps before it again. The tables go when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioforge-{uuid.uuid4().hex}/{name}"
    _made.append((spark, path.rpartition("/")[0]))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, schema: str, fn: Callable[[list[list]], list]) -> DataFrame:
    """Map Arrow batches: fn gets one Python list per column of df and returns
    one list or array per column of ``schema``. State is per batch, so any lost
    task can be run again."""
    from pyspark.sql.types import _parse_datatype_string  # noqa: PLC0415
    from pyspark.sql.pandas.types import to_arrow_schema  # noqa: PLC0415

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                cols = fn([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def by_bytes(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row slices of about ``limit`` bytes, so that very long
    texts do not gather in one Python list."""
    if batch.num_rows < 2 or batch.nbytes <= limit:
        yield batch
        return
    step = max(1, int(batch.num_rows * limit / batch.nbytes))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


class Numbers(dict):
    """Numbers of words in the order in which they come; ``new`` has the latest."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def of(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """The words' numbers, in order, and which words are new."""
        numbers = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        new, self.new = self.new, []
        return numbers, new


def sorted_runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple[int, int, list[np.ndarray]]]]:
    """From batches sorted by their first n_keys integer columns, yield lists of
    (start, end, columns) for runs of equal keys with two rows or more.

    A run that goes on in the next batch is carried over, so runs are whole.
    """
    held: list[list[np.ndarray]] = []
    cols: list[np.ndarray] = []

    def runs(cols: list[np.ndarray], upto: int, starts: np.ndarray) -> list:
        ends = np.append(starts[1:], upto)
        keep = np.flatnonzero((ends - starts > 1) & (ends <= upto))
        return [(int(starts[i]), int(ends[i]), cols) for i in keep]

    for batch in batches:
        if not batch.num_rows:
            continue
        new = [column_array(c) for c in batch.columns]
        if held and all(held[-1][k][-1] == new[k][0] == new[k][-1] for k in range(n_keys)):
            held.append(new)  # one run goes through the whole batch
            continue
        cols = [np.concatenate([h[i] for h in held] + [new[i]]) for i in range(len(new))] if held else new
        change = np.zeros(len(cols[0]), dtype=bool)
        change[0] = True
        for k in range(n_keys):
            change[1:] |= cols[k][1:] != cols[k][:-1]
        starts = np.flatnonzero(change)
        last = int(starts[-1])
        if out := runs(cols, last, starts[:-1]):
            yield out
        held = [[c[last:] for c in cols]]
    if held:
        cols = [np.concatenate([h[i] for h in held]) for i in range(len(held[0]))]
        if len(cols[0]) > 1:
            yield [(0, len(cols[0]), cols)]


def column_array(col: pa.Array) -> np.ndarray:
    """A numpy array of a column; lists of equal length become a matrix."""
    if pa.types.is_list(col.type):
        flat = col.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(col), -1)
    return col.to_numpy(zero_copy_only=False)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n indexes over the edges a-b."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt
    return label


def takes_part(vec: str) -> Column:
    """Whether a vector has entries, all of them finite and one not zero; never null."""
    x = F.col(vec)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def finite_vectors(df: DataFrame, vec: str) -> DataFrame:
    """Only rows whose vector takes part."""
    return df.where(takes_part(vec))
