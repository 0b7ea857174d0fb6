"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where it is unset and
    Spark is a single process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    for spark, path in _made:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            pass


atexit.register(_clean)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the driver exits."""
    folder = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    _made.append((spark, folder))
    return f"{folder}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later steps do not run it again. The
    tables go when the driver exits."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def claim(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file that must not exist yet; False where another writer was first.
    Atomic where the file system's create is (HDFS and local disks)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    return True


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none where it is missing."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
