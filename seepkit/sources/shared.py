"""Tables in the folder that driver and executors share: they cut lineage, so a lost executor costs one step."""

from __future__ import annotations

import atexit
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Used only in local mode where the session names no checkpoint folder (tests, laptops).
LOCAL_DEFAULT = "/tmp/seepkit-checkpoints"
#: Staged tables that no one has discarded; they go when the driver's process ends.
_LEFT: set[str] = set()
_PLANNING: ContextVar[bool] = ContextVar("planning", default=False)


@contextmanager
def planning() -> Iterator[None]:
    """Within it nothing is staged: operators get the plan of a table instead, and 0 for its metrics, so that a
    dry run starts no job. Operators that need rounds give the plan of as many as that."""
    token = _PLANNING.set(True)
    try:
        yield
    finally:
        _PLANNING.reset(token)


def is_planning() -> bool:
    return _PLANNING.get()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        found = LOCAL_DEFAULT
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/seepkit-{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet, and read again."""
    return saved_with(df, name)[0]


def saved_with(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """As ``saved``, with aggregates over all rows that are taken while they are written: no second scan."""
    if _PLANNING.get():
        return df, defaultdict(int)
    path = new_path(df.sparkSession, name)
    if not _LEFT:
        atexit.register(clear_staged)
    _LEFT.add(path)
    found = write_observed(df, path, **metrics)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out, found


#: Spark's setting to remove a query's shuffle files when it ends, instead of when the driver's JVM has collected
#: their handles: what is written as a table is not read from its shuffles again.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _tidied(spark: SparkSession) -> Iterator[None]:
    was = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, was) if was in ("true", "false") else spark.conf.unset(TIDY)


def write_observed(df: DataFrame, path: str, **metrics: Column) -> dict:
    """Write ``df`` as Parquet and return the aggregates over the rows written."""
    seen = Observation()
    made = df.observe(seen, *(c.alias(k) for k, c in metrics.items())) if metrics else df
    with _tidied(df.sparkSession):
        made.write.mode("overwrite").parquet(path)
    return seen.get if metrics else {}


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that nothing will read again."""
    for t in tables:
        if path := getattr(t, "_staged", None):
            delete(t.sparkSession, path)
            _LEFT.discard(path)


def clear_staged() -> None:
    """Delete the saved tables that are left, those that results are read from included; done when the process
    ends, so write a result elsewhere to keep it."""
    gateway = SparkContext._gateway
    left, running = sorted(_LEFT), SparkContext._active_spark_context
    _LEFT.clear()
    if gateway is None:
        return
    try:
        conf = running._jsc.hadoopConfiguration() if running else gateway.jvm.org.apache.hadoop.conf.Configuration()
        for path in left:
            target = gateway.jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
    except Exception as e:  # the JVM may be gone before the process is
        print(f"staged tables are left in the shared folder: {e}")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, through Hadoop so that any file system works."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, complete or not there: written under another name first, then renamed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, part = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex[:12]}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} can't be written")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None if there is none."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return None
    found = fs.open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")
    finally:
        found.close()
