"""Session construction and shared-storage helpers."""

from __future__ import annotations

import atexit
import re
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job relies on: UTC wall clock, ANSI semantics, adaptive
# execution (partition coalescing, skew-join splitting, runtime broadcast).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "cinerank", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, as ``spark.checkpoint.dir`` names it.

    Where that is unset, a local session (one JVM, as in tests) gets a folder of
    its own application; on a cluster it must be set, as no machine's temporary
    folder is seen by the others.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d and not current.isEmpty():
        return current.get()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = f"{sc._jvm.java.lang.System.getProperty('java.io.tmpdir')}/cinerank-{sc.applicationId}"
    if current.isEmpty():
        sc.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table: in the shared folder, below a folder of
    this application, which `drop_intermediate` removes."""
    return f"{_own_folder(spark)}/{name}"


def _own_folder(spark: SparkSession) -> str:
    folder = f"{ensure_checkpoint_dir(spark)}/run-{spark.sparkContext.applicationId}"
    if folder not in _OWN:
        _OWN.add(folder)
        atexit.register(drop_intermediate, spark, folder)
    return folder


_OWN: set[str] = set()
_TABLES: set[str] = set()
_STEPS: list[list[str]] = []  # tables written by the steps that `settled` is making

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """A query that runs inside deletes its shuffle files as it ends; else they stay
    until the driver's collector meets their owners."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def write_once(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write `df` into the shared folder (in folders by a column, if named) and read it
    back: what is planned on the result reads these rows, however often, and no longer
    their sources. `let_go` deletes it."""
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    writer = df.write.option("compression", "zstd")
    with _shuffles_dropped(df.sparkSession):
        (writer.partitionBy(by) if by else writer).parquet(path)
    if _STEPS:
        _STEPS[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])
    out._written_to = path
    return out


def let_go(written: DataFrame) -> None:
    """Delete a table of `write_once` that nothing reads any more."""
    _delete(written._written_to)


@contextmanager
def collecting(spark: SparkSession, every_s: float = 15.0) -> Iterator[None]:
    """While a fit runs inside, the driver's collector is asked to run now and then, as
    Spark does every half hour: shuffles of rounds long past go with their owners."""
    jvm, done = spark.sparkContext._jvm, threading.Event()

    def ask() -> None:
        while not done.wait(every_s):
            jvm.System.gc()

    asking = threading.Thread(target=ask, daemon=True)
    asking.start()
    try:
        yield
    finally:
        done.set()
        asking.join()


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows of `make()`, written once; the tables that `write_once` wrote on the
    way there are deleted. Nothing else that `make` builds on them may be read later."""
    steps: list[str] = []
    _STEPS.append(steps)
    try:
        df = make()
    finally:
        _STEPS.pop()
    out = write_once(df, name)
    for path in steps:
        _delete(path)
    return out


def _delete(path: str) -> None:
    jvm = SparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(folder, True)


def own_table(name: str) -> str:
    """Have `drop_intermediate` drop this table's catalogue entry, too."""
    _TABLES.add(name)
    return name


def drop_intermediate(spark: SparkSession, folder: str | None = None) -> None:
    """Delete the intermediate tables of this application; runs when the driver
    process ends, and may be called as soon as no result is read any more."""
    if SparkContext._active_spark_context is not None:
        while _TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    if SparkContext._jvm is not None:
        _delete(folder or _own_folder(spark))
