"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a temporary one where it is unset and Spark runs in one process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and a lost executor costs nothing already written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tessera_path = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more, as all that came of them is written too."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.tessera_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


class Generations:
    """A store of at most 2 * ``size`` entries: when the younger half is full it becomes the older one, whose entries go unless they are met again."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value):
        if len(key) <= 64:
            if len(self.young) >= self.size:
                self.young, self.old = {}, self.young
            self.young[key] = value
        return value


def slices(texts, size: int = 4_000_000):
    """Runs of consecutive texts of about ``size`` characters together, one text at least."""
    run, held = [], 0
    for t in texts:
        run.append(t)
        held += len(t or "")
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """Queries made inside give their shuffle files back when they end, as each is run once and its result written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Queries run inside send at most ``rows`` rows at once to a Python worker, which bounds what a worker and its JVM hold of long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def give_back() -> None:
    """Return freed memory to the system at a task's end; workers are kept and would hold the most they ever needed."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)(0)


_KEPT: dict = {}


def kept(key, make):
    """What this worker process keeps from task to task: one thing, so that a store goes when another operator's task comes."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Drop what another operator's tasks have left in this worker process, which Spark reuses."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
        give_back()


@contextmanager
def without_cycles():
    """For code that makes many small objects and no cycles: the collector would walk large stores again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
