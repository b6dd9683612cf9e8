"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


_cuts: ContextVar[list[str] | None] = ContextVar("orepulse_cuts", default=None)


def spark_session(master: str | None = None, app: str = "orepulse", **conf: str) -> SparkSession:
    """A session with the settings every job here assumes (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # call sites are costly to record per column
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_cut(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Cut lineage by writing the rows to the shared checkpoint folder and reading them back.

    The written table survives lost executors, and being parquet it is compressed and lets each reader
    fetch only the columns it uses. The folder is the one the cluster names in ``spark.checkpoint.dir``, or
    the context's own checkpoint folder. A local session that names none (tests) gets a folder of its own;
    a cluster without a shared folder is an error, since its executors could not see each other's files.
    """
    path = shared_path(df.sparkSession)
    if (made := _cuts.get()) is not None:
        made.append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table written by ``checkpoint_cut`` (or of frames made of such tables only) once nothing reads it any more."""
    _delete(df.sparkSession, {file.rsplit("/", 1)[0] for file in df.inputFiles()})


def _delete(spark: SparkSession, paths) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def passing_cuts(spark: SparkSession) -> Iterator[None]:
    """The tables that ``checkpoint_cut`` writes inside are deleted at the end, and shuffle files go: all that reads them must be written by then."""
    mark = _cuts.set([])
    try:
        yield
    finally:
        made = _cuts.get()
        _cuts.reset(mark)
        _delete(spark, made)
        release_shuffles(spark)


def settled(spark: SparkSession, work: Callable[[], DataFrame]) -> DataFrame:
    """What ``work`` gives, cut; the cuts that were made on the way are deleted."""
    path = shared_path(spark)
    if (outer := _cuts.get()) is not None:
        outer.append(path)
    with passing_cuts(spark):
        df = work()
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def shared_path(spark: SparkSession) -> str:
    """A new place for files of a job in the folder that the driver and all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _own_folder(spark)
    return f"{folder.rstrip('/')}/orepulse-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _test_folder()


@lru_cache(maxsize=1)
def _test_folder() -> str:
    folder = tempfile.mkdtemp(prefix="orepulse-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder
