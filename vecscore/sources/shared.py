"""The folder that all executors share, and tables kept in it."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: set[str] = set()
#: Shuffles of an action that is over are deleted at once where this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application, under ``spark.checkpoint.dir``; it is deleted when the application ends.

    Where that is unset, the checkpoint folder the session was given counts; where there is none either, a local
    folder will do in local mode, whose one process sees it, and is an error on a cluster.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: tables between steps need a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), "vecscore")
    own = f"{where.rstrip('/')}/vecscore-{sc.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_at_end, spark, own)
    return own


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def _at_end(spark: SparkSession, path: str) -> None:
    try:
        removed(spark, path)
    except Exception:  # the session's JVM is gone already
        pass


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Actions inside run under these settings (dots written as two underscores); the session's own come back."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def clean_shuffles(spark: SparkSession):
    """Actions inside leave no shuffle files behind."""
    return settings(spark, **{_CLEANUP.replace(".", "__"): "true"})


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` computed once, into a compressed columnar table at ``path``: no lost executor can take it away."""
    with clean_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialized(df: DataFrame, name: str = "table") -> DataFrame:
    """As :func:`stored`, in the application's folder: a join over it does not compute its columns again for each pair."""
    return stored(df, shared_path(df.sparkSession, name))
