"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import cache

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC timestamps; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@cache
def _own_folder() -> tempfile.TemporaryDirectory:
    """This process's scratch folder, removed when the process ends."""
    return tempfile.TemporaryDirectory(prefix="run-", dir="/tmp", ignore_cleanup_errors=True)


#: Folders by owner: at the bottom the process, above it the blocks of ``scratch_tables`` that are open.
_OWNERS: list[list[str]] = [[]]


def _remove(folders: list[str]) -> None:
    """Delete folders wherever they are; what is gone already is no matter."""
    if not folders or SparkContext._jvm is None:
        return
    jvm = SparkContext._jvm
    active = SparkContext._active_spark_context
    conf = active._jsc.hadoopConfiguration() if active is not None else jvm.org.apache.hadoop.conf.Configuration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _remove_own() -> None:
    for folder in _OWNERS[0]:
        with suppress(Exception):  # the JVM may have ended before
            _remove([folder])


@contextmanager
def scratch_tables(keep: bool = False) -> Iterator[None]:
    """Folders that ``scratch_dir`` gives inside the block are removed when it ends, also by an error.

    With ``keep`` a block that ends well leaves them to the block around it, or to the process, which
    removes them when it ends: for results that are read later.
    """
    own: list[str] = []
    _OWNERS.append(own)
    try:
        yield
    except BaseException:
        _OWNERS.remove(own)
        _remove(own)
        raise
    _OWNERS.remove(own)
    if keep:
        _OWNERS[-1].extend(own)
    else:
        _remove(own)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new, unused folder below ``spark.checkpoint.dir``, owned by the innermost ``scratch_tables`` block.

    Outside such a block it goes when the process ends. Only a local master may fall back to a folder of
    this machine: on a cluster the executors would not see it, so a missing setting is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder().name
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _OWNERS[-1].append(path)
    return path


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """A table written to a scratch folder and read back: computed once, and its lineage ends there."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
