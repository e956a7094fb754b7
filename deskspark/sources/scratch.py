"""Shared scratch folder: checkpoints, intermediate tables, stream state."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
# Paths that open scopes will delete, innermost scope last.
_scopes: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests) gets a temporary
    folder; on a cluster a missing setting is an error, since executors could
    not see each other's files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="deskspark-")
    return _local_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the scratch folder."""
    return f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def short_lived(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`freeze` writes inside are deleted at the end.

    For steps whose result is stored by a freeze outside: nothing lazy may leave the scope.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` worked out once, as a table in the shared folder that is deleted at the end."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        _delete(spark, path)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which state with timers needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def freeze(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Materialise once as a table in the shared folder and cut the lineage.

    Row placement is fixed from here on, so later reads agree with each other,
    a lost executor costs a re-read, and later plans prune columns and see sizes. A ``lasting`` table
    outlives the innermost :func:`short_lived` scope, as its result does.
    """
    path = new_path(df.sparkSession, "table")
    scopes = _scopes[:-1] if lasting else _scopes
    if scopes:
        scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
