"""Reading tables, cutting lineage and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side may be broadcast; measured, never assumed.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``root``."""
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local session that names none (as in tests) gets a temporary folder; on a cluster each machine would have its
    own, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"a session on {master} has to name a shared folder in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="pagemill-")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system the session knows."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; its owner clears the folder
        pass


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialised within are dropped at its end: for a caller that has written its result by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _remove(spark, path)


def materialize(df: DataFrame, partition_hint: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and the data survive lost executors.

    The table is dropped at the end of the enclosing ``scratch``, or else of the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/pagemill-tables/{uuid.uuid4().hex}"
    out = df if partition_hint is None else df.coalesce(partition_hint)
    out.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    else:
        atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of a frame's size, from its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when ``df`` has at most ``limit`` rows and ``size`` bytes; beyond that the planner shuffles and AQE splits skew.

    Both are measured here, the bytes as JSON, and ``df`` is read again by the join: it should be materialised, or cheap.
    """
    row = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    found = df.select(row.alias("b")).limit(limit + 1).agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    return F.broadcast(df) if found.n <= limit and (found.b or 0) <= size else df
