"""Tables written to the folder that every machine of the cluster sees."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or else the session's checkpoint folder.

    Only where both are absent and all runs on this machine (a local test
    session), a temporary folder is made and registered as checkpoint folder.
    On a cluster that is an error: its machines would not see each other's.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every machine of the cluster sees")
    made = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other job uses."""
    return f"{shared_dir(spark)}/mediarill-{uuid.uuid4().hex}/{name}"


_scope: ContextVar[list[tuple[SparkSession, str, bool]] | None] = ContextVar("scope", default=None)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are written inside are deleted at the end, but for those that ``materialize`` was told to keep.

    Kept ones belong to the scope around, if there is one. A DataFrame that
    reads a deleted table fails, so what leaves the scope must read kept ones.
    """
    outer, made = _scope.get(), []
    token = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(token)
        for spark, path, kept in made:
            if not kept:
                discard(spark, path)
            elif outer is not None:
                outer.append((spark, path, False))


def written(spark: SparkSession, path: str, kept: bool = False) -> None:
    """Tell the scope around of a table that was written to ``path``."""
    made = _scope.get()
    if made is not None:
        made.append((spark, path, kept))


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, kept: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage is cut, lost executors cost nothing, and the reread table has
    exact sizes, so that Spark decides on broadcasts from facts. A ``scratch``
    scope around deletes the table at its end unless it is ``kept``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    written(spark, path, kept)
    # Stated, as a table without rows has no files to take a schema from; folders' columns come last.
    fields = sorted(df.schema.fields, key=lambda f: f.name in (partition_by or []))
    return spark.read.schema(StructType(fields)).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder made by this package, through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
