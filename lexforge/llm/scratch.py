"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` and reading it
again: every executor can read it, so losing one costs nothing but its running
tasks.  Files of a session are removed when the Python process ends.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that removes a query's shuffle files when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Keys with more than this part of all rows are hot; so there are fewer of them than this.
HOT = 1024
_ROOTS: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The session's own folder below ``spark.checkpoint.dir``.

    Only in local mode, where that setting may be missing, a temporary folder is used.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="lexforge-")
            spark.sparkContext.setCheckpointDir(base)
        _ROOTS[app] = f"{base.rstrip('/')}/lexforge-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may have ended before
        pass


def mounted(spark: SparkSession, name: str) -> str | None:
    """A new folder there that every executor can open by its local path, or None if the shared folder is in another kind of store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root(spark)}/{name}-{uuid.uuid4().hex}")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() != "file":
        return None
    os.makedirs(local := path.toUri().getPath())
    return local


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and returns the table read back."""
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")  # the table holds all, so the shuffle files of this write can go with its end
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a table that materialise() wrote and nothing reads any more."""
    if (path := getattr(table, "_written_at", None)) is not None:
        _remove(table.sparkSession, path)


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as make it differ from all columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_one(rows: DataFrame, table: DataFrame, key: str, count: str = "c") -> DataFrame:
    """rows joined with a table that has one row a key and tells how many rows a key has.

    Keys that hold more than a HOT-th of these rows are fewer than HOT, whatever the size, and go to every
    task; rows of the other keys are dealt by key.  So no task gets a hot key's rows.  The table is read
    three times, so it should be a written one.
    """
    limit = (table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]) / HOT
    hot, rest = table.where(F.col(count) > limit), table.where(F.col(count) <= limit)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))
