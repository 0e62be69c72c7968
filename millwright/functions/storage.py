"""Cutting lineage with a written table, and attaching one-row aggregates."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Unset, a local master gets a temporary folder of its own; anywhere else executors would write to disks that
    the others cannot read, so it raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="millwright-")
    return _own_dirs[app]


def fresh_path(spark: SparkSession, name: str = "table") -> str:
    """A path in the shared folder that nothing has used yet; ``release`` removes what lies there."""
    path = f"{shared_dir(spark)}/millwright/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write once as parquet in the shared folder and read back.

    Later branches scan the small result, with column pruning and filter pushdown, instead of
    repeating the work above it, and a lost executor costs only its own tasks.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_so_far(spark: SparkSession) -> int:
    """How many intermediates this application has written; a mark for ``release``."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, keep_last: int = 0) -> int:
    """Remove the intermediates written after a mark, once no lazy result needs them any more.

    The ``keep_last`` newest of them stay, and are what a later call with the same mark begins with.
    """
    known = _written.get(spark.sparkContext.applicationId, [])
    end = max(since, len(known) - keep_last)
    paths, known[since:end] = known[since:end], []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a global aggregate (exactly one row by construction) to every row."""
    return df.crossJoin(F.broadcast(one_row))
