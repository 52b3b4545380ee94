"""Writing intermediate results to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where a local session leaves it unset, a temporary folder is made once. On a
    cluster an unset folder is an error: a machine-local one would not be seen by
    the other machines.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tracewell-"))
    return context.getCheckpointDir().rstrip("/")


_scratch: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for all tables written inside the ``with`` block, removed with them at its end.

    Results must be written elsewhere, or used up, before that: they may read these tables.
    """
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _scratch.append(folder)
    try:
        yield folder
    finally:
        _scratch.remove(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch[-1] if _scratch else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Cuts the lineage, survives lost executors, and gives Catalyst true file sizes:
    joins against the result are broadcast only below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffled beyond it. Filters on the column
    ``partition_by`` read only the files they need.
    """
    path = new_path(df.sparkSession, name)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str) -> DataFrame:
    """Add the rows of ``df`` to the table written at ``path``, if there is one, and give all that it holds by now.

    Each call writes its own rows only. ``df`` may read what is there already.
    """
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
