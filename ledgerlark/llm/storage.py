"""Intermediate tables and files in the folder that driver and executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``; a lost executor then
costs a reread, not a recomputation.  Only a local session, as in tests, may leave the setting
unset; a temporary folder is used then.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder name in the cluster's shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="ledgerlark-"))
    return f"{base.rstrip('/')}/ledgerlark-{uuid.uuid4().hex}"


def save(df: DataFrame, *partition_by: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which ends its lineage.

    The copy has no known partitioning, so a later join shuffles both sides and Spark
    can split skewed partitions.
    """
    path = path or shared_dir(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """The pyarrow file system and path of ``uri``, usable in driver and tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_whole(uri: str, chunks) -> None:
    """Write a file under a name of its own, then move it to ``uri``: a retried or doubled
    task leaves one whole file."""
    files, path = filesystem(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
    files.move(part, path)
