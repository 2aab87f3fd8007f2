"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet and reading it back. The folder is the one the
cluster names in ``spark.checkpoint.dir`` (or was given to ``setCheckpointDir``); only where
neither is set and Spark runs in one process (tests, a notebook) a folder of our own is made,
once per session. On a cluster without the setting it is an error: executors can't see a
folder that another machine made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of a folder that the driver and every executor can read and write."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="siftline-")
    return _OWN[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/siftline/{tag}-{uuid.uuid4().hex}"


def write_back(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the table.

    Unlike a cached table it outlives the executors that made it, and unlike
    ``checkpoint()`` it stays columnar, so later reads are pruned and pushed down.
    """
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``write_back`` that no later step reads; tables of any other folder stay."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path
        own = path(shared_dir(t.sparkSession)).toUri().getPath().rstrip("/") + "/siftline/"
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            p = path(folder)
            if p.toUri().getPath().startswith(own):
                p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)
