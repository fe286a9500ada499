"""A folder that the driver and all executors share, and small files in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder of this application if it runs on this machine alone.

    On a cluster a temporary folder would be another one on each machine, so an
    unset spark.checkpoint.dir is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {context.master} share")
        found = _LOCAL[context.applicationId] = _LOCAL.get(context.applicationId) or tempfile.mkdtemp(prefix="tidemark-")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system and path object of a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = hadoop_path(spark, path)
    fs.delete(where, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole: under a temporary name, then renamed over the old one in one step."""
    fs, temporary = hadoop_path(spark, f"{path}-{uuid.uuid4().hex}.tmp")
    fs.mkdirs(temporary.getParent())
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    _, target = hadoop_path(spark, path)
    jvm = spark._jvm
    overwrite = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    overwrite[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(temporary, target, overwrite)
