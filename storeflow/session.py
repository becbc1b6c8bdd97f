"""Session helpers: recommended settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

# For jobs over the wide feed: their stages can exceed the 8000 bytes of code
# per method that the JVM compiles, and then smaller generated projections are
# faster. Narrow queries are better off without it.
WIDE_SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}

# For streams: state on local disk instead of in executor memory.
STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def job_session(app_name: str, extra: Mapping[str, str] | None = None) -> SparkSession:
    """Session for the spark-submit jobs; master and sizes come from the submit."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets one
    temporary checkpoint folder for its lifetime.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="storeflow-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/storeflow/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a working folder made with ``fresh_path``."""
    if not path.startswith(f"{shared_folder(spark)}/storeflow/"):
        raise ValueError(f"{path} is not a working folder")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder beside a table, such as one with staged rows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def has_partitions(spark: SparkSession, path: str) -> bool:
    """Whether a partitioned folder has any partition; an empty one has no files to take a schema from."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/*=*")
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0
