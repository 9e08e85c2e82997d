"""Session settings, the shared folder, and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a joined side may be broadcast, after it was counted.
BROADCAST_ROWS = 200_000
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where it is unset, a temporary folder on a single machine (tests), an error on a cluster."""
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """`df` as a Parquet table in the shared folder, read back, and its path: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint only below BROADCAST_ROWS; Spark shuffles the join otherwise."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
