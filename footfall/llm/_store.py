"""Tables in the folder that the cluster shares, to cut lineage.

The folder is ``spark.checkpoint.dir``. Where that is unset, as in tests, a
temporary folder of this machine is set; a cluster must name its own.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, without a slash at its end."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own_dir()
    return found.rstrip("/")


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="checkpoint-")


def cut(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes df as a table and returns that table read again, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table that cut() wrote and that no later read needs."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
