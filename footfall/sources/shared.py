"""Tables in the folder that the cluster shares, for what is read more than once."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table under ``spark.checkpoint.dir`` and read again.

    Where that is unset, as in tests, the folder is a temporary one of this
    machine; a cluster must name its own.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own()
    path = f"{folder.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@cache
def _own() -> str:
    return tempfile.mkdtemp(prefix="tables-")
