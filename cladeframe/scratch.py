"""Written intermediate tables, so that iterations neither grow their plans nor depend on lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def place(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names. A session in one process may leave it unset, and
    a folder is made; on a cluster that raises RuntimeError."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="cladeframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/step-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written once into place(), and read back."""
    path = place(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
