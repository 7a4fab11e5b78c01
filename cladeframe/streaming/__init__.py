"""Running counts of mutation records that arrive as files.

The batch engine has no streaming operator of its own to match; this is the incremental form of its
counts by type, for tips that are added to a stored network one after another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cladeframe.operators.mutations import count_by_type
from cladeframe.schemas import NUC_MUT


def running_counts(spark: SparkSession, path: str) -> DataFrame:
    """type and n over all records (schemas.NUC_MUT, Parquet) that have come into path; for complete output."""
    return count_by_type(spark.readStream.schema(NUC_MUT).parquet(path))
