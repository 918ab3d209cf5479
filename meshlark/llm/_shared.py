"""Tables in the shared folder, and files of it on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import components
from ..plans.storage import Tables

__all__ = ["Tables", "bounded_batches", "components", "filesystem", "partitions"]

BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> SparkSession:
    """The session, with Arrow batches to Python held to BATCH_BYTES (or one row) instead of a number of rows only.

    Texts vary in length by orders of magnitude, so a bound in rows alone doesn't bound memory.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.sparkSession


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str):
    """(pyarrow filesystem, path) for a URI of the shared folder, on the driver or an executor."""
    from pyarrow import fs

    if "://" not in uri:
        uri = uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}"
    return fs.FileSystem.from_uri(uri)
