"""Tables of intermediate state in the folder that all executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, one of our own in local mode, as in tests, and else
    a ValueError: executors on other machines would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="meshlark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/meshlark-{uuid.uuid4().hex}"


class Tables:
    """Tables written to the shared folder: they cut lineage and size estimates, and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, shared_dir(spark)

    def save(self, df: DataFrame, name: str | None = None) -> DataFrame:
        path = f"{self.root}/{name or uuid.uuid4().hex}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Lets Spark remove the shuffle files of plans that nothing refers to any more."""
        for _ in range(2):  # references from Python go in the first round, what they held in the second
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.3)

    def drop(self) -> None:
        """Removes all of it; only for tables that no returned DataFrame reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
