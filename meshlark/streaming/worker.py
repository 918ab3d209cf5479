"""Rebuilding from a stream of snapshots: the newest of each batch is built, results are published by generation."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "generation long, kind string, seq long, submitted long, coalesced long, build_ms long, error string"


class Worker:
    """start(snapshots) builds from a stream (seq, ...) of snapshots.

    Every batch with snapshots is one generation: the one with the highest seq goes to build(DataFrame) and the others
    are passed over.  The result is written under root/mesh/generation=N and announced in root/events; a build that
    fails leaves the published one in place and is announced as failed.  The batch number is the generation's key,
    so a batch that Spark runs again overwrites its own result.
    """

    def __init__(self, spark: SparkSession, root: str, build: Callable[[DataFrame], DataFrame]):
        self.spark, self.root, self.build = spark, root.rstrip("/"), build

    def _batch(self, rows: DataFrame, batch: int) -> None:
        head = rows.agg(F.max("seq").alias("seq"), F.count_distinct("seq").alias("n")).first()
        if head.seq is None:
            return
        began, error = time.time(), None
        try:
            self.build(rows.where(F.col("seq") == head.seq)).write.mode("overwrite").parquet(f"{self.root}/mesh/generation={batch}")
        except Exception as e:  # a bad snapshot must not end the stream
            error = str(e).splitlines()[0][:500] if str(e) else type(e).__name__
        row = [(batch, "failed" if error else "completed", head.seq, head.n, head.n - 1, int((time.time() - began) * 1000), error)]
        self.spark.createDataFrame(row, EVENTS).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/events/batch={batch}")

    def start(self, snapshots: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return snapshots.writeStream.foreachBatch(self._batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(f"{self.root}/events")

    def current(self) -> DataFrame | None:
        """The last completed mesh, None before the first."""
        done = self.events().where("kind = 'completed'").agg(F.max("generation")).first()[0]
        return None if done is None else self.spark.read.parquet(f"{self.root}/mesh/generation={done}")

    def stats(self) -> DataFrame:
        """One row: submitted, coalesced, completed, failed, last generation, last, longest and total milliseconds."""
        done = F.col("kind") == "completed"
        return self.events().agg(
            F.sum("submitted").alias("submitted"), F.sum("coalesced").alias("coalesced"), F.count(F.when(done, 1)).alias("completed"), F.count(F.when(~done, 1)).alias("failed"),
            F.max(F.when(done, F.col("generation"))).alias("generation"), F.max_by("build_ms", "generation").alias("last_ms"), F.max("build_ms").alias("max_ms"), F.sum("build_ms").alias("total_ms"),
        )
