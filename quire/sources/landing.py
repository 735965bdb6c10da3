"""Answers of a service as a table in a folder that all executors reach.

Every batch of answers is a Parquet folder of its own, so a table only grows and
a reader sees whole batches; of a key the latest answer counts. What is fresh is
left out of a request by an anti join, and what a service fails to answer is
taken from older answers.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds for which an answer counts as fresh.
FRESH_SECONDS = 86400.0
_DDL = "asked string, work string, at double"


@dataclass
class Landing:
    """The table in ``folder`` (any Hadoop file system): asked, work (null where the service knows none), at (seconds)."""

    spark: SparkSession
    folder: str
    ttl: float = FRESH_SECONDS
    clock: Callable[[], float] = time.time

    def _fs(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def batches(self) -> list[str]:
        """Folders of whole batches (those whose write has ended)."""
        fs, where = self._fs()
        if not fs.exists(where):
            return []
        found = [s.getPath().toString() for s in fs.listStatus(where) if s.isDirectory()]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(p for p in found if fs.exists(done(f"{p}/_SUCCESS")))

    def held(self) -> DataFrame:
        """The latest answer of each key."""
        paths = self.batches()
        rows = self.spark.read.schema(_DDL).parquet(*paths) if paths else self.spark.createDataFrame([], _DDL)
        return rows.groupBy("asked").agg(F.max_by(F.struct("work", "at"), "at").alias("r")).select("asked", "r.work", "r.at")

    def fresh(self) -> DataFrame:
        return self.held().where(F.col("at") > F.lit(self.clock() - self.ttl))

    def add(self, answers: DataFrame) -> None:
        """Adds a batch of (asked, work) as of now."""
        rows = answers.select("asked", "work", F.lit(float(self.clock())).alias("at"))
        rows.write.option("compression", "zstd").parquet(f"{self.folder}/{int(self.clock() * 1000):015d}-{uuid.uuid4().hex}")

    def compact(self) -> int:
        """One batch in place of all; returns how many there were. Readers meanwhile see answers twice, which changes nothing."""
        old = self.batches()
        if len(old) > 1:
            self.held().write.option("compression", "zstd").parquet(f"{self.folder}/{int(self.clock() * 1000):015d}-{uuid.uuid4().hex}")
            fs, _ = self._fs()
            for path in old:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
        return len(old)
