"""An inbox of message files, each handled once and then deleted (SNK-11).

Messages come as files, named by their id, in any subfolder. A batch is
decided before it is handled: a message older than `hours` has expired, one
whose id was decided in these hours is repeated, the others are fresh. The
decision is written under the batch's number and stays when the batch is run
again, after a failure or a restart, so `handle` gets the same messages again
and can know them by the number. Files are deleted when their batch is
committed, that is when a later batch starts or the run has ended; so a crash
in between loses no message. Decisions are forgotten once their messages have
expired and their files are gone.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylark.operators.report import INBOX_HOURS
from quarrylark.streaming.pipelines import run_once

DECIDED = "id string, text string, path string, at timestamp, action string"


class Inbox:
    """Messages of a folder; what was decided and the stream's checkpoint are
    kept in another. At most `per_batch` files make a batch."""

    def __init__(self, spark: SparkSession, folder: str, memory: str, hours: float = INBOX_HOURS, per_batch: int = 1000, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.memory, self.hours, self.per_batch, self.clock = spark, folder, memory.rstrip("/"), hours, per_batch, clock
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def _epochs(self) -> list[int]:
        root = f"{self.memory}/decided"
        fs = self._fs(root)
        names = [s.getPath().getName() for s in fs.listStatus(self._path(root))] if fs.exists(self._path(root)) else []
        return sorted(int(n) for n in names if fs.exists(self._path(f"{root}/{n}/_SUCCESS")))

    def decided(self, epochs: list[int] | None = None) -> DataFrame:
        """Messages of these batches, by default of all that are remembered."""
        paths = [f"{self.memory}/decided/{e}" for e in (self._epochs() if epochs is None else epochs)]
        return self.spark.read.schema(DECIDED).parquet(*paths) if paths else self.spark.createDataFrame([], DECIDED)

    def _decide(self, batch: DataFrame, epoch: int) -> None:
        oldest = F.lit(self.clock() - self.hours * 3600)
        known = self.decided([e for e in self._epochs() if e < epoch]).where("action = 'fresh'").select("id").distinct().withColumn("known", F.lit(True))
        first = batch.groupBy("id").agg(F.min_by("path", F.struct("at", "path")).alias("first"))
        rows = batch.join(first, "id").join(known, "id", "left")
        action = F.when(F.unix_micros("at") / 1e6 < oldest, "expired").when(F.col("known") | (F.col("path") != F.col("first")), "repeated").otherwise("fresh")
        rows.select("id", "text", "path", "at", action.alias("action")).write.mode("overwrite").parquet(f"{self.memory}/decided/{epoch}")

    def _sweep(self, before: int | None = None) -> None:
        """Delete the files of committed batches; forget batches whose last
        message has expired."""
        oldest = self.clock() - self.hours * 3600
        for epoch in [e for e in self._epochs() if before is None or e < before]:
            rows = self.decided([epoch]).select("path", F.unix_micros("at").alias("at")).collect()  # a batch's files, at most per_batch
            for r in rows:
                self._fs(r.path).delete(self._path(r.path), False)
            if all(r.at / 1e6 < oldest for r in rows):
                self._fs(self.memory).delete(self._path(f"{self.memory}/decided/{epoch}"), True)

    def consume(self, handle: Callable[[DataFrame, int], None]) -> None:
        """Handle all messages that are there: handle(messages, batch) with id,
        text and at of the fresh ones."""
        source = self.spark.readStream.schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", self.per_batch)
        m = "_metadata"
        files = source.format("text").load(self.folder).select(F.col(f"{m}.file_name").alias("id"), F.col("value").alias("text"), F.col(f"{m}.file_path").alias("path"), F.col(f"{m}.file_modification_time").alias("at"))

        def each(batch: DataFrame, epoch: int) -> None:
            self._sweep(epoch)
            if epoch not in self._epochs():
                self._decide(batch, epoch)
            handle(self.decided([epoch]).where("action = 'fresh'").select("id", "text", "at"), epoch)

        run_once(files, each, f"{self.memory}/checkpoint")
        self._sweep()
