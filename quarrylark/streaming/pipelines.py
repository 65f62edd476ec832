"""Structured Streaming forms of the stateful operators (STA-01, STA-04,
STA-05, STA-15, SNK-07, SNK-11, UDX-01)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quarrylark.session import cut, shared_folder


def run_once(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str | None = None, mode: str = "append") -> None:
    """All that is there, then stop (STA-15: a schedule of AvailableNow runs).
    The checkpoint makes a batch that ran count once."""
    spark = stream.sparkSession
    checkpoint = checkpoint or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_events(spark: SparkSession, folder: str, name: str = "events", per_trigger: int = 16) -> DataFrame:
    """A table's file or files as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*.parquet")


def daily_volume(stream: DataFrame, at: str, source: str, late: str = "2 days") -> DataFrame:
    """Counts per day and source; days older than the watermark are closed
    (STA-05)."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"), F.col(source).alias("source")).agg(F.count("*").alias("raw")).select(F.to_date("w.start").alias("day"), "source", "raw")


def first_seen(stream: DataFrame, key: str, at: str, late: str = "30 days") -> DataFrame:
    """Each key once while the watermark remembers it (STA-04)."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def collect_stream(stream: DataFrame, mode: str) -> DataFrame:
    """The result table of a stream run once, as a batch frame."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/result-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(folder)

    run_once(stream, write, mode=mode)
    return spark.read.parquet(folder)


def stream_upsert(stream: DataFrame, key: str, at: str, folder: str | None = None) -> DataFrame:
    """Keyed state folded over micro-batches by an idempotent merge (STA-01):
    (key, first_seen, last_seen, sightings). Every batch's state is a snapshot
    named after its epoch, beside the stream's checkpoint in the folder, so a
    batch that is run again, also after a restart, gives the same state. A run
    over a folder that has a state goes on from there."""
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def epochs() -> list[int]:
        """Epochs whose snapshots were written whole."""
        root = path(f"{folder}/epochs")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n) for n in names if fs.exists(path(f"{folder}/epochs/{n}/_SUCCESS")))

    def merge(batch: DataFrame, epoch: int) -> None:
        new = batch.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("sightings"))
        before = [e for e in epochs() if e < epoch]
        if before:
            old = spark.read.parquet(f"{folder}/epochs/{before[-1]}")
            new = old.unionByName(new).groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("sightings").alias("sightings"))
        new.write.mode("overwrite").parquet(f"{folder}/epochs/{epoch}")
        for old_epoch in before[:-1]:  # the one before may be needed if this batch is run again
            fs.delete(path(f"{folder}/epochs/{old_epoch}"), True)

    run_once(stream, merge, f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/epochs/{epochs()[-1]}")


def deliver(alerts: DataFrame, send: Callable[[str], bool], senders: int = 4) -> DataFrame:
    """Send an outbox by so many tasks at a time (SNK-07): canonical_id, ok,
    tries of every alert, in the shape that `outbox` takes as sent. alerts:
    canonical_id, text. `send` goes along with the tasks; one that fails
    counts as a try that was not acknowledged. The outcome is kept when it has
    been computed, so reading it doesn't send again; a task that is lost in
    between does, as deliveries count only once they are acknowledged."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def sent(text: str) -> bool:
            try:
                return bool(send(text))
            except Exception:
                return False

        for b in batches:
            yield pd.DataFrame({"canonical_id": b["canonical_id"], "ok": [sent(t) for t in b["text"]], "tries": 1})

    kind = alerts.schema["canonical_id"].dataType.simpleString()
    return cut(alerts.select("canonical_id", "text").repartition(senders).mapInPandas(each, f"canonical_id {kind}, ok boolean, tries int"))


class LandedSource(DataSource):
    """A connector over landed bodies as a Python data source (UDX-01):
    spark.dataSource.register(LandedSource), format("landed"),
    options bodies (JSON array of texts) and feed (a name of the feeds)."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return "landed long, body string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LandedReader(self.options.get("paths", ""))


class _LandedReader(DataSourceReader):
    def __init__(self, paths: str):
        self.paths = [p for p in paths.split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((k, p)) for k, p in enumerate(self.paths)]

    def read(self, partition: InputPartition):
        # any file system that Arrow knows; a plain path must be on a folder that all executors mount
        from pyarrow import fs

        k, path = partition.value
        source, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        with source.open_input_stream(name) as f:
            yield k, f.read().decode("utf-8")
