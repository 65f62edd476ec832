"""The shared folder, lineage cuts and the size of Arrow batches."""

from __future__ import annotations

import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

#: Seconds between two collections of the driver's garbage, at least.
COLLECT_EVERY = 2.0
#: Arrow batches at most.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_collected = 0.0


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none
    is named, as in tests, a local session makes and sets one of its own; on
    a cluster that would be a folder that executors don't share, an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quarrylark-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, whatever the texts' lengths: rows go to and
    from Python through buffers outside the heap that hold whole batches. A
    smaller setting of the session stays."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def cut(df: DataFrame) -> DataFrame:
    """Compute the frame once into the shared folder; later reads survive the
    loss of any executor. From time to time the driver collects its garbage
    then, so that Spark removes the shuffle files of what was cut before; else
    they stay until the driver's heap happens to fill."""
    global _collected
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    del df
    if time.monotonic() - _collected > COLLECT_EVERY:
        out.sparkSession._jvm.System.gc()
        _collected = time.monotonic()
    return out
