"""Session helpers of the operators: the shared folder, lineage cuts, inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylark.session import bounded_batches, cut, shared_folder

__all__ = ["bounded_batches", "cut", "held_out", "share_file", "shared_folder", "table"]

_PIECE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share_file(spark: SparkSession, name: str, content: bytes) -> None:
    """Write the file to the shared folder and hand it to all executors, where
    SparkFiles.get(name) is its path. The content goes over in pieces."""
    jvm, sc = spark._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    for at in range(0, len(content), _PIECE):
        out.write(bytearray(content[at : at + _PIECE]))
    out.close()
    sc.addFile(path.toString())


def held_out(column: str = "doc_id"):
    """True for rows whose crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))
