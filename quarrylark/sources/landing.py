"""A landing folder as a data source, batch and stream (UDX-01, SRC-34).

Bodies lie as files in source=…/day=… folders, on any file system that Arrow
knows. `spark.dataSource.register(LandingFolder)`, then
`spark.read.format("landing").option("folder", …)`: source, day, name, body,
one partition a file. Filters on source and day are pushed down and pick the
folders, so other files are neither listed nor opened; Spark needs
`spark.sql.python.filterPushdown.enabled` for that, without it the filters run
after the read. With it, Spark 4.1 keeps what one query pushed to a loaded
frame for the next query of that frame: call `landed` for each query.

As a stream, files come in the order of their last write. An offset is the
time and path of the last file; files younger than `settle` seconds wait for
the next batch, so that files of one time are read together. The offsets are
in the stream's checkpoint: a run that was interrupted reads the files of its
last batch again, later ones go on behind them.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "source string, day date, name string, body string"
_TESTS = {
    EqualTo: lambda value, x: value == x, EqualNullSafe: lambda value, x: value == x, In: lambda value, xs: value in xs, GreaterThan: lambda value, x: value > x,
    GreaterThanOrEqual: lambda value, x: value >= x, LessThan: lambda value, x: value < x, LessThanOrEqual: lambda value, x: value <= x,
}


def _opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def _listed(system, path: str) -> list:
    from pyarrow import fs

    return system.get_file_info(fs.FileSelector(path, allow_not_found=True))


def _value(name: str, key: str):
    """What a folder's name says of its column; None for other folders."""
    said = name.removeprefix(f"{key}=") if name.startswith(f"{key}=") else None
    if said is None or key == "source":
        return said
    try:
        return dt.date.fromisoformat(said)
    except ValueError:
        return None


def files_of(folder: str, filters: Iterable[Filter] = ()) -> Iterator[tuple[str, dt.date, str, int]]:
    """(source, day, path, time of the last write in nanoseconds) of the files
    in the folders that the filters let through."""
    system, root = _opened(folder)
    passes = lambda key, value: value is not None and all(_TESTS[type(f)](value, f.value) for f in filters if f.attribute == (key,))
    for a in _listed(system, root):
        if passes("source", source := _value(a.base_name, "source")):
            for b in _listed(system, a.path):
                if passes("day", day := _value(b.base_name, "day")):
                    for f in _listed(system, b.path):
                        if f.is_file and not f.base_name.startswith(("_", ".")):
                            yield source, day, f.path, f.mtime_ns


def _read(folder: str, source: str, day: dt.date, path: str) -> Iterator[tuple]:
    with _opened(folder)[0].open_input_stream(path) as f:
        yield source, day, path.rsplit("/", 1)[-1], f.read().decode("utf-8")


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """The folder's bodies, for one query: a frame of its own each time."""
    spark.dataSource.register(LandingFolder)
    return spark.read.format("landing").option("folder", folder).load()


class LandingFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["folder"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options["folder"], float(self.options.get("settle", 2.0)))


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.filters = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("source",), ("day",)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x[:3]) for x in sorted(files_of(self.folder, self.filters))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        # Spark asks for one partition of nothing where there are none
        return _read(self.folder, *partition.value) if partition is not None else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, folder: str, settle: float):
        self.folder, self.settle = folder, settle

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        settled = (time.time() - self.settle) * 1e9
        last = max(((at, path) for _, _, path, at in files_of(self.folder) if at <= settled), default=(0, ""))
        return {"time": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = (start["time"], start["path"]), (end["time"], end["path"])
        return [InputPartition((s, d, p)) for s, d, p, at in sorted(files_of(self.folder), key=lambda x: (x[3], x[2])) if first < (at, p) <= last]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _read(self.folder, *partition.value)

    def commit(self, end: dict) -> None:
        """Files stay; retention is that of the landing folder."""
