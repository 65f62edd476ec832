"""Keyed state that is merged when it is read (STA-01, SNK-01, SNK-04, SRC-41,
STA-16).

A commit writes the rows it changes, and the keys it deletes, as a delta; the
rest of the state is not read nor written. A read takes each key's newest row:
deltas are reduced to one row a key, and base rows of those keys are left out
by an anti join, so a base beside small deltas is not shuffled. Rows lie in
buckets by a hash of their key, as partition folders, so what is asked for by
key reads its buckets only. Compaction writes the newest rows of the buckets
where deltas have grown as a new base of those buckets.

Commits are versions with a manifest, made as in VersionedTable: one writer
wins, the others get a Conflict and their files stay until `retain`. A key
that is null or stands twice in a commit is refused.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrylark.operators.state import VersionedTable, upsert
from quarrylark.session import cut

BUCKETS, GROWN = 64, 0.25


class KeyedTable(VersionedTable):
    """Rows by `keys` in the folder, in buckets by `bucket_by`, some of the
    keys, by default all. A table keeps what it was made with."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = BUCKETS, grace: float = 600.0, bucket_by: list[str] | None = None):
        super().__init__(spark, folder, grace)
        self.keys, self.buckets, self.bucket_by = keys, buckets, bucket_by or keys

    def manifest(self, version: int | None = None) -> dict | None:
        """A version's manifest, by default the current one's."""
        self.etag()
        found = [m for m in self.versions() if version is None or m["version"] == version]
        if version is not None and not found:
            raise ValueError(f"no version {version}")
        if found and (found[-1]["keys"], found[-1]["buckets"], found[-1]["bucket_by"]) != (self.keys, self.buckets, self.bucket_by):
            raise ValueError("the table has other keys or buckets")
        return found[-1] if found else None

    def bucket(self, *columns: Column) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def _with_bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", self.bucket(*[F.col(k) for k in self.bucket_by]))

    def _files(self, kind: str, paths: list[str], schema: StructType) -> DataFrame:
        """Files of the deltas or bases with their partition columns."""
        kinds = StructType(list(schema))
        if kind == "deltas":
            kinds = kinds.add("deleted", "boolean").add("version", "long")
        kinds = kinds.add("part", "string").add("bucket", "integer")
        if not paths:
            return self.spark.createDataFrame([], kinds)
        root = f"{self.folder}/{kind}"
        return self.spark.read.schema(kinds).option("basePath", root).parquet(*[f"{root}/{p}" for p in paths])

    def _sides(self, m: dict, extra: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """The base rows and the delta rows that still count."""
        schema = StructType.fromJson(m["schema"])
        base = self._files("bases", [f"part={p}" for p in m["bases"]], schema)
        holds = [(F.col("part") == p) & F.col("bucket").isin(buckets) for p, buckets in m["bases"].items()]
        base = base.where(reduce(lambda a, b: a | b, holds, F.lit(False)))
        deltas = self._files("deltas", m["deltas"], schema)
        since = F.element_at(F.array(*[F.lit(v) for v in m["since"]]), F.col("bucket") + 1)
        deltas = deltas.where(F.col("version") > since)
        return base if extra is None else base.where(extra), deltas if extra is None else deltas.where(extra)

    def _merged(self, m: dict, extra: Column | None = None) -> DataFrame:
        base, deltas = self._sides(m, extra)
        fields = [f["name"] for f in m["schema"]["fields"]]
        if not m["deltas"]:
            return base.select(*fields, "bucket")
        newest = deltas.groupBy("bucket", *self.keys).agg(F.max_by(F.struct("deleted", *[F.col(f) for f in fields]), "version").alias("row"))
        old = base.join(newest.select("bucket", *self.keys), ["bucket", *self.keys], "left_anti")
        return old.select(*fields, "bucket").unionByName(newest.where(~F.col("row.deleted")).select(*[F.col(f"row.{f}").alias(f) for f in fields], "bucket"))

    def load(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; null before the first commit."""
        m = self.manifest(version)
        return self._merged(m).drop("bucket") if m else None

    def matching(self, wanted: DataFrame) -> DataFrame | None:
        """The current rows of the keys that `wanted` has. Where the keys are
        few, only their buckets are read."""
        m = self.manifest()
        if not m:
            return None
        asked = cut(self._with_bucket(wanted.select(*self.keys)).distinct())
        of = [r.bucket for r in asked.select("bucket").distinct().collect()]  # at most `buckets` rows
        return self._merged(m, F.col("bucket").isin(of)).join(asked, ["bucket", *self.keys], "left_semi").drop("bucket")

    def where_in(self, column: str, values: list) -> DataFrame | None:
        """The current rows with one of a few values in the column that the
        buckets are by; only their buckets are read, and files skip by value."""
        m = self.manifest()
        if not m or self.bucket_by != [column]:
            return None
        asked = self.spark.createDataFrame([(v,) for v in values], StructType([StructType.fromJson(m["schema"])[column]]))
        of = sorted({r.bucket for r in self._with_bucket(asked).select("bucket").collect()})
        return self._merged(m, F.col("bucket").isin(of) & F.col(column).isin(values)).drop("bucket")

    def commit(self, changed: DataFrame, expected: int, deleted: DataFrame | None = None) -> int:
        """Put the changed rows, drop the keys of `deleted`; the new version."""
        m = self.manifest()
        schema = StructType.fromJson(m["schema"]) if m else changed.schema
        fields = [f.name for f in schema]
        if set(changed.columns) != set(fields) or m and {f.name: f.dataType for f in changed.schema} != {f.name: f.dataType for f in schema}:
            raise ValueError("the rows differ in columns from those of the table")
        rows = changed.select(*fields, F.lit(False).alias("deleted"))
        if deleted is not None:
            gone = deleted.select(*self.keys).distinct().withColumn("deleted", F.lit(True))
            rows = rows.unionByName(gone, allowMissingColumns=True)
        part = self._new_part(expected)
        where = f"{self.folder}/deltas/{part}"
        self._with_bucket(rows).repartition("bucket").write.partitionBy("bucket").parquet(where)
        written = self.spark.read.schema(StructType([*[schema[k] for k in self.keys]])).parquet(where)
        each = written.groupBy(*self.keys).agg(F.count("*").alias("n"))
        missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in self.keys])
        n, bad = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if((F.col("n") > 1) | missing)).first()
        if bad:
            raise ValueError(f"{bad} keys are null or stand twice")
        return self._publish_delta(m, schema, part, n, expected)

    def commit_marked(self, rows: DataFrame, expected: int) -> int:
        """Changed rows and keys to drop in one frame, told apart by `deleted`;
        the new version. The caller answers for keys that are not null and
        stand once, so the rows are written where they are made."""
        m = self.manifest()
        fields = [f for f in rows.schema if f.name != "deleted"]
        schema = StructType.fromJson(m["schema"]) if m else StructType(fields)
        if {f.name: f.dataType for f in fields} != {f.name: f.dataType for f in schema}:
            raise ValueError("the rows differ in columns from those of the table")
        part = self._new_part(expected)
        where = f"{self.folder}/deltas/{part}"
        self._with_bucket(rows.select(*schema.names, "deleted")).write.partitionBy("bucket").parquet(where)
        n = self.spark.read.schema(StructType([schema[self.keys[0]]])).parquet(where).count()
        return self._publish_delta(m, schema, part, n, expected)

    def _new_part(self, expected: int) -> str:
        return f"version={expected + 1}/part={uuid.uuid4().hex}"

    def _publish_delta(self, m: dict | None, schema: StructType, part: str, n: int, expected: int) -> int:
        before = m or {"bases": {}, "since": [0] * self.buckets, "deltas": [], "sizes": [], "base_rows": 0}
        body = {**before, "keys": self.keys, "buckets": self.buckets, "bucket_by": self.bucket_by, "schema": schema.jsonValue(), "deltas": before["deltas"] + [part] * (n > 0), "sizes": before["sizes"] + [n] * (n > 0)}
        return self._publish(body, expected)

    def deltas(self) -> DataFrame | None:
        """The changes that are not in a base: the rows, deleted, version."""
        m = self.manifest()
        return self._sides(m)[1].drop("part", "bucket") if m else None

    def grown(self, share: float = GROWN) -> list[int]:
        """The buckets whose deltas have more rows than this share of their base."""
        m = self.manifest()
        if not m:
            return []
        base, deltas = (side.groupBy("bucket").agg(F.count("*").alias("n")) for side in self._sides(m))
        sizes = deltas.join(base.withColumnRenamed("n", "of"), "bucket", "left").where(F.col("n") > share * F.coalesce("of", F.lit(0)))
        return sorted(r.bucket for r in sizes.select("bucket").collect())  # at most `buckets` rows

    def compact(self, expected: int, buckets: list[int] | None = None) -> int:
        """Write the newest rows of these buckets, by default of all, as their
        base. The rows don't change."""
        m = self.manifest()
        if not m:
            raise ValueError("the table is empty")
        chosen = sorted(range(self.buckets) if buckets is None else set(buckets))
        if not chosen:
            return expected
        part = uuid.uuid4().hex
        # the buckets stand in the paths, so nothing else is read
        self._merged(m, F.col("bucket").isin(chosen)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/bases/part={part}")
        bases = {p: kept for p, held in m["bases"].items() if (kept := sorted(set(held) - set(chosen)))}
        since = [expected if b in set(chosen) else v for b, v in enumerate(m["since"])]
        # a delta goes when every bucket's base is newer
        live = [k for k, d in enumerate(m["deltas"]) if int(d.split("/")[0].removeprefix("version=")) > min(since)]
        return self._publish({**m, "bases": {**bases, part: chosen}, "since": since, "deltas": [m["deltas"][k] for k in live], "sizes": [m["sizes"][k] for k in live]}, expected)

    def retain(self, versions: int = 5) -> list[str]:
        """Drop old manifests, and parts that no manifest kept names: of writers
        that lost, too, once they are older than `grace`."""
        dropped = []
        for m in self.versions()[:-versions]:
            dropped.append(f"manifest-{m['version']:012d}.json")
            self._fs.delete(self._path(f"{self.folder}/{dropped[-1]}"), False)
        named = {p for m in self.versions() for p in [*m["deltas"], *[f"part={b}" for b in m["bases"]]]}
        for pattern, depth in (("deltas/*/*", 2), ("bases/*", 1)):
            for s in self._fs.globStatus(self._path(f"{self.folder}/{pattern}")) or []:
                name = "/".join(s.getPath().toString().split("/")[-depth:])
                if name not in named and time.time() - s.getModificationTime() / 1000 > self.grace:
                    self._fs.delete(s.getPath(), True)
                    dropped.append(name)
        return dropped


def merge_run(table: KeyedTable, seen: DataFrame, now: Column, fields: list[str], empty: DataFrame) -> tuple[int, DataFrame]:
    """A run's jobs into the table (JOIN-03, STA-01): only the stored rows that
    were seen are read, only inserted and seen rows are written. Gives the
    version and the rows written, with their action. `empty` has the state's
    columns and no rows, for a table without a version."""
    version, seen = table.etag(), cut(seen)
    known = table.matching(seen)
    rows = upsert(empty if known is None else known, seen, now, fields)
    return table.commit(rows.drop("action"), version), rows
