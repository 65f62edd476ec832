"""Embedding near-dedup: random-hyperplane sign hashing in several tables,
exact cosines in double precision, components by alternating stars.

Equal vectors are one class with a count; only classes are compared. The
signs of a class's vector against a table's hyperplanes are its bucket in
that table. There are enough bits for buckets of about `bucket` classes and
enough tables to meet a pair at the threshold with probability `recall`.
Buckets of more than `cell` classes are dealt over blocks, and every pair of
blocks is a cell of its own, so no task holds a whole large bucket. A pair
that meets in several tables counts in the first. Cells give sums of links
and one edge per linked class, never pairs.

Vectors that are null, empty or zero, or hold null or non-finite components,
link with nothing, as do rows with a null vec_id, which have no component
and are not kept. Only vectors of equal length are compared. Repeated rows
are vectors of their own. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarrylark.llm.bytescan import mix64
from quarrylark.llm.shared import bounded_batches, cut
from quarrylark.operators.graph import components

THRESHOLD, RECALL, BUCKET, CELL, SEED = 0.95, 0.9995, 256, 1024, 977


class Planes:
    """The tables' hyperplanes for vectors of any length."""

    def __init__(self, bits: int, tables: int):
        self.bits, self.tables, self.by_dim = bits, tables, {}

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """[rows, tables] uint64; tables and lengths don't share buckets."""
        dim = vectors.shape[1]
        if dim not in self.by_dim:
            self.by_dim[dim] = np.random.default_rng([SEED, dim]).standard_normal((dim, self.bits * self.tables))
        # rows one by one in the same order of sums, so that a row's signs don't depend on its batch
        sign = np.einsum("ij,jk->ik", vectors, self.by_dim[dim], optimize=False) >= 0
        out = np.zeros((len(vectors), self.tables), np.uint64)
        for t in range(self.tables):
            key = np.full(len(vectors), dim * self.tables + t, np.uint64)
            for b in range(0, self.bits, 32):
                part = sign[:, t * self.bits + b : t * self.bits + min(b + 32, self.bits)]
                key = mix64(key ^ mix64(part @ (np.uint64(1) << np.arange(part.shape[1], dtype=np.uint64))))
            out[:, t] = key
        return out


def plan_tables(n: int, threshold: float, recall: float, bucket: int) -> tuple[int, int]:
    same = 1 - math.acos(threshold) / math.pi
    bits = max(4, math.ceil(math.log2(max(1, n / bucket))))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same**bits))


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, d1, d2 of every row), (d1, d2, rep, n, vec of every class)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat, at = column.values, column.offsets.to_numpy()
            # a list without a missing component, all finite and not all zero
            body = flat.to_numpy(zero_copy_only=False)
            whole = np.concatenate(([0], np.cumsum(~np.isfinite(body))))
            some = np.concatenate(([0], np.cumsum(body != 0)))
            good = column.is_valid().to_numpy(zero_copy_only=False) & (whole[at[1:]] == whole[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
            d1, d2, vec = [], [], []
            for ok, low, high in zip(good.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                if ok:
                    x = np.ascontiguousarray(body[low:high]) + 0.0  # one zero
                    a, b = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64).tolist()
                    small = x.astype(np.float32)
                    d1.append(a), d2.append(b), vec.append(small.tobytes() + b"f" if (small == x).all() else x.tobytes() + b"d")
                else:
                    d1.append(None), d2.append(None), vec.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(vec, pa.binary())], names=["vec_id", "d1", "d2", "vec"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    signed = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(scan, f"vec_id {kind}, d1 long, d2 long, vec binary")
    some = signed.where(F.col("vec_id").isNotNull() & F.col("d1").isNotNull())
    classes = some.groupBy("d1", "d2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.min("vec").alias("vec"))
    return signed.drop("vec"), classes


def _unpacked(body: bytes) -> np.ndarray:
    return np.frombuffer(body[:-1], np.float32 if body.endswith(b"f") else np.float64).astype(float)


def _by_dim(bodies: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rows = [_unpacked(b) for b in bodies]
    dims = np.array([len(r) for r in rows])
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        yield at, np.array([rows[i] for i in at.tolist()])


def _links(cell: dict, planes: Planes, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(places, links, smallest reachable rep) of a cell's linked classes."""
    rep, order = cell["rep"], np.argsort(cell["rep"], kind="stable")
    rep, n, block = rep[order], cell["n"][order], cell["block"][order]
    v = np.array([_unpacked(cell["vec"][i]) for i in order.tolist()])
    size = np.sqrt((v * v).sum(axis=1))
    linked = (v @ v.T) / size[:, None] / size[None, :] >= threshold
    np.fill_diagonal(linked, False)
    if cell["cross"]:
        linked &= block[:, None] != block[None, :]
    if not linked.any():
        return None
    some = np.flatnonzero(linked.any(axis=1))
    linked, rep, n = linked[np.ix_(some, some)], rep[some], n[some]
    keys = planes.buckets(v[some])
    for t in range(cell["table"]):  # pairs that met in an earlier table
        linked &= keys[:, t][:, None] != keys[:, t][None, :]
    if not linked.any():
        return None
    label = np.arange(len(rep))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(rep)).min(axis=1))
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return rep, (linked * n[None, :]).sum(axis=1), rep[label]


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    bounded_batches(vectors.sparkSession)
    signed, classes = _classes(vectors)
    signed, classes = cut(signed), cut(classes)
    planes = Planes(*plan_tables(classes.count(), threshold, recall, bucket))
    kind, rep_type = classes.schema["rep"].dataType.simpleString(), to_arrow_type(classes.schema["rep"].dataType)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, v in _by_dim(batch.column(1).to_pylist()):
                keys = planes.buckets(v).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(at, planes.tables))), pa.array(keys.reshape(-1))], names=["rep", "bucket"])

    thin = classes.select("rep", "vec").mapInArrow(place, f"rep {kind}, bucket long")
    hot = thin.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > cell)
    hot_of = thin.join(hot, "bucket").groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "m"))).alias("hot"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each cell that a class belongs to."""
        for batch in batches:
            hots, slot = [dict(h or []) for h in batch.column(3).to_pylist()], batch.column(4).to_numpy()
            for at, v in _by_dim(batch.column(2).to_pylist()):
                keys = planes.buckets(v)
                out: list[tuple[int, int, int, int, bool]] = []
                for i, row in zip(at.tolist(), keys, strict=True):
                    for t, key in enumerate(row.view(np.int64).tolist()):
                        blocks = -(-hots[i].get(key, 1) // cell)
                        own = int(slot[i] % blocks)
                        out += [(i, key ^ (min(own, k) << 20 ^ max(own, k)) * 0x1F123BB5 if blocks > 1 else key, t, own, own != k) for k in range(blocks)]
                who, name, table, block, cross = zip(*out, strict=True)
                who = pa.array(who, pa.int64())
                wrap = np.array([x & 0xFFFFFFFFFFFFFFFF for x in name], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(wrap), pa.array(table, pa.int32()), pa.array(cross, pa.bool_()), pa.array(block, pa.int32()), batch.column(0).take(who), batch.column(1).take(who), batch.column(2).take(who)], names=["cell", "table", "cross", "block", "rep", "n", "vec"])

    dealt = classes.join(hot_of, "rep", "left").select("rep", "n", "vec", "hot", F.xxhash64("rep", F.lit(SEED)).alias("slot")).mapInArrow(deal, f"cell long, table int, cross boolean, block int, rep {kind}, n long, vec binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches are sorted by cell; a cell may go on in the next batch."""
        left, types = None, [rep_type, pa.int64(), rep_type]
        for batch in _then_none(batches):
            rows = left if batch is None else pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            if rows is None or not len(rows):
                continue
            key = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("cell", "table", "cross")], axis=1)
            edge = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(rows)]))
            done = len(edge) - 1 if batch is None else len(edge) - 2
            reps, n, block, vec = rows["rep"].to_numpy(zero_copy_only=False), rows["n"].to_numpy(), rows["block"].to_numpy(), rows["vec"].to_pylist()
            found = []
            for a, b in zip(edge[:done].tolist(), edge[1 : done + 1].tolist(), strict=True):
                if b - a > 1 and (got := _links({"rep": reps[a:b], "n": n[a:b], "block": block[a:b], "vec": vec[a:b], "table": int(key[a, 1]), "cross": bool(key[a, 2])}, planes, threshold)):
                    found.append(got)
            left = rows.slice(int(edge[done])).combine_chunks() if done < len(edge) - 1 else None
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]), t) for k, t in enumerate(types)], names=["rep", "links", "low"])
        yield pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names=["rep", "links", "low"])

    by_cell = dealt.repartition("cell", "table", "cross").sortWithinPartitions("cell", "table", "cross")
    found = cut(by_cell.mapInArrow(compare, f"rep {kind}, links long, low {kind}").groupBy("rep", "low").agg(F.sum("links").alias("links")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    part = components(found, "rep", "low").select(F.col("node").alias("rep"), "component")
    known = classes.select("d1", "d2", "rep", "n").join(links, "rep", "left").join(part, "rep", "left")
    out = signed.join(known, ["d1", "d2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "rep", "vec_id"))
    n_links = F.when(F.col("vec_id").isNotNull(), F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).otherwise(0)
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def op9(spark, sf_dir: str) -> DataFrame:
    from quarrylark.llm.shared import table

    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT r, vec_id, e FROM v
  WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0
), l AS (
  SELECT a.r AS ra, a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(x, y) AS (SELECT a, b FROM l UNION SELECT p.x, q.b FROM reach p JOIN l q ON p.y = q.a),
m AS (SELECT x AS vec_id, least(x, min(y)) AS component_id FROM reach GROUP BY x),
k AS (SELECT ra, count(*) AS n FROM l GROUP BY ra)
SELECT v.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, coalesce(m.component_id, v.vec_id) AS component_id, coalesce(coalesce(m.component_id, v.vec_id) = v.vec_id, false) AS kept
FROM v LEFT JOIN k ON k.ra = v.r LEFT JOIN m USING (vec_id)
"""
