"""MinHash near-duplicates: minima of universal hashes, banding, signature
and full-set verification, components by alternating stars.

A document's set is its distinct five-word shingles, each a 64-bit hash. One
pass over the texts gives the set's size, a 128-bit digest of the whole set
and one hash per band of minima. Documents with equal digests are one class
with a number of its own; only classes are compared.

Candidates: in every band bucket the member first by a hash order is the hub
and is paired with each other member, so a bucket of n gives n - 1 pairs. A
pair is dropped if its signatures agree in less than `least_agree` of the
minima (six standard deviations below the threshold), else its full sets are
intersected. Links are joined to components. So that no link is lost where
the hub does not link, buckets that still hold several components go on:
shingles that no other such member has can be in no intersection, so they
bound what a pair can reach. Each member is compared with a second hub, the
one of its buckets with the smallest share of them. What a member has in
common with any other is partly in its hub, of which it has in_hub, or not.
So another member can only link with it if in_hub alone is enough for their
sizes (such pairs are taken from the buckets), or if the two have shingles
in common that the hub lacks (such pairs are found by these shingles, which
are rare, and counted). Both kinds are verified on their full sets.

Aggregates by bucket are cut before they are joined back, so that each join
has exchanges of its own, which are split where a bucket is hot.

Sets are made again only for documents that share a bucket: up to FILTER_IDS
of them through a bit filter of eight bits for each, beyond by a semi-join,
so texts are not shuffled for the rest.

Documents without words, with a null text or with a null doc_id link with
nothing; the latter have no component and are not kept. Rows with equal
doc_id and text agree in all columns; rows that share a doc_id but differ in
text each have their own set and share one component. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylark.llm.bytescan import LOWER, SPACED, hash_spans, mix64, runs, slices
from quarrylark.llm.shared import bounded_batches, cut
from quarrylark.operators.graph import components

WORDS, BANDS, ROWS, SIMILAR, LEAST_AGREE, SEED = 5, 32, 4, 75, 0.5, 20240229
FILTER_IDS = 4 << 20


class Hashes:
    """Multiply-shift universal hashes of 64-bit values to 32 bits."""

    def __init__(self, n: int):
        rng = np.random.default_rng(SEED)
        self.a = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, np.uint64)

    def minima(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """[rows, n]; rows (starts in at) aren't empty."""
        out = np.empty((len(at), len(self.a)), np.uint32)
        h = np.empty_like(values)
        for k in range(len(self.a)):
            np.multiply(values, self.a[k], out=h)
            h += self.b[k]
            out[:, k] = np.minimum.reduceat(h, at) >> np.uint64(32)
        return out


def shingle_sets(raw: np.ndarray, offs: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a slice's rows, and the rows' places
    in them (rows + 1). Fewer words than a shingle's make one shingle."""
    data = LOWER[raw]
    starts, ends, row_at = runs(data, offs, SPACED)
    h, n = hash_spans(data, starts, ends), np.diff(row_at)
    size = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    at = np.concatenate(([0], np.cumsum(size)))
    first = np.repeat(row_at[:-1] - at[:-1], size) + np.arange(at[-1])
    value = np.zeros(len(first), np.uint64)
    short = np.repeat((n > 0) & (n < words), size)
    whole = first[~short]
    for k in range(words):
        value[~short] = mix64(value[~short] + h[whole + k] * np.uint64(2 * k + 3))
    for r in np.flatnonzero((n > 0) & (n < words)).tolist():
        v = np.array([n[r] + 1], np.uint64)
        for k in range(int(n[r])):
            v = mix64(v + h[row_at[r] + k : row_at[r] + k + 1] * np.uint64(2 * k + 3))
        value[at[r]] = v[0]
    parts = [np.unique(value[at[r] : at[r + 1]]) for r in range(len(n))]
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.concatenate(parts) if parts else value, np.concatenate(([0], np.cumsum(sizes)))


def _bands(minima: np.ndarray, bands: int) -> np.ndarray:
    """[rows, bands] int64: a hash of each band's minima and its number."""
    rows = minima.shape[1] // bands
    out = np.empty((len(minima), bands), np.uint64)
    for b in range(bands):
        v = np.full(len(minima), b + 1, np.uint64)
        for k in range(rows):
            v = mix64(v * np.uint64(31) + minima[:, b * rows + k].astype(np.uint64))
        out[:, b] = v
    return out.view(np.int64)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (the set's digest; null without words), bands."""
    hashes = Hashes(bands * rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, offs in slices(batch.column(1)):
                values, at = shingle_sets(raw, offs, words)
                n = np.diff(at)
                full = np.flatnonzero(n)
                found = _bands(hashes.minima(values, at[:-1][full]), bands) if len(full) else np.empty((0, bands), np.int64)
                digest = np.zeros((len(n), 2), np.int64)
                for r in full.tolist():
                    digest[r] = np.frombuffer(xxhash.xxh3_128_digest(values[at[r] : at[r + 1]].tobytes()), np.int64)
                places = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(places), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(n), pa.array(digest[:, 0], mask=n == 0), pa.array(digest[:, 1], mask=n == 0), lists], names=["doc_id", "n_shingles", "d1", "d2", "bands"])

    docs = _plain(docs)
    return docs.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, d1 long, d2 long, bands array<long>")


def _slot(column: str, bits: int):
    return F.pmod(F.xxhash64(column), F.lit(bits))


def _id_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit filter over the ids."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("s") % 32).cast("int"))
    words = ids.select(_slot("doc_id", bits).alias("s")).groupBy(F.floor(F.col("s") / 32).cast("int").alias("w")).agg(F.bit_or(one).alias("m")).toArrow()
    table = np.zeros(bits // 32, np.uint32)
    table[words["w"].to_numpy()] = words["m"].to_numpy().astype(np.uint32)  # at most bits / 32 rows
    return table


def _sets(docs: DataFrame, ids: DataFrame, bands: int, rows: int, words: int, most: int = FILTER_IDS) -> DataFrame:
    """doc_id, d1, d2, sig (minima), shingles: the full sets of all rows whose
    doc_id is among the ids, and of some others."""
    hashes, n = Hashes(bands * rows), ids.count()
    bits = max(1 << 16, 1 << (8 * n).bit_length())
    docs, mask = _plain(docs), None
    if n > most:
        docs, bits = docs.join(ids, "doc_id", "left_semi"), 1
    else:
        mask = docs.sparkSession.sparkContext.broadcast(_id_filter(ids, bits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if mask is not None:
                s = batch.column(2).to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array((mask.value[s // 32] >> (s % 32).astype(np.uint32)) & 1 == 1))
            for first, end, raw, offs in slices(batch.column(1)):
                values, at = shingle_sets(raw, offs, words)
                full = np.flatnonzero(np.diff(at))
                if not len(full):
                    continue
                sig = hashes.minima(values, at[:-1][full]).astype(np.int32, casting="unsafe")
                digest = np.array([np.frombuffer(xxhash.xxh3_128_digest(values[at[r] : at[r + 1]].tobytes()), np.int64) for r in full.tolist()])
                kept = pa.ListArray.from_arrays(pa.array(np.append(at[:-1][full], at[-1]).astype(np.int32)), pa.array(values.view(np.int64)))
                sigs = pa.ListArray.from_arrays(pa.array((np.arange(len(full) + 1) * sig.shape[1]).astype(np.int32)), pa.array(sig.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first).take(pa.array(full)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), sigs, kept], names=["doc_id", "d1", "d2", "sig", "shingles"])

    return docs.withColumn("slot", _slot("doc_id", bits)).mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, d1 long, d2 long, sig array<int>, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similar: int, least_agree: float, minima: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    one = sets.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"), F.col("shingles").alias("set_b"))
    other = sets.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"), F.col("shingles").alias("set_a"))
    # sizes alone can rule a pair out: the smaller set is at most the intersection
    both = pairs.join(one, "b").join(other, "a")
    small, large = F.least(F.size("set_a"), F.size("set_b")), F.greatest(F.size("set_a"), F.size("set_b"))
    agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return both.where(F.when(small * 100 < large * similar, False).when(agree < least_agree * minima, False).otherwise(common * 100 >= union * similar)).select("a", "b")


def _with_unique(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds n, the set's size, and u, how many of its shingles no other
    member's set has: those can be in no intersection."""
    own = members.select("rep").distinct().join(sets.select("rep", "shingles"), "rep")
    lone = own.select("rep", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("rep").alias("rep")).where(F.col("c") == 1)
    sized = own.select("rep", F.size("shingles").alias("n")).join(lone.groupBy("rep").agg(F.count("*").alias("u")), "rep", "left")
    return cut(members.join(sized.select("rep", "n", F.coalesce("u", F.lit(0)).alias("u")), "rep"))


def _beside_hub(members: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Adds, from each member's and its hub's full sets: in_hub, the size of
    their intersection; beyond, the member's shingles that the hub lacks;
    linked, whether the two reach the similarity."""
    mine = sets.select("rep", F.col("shingles").alias("mine"))
    theirs = sets.select(F.col("rep").alias("hub"), F.col("shingles").alias("theirs"))
    both = members.join(mine, "rep").join(theirs, "hub").withColumn("in_hub", F.size(F.array_intersect("mine", "theirs")))
    linked = (F.col("rep") != F.col("hub")) & (F.col("in_hub") * 100 >= (F.col("n") + F.size("theirs") - F.col("in_hub")) * similar)
    return both.select(*members.columns, "in_hub", F.array_except("mine", "theirs").alias("beyond"), linked.alias("linked"))


def _possible(n1: str, u1: str, n2: str, u2: str, similar: int):
    """Whether sets of these sizes and unique shingles can reach the similarity."""
    most = F.least(F.col(n1) - F.col(u1), F.col(n2) - F.col(u2))
    return most * 100 >= (F.col(n1) + F.col(n2) - most) * similar


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = WORDS, similar: int = SIMILAR, least_agree: float = LEAST_AGREE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    bounded_batches(docs.sparkSession)
    signed = cut(signatures(docs, bands, rows, words))
    some = signed.where(F.col("doc_id").isNotNull() & F.col("d1").isNotNull())
    # cut before they are numbered, so that the numbers stay
    classes = cut(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))).withColumn("rep", F.monotonically_increasing_id())

    first = F.struct(F.xxhash64("rep").alias("h"), F.col("rep").alias("rep"))
    members = classes.select("rep", F.explode("bands").alias("bucket"))
    heads = cut(members.groupBy("bucket").agg(F.min(first).alias("head"), F.count("*").alias("n")).where(F.col("n") > 1).select("bucket", F.col("head.rep").alias("hub")))
    shared = cut(members.join(heads, "bucket").select("bucket", "rep", "hub"))
    sharing = cut(shared.select("rep").distinct().join(classes.select("rep", "doc_id", "d1", "d2"), "rep"))
    full = _sets(docs, sharing.select("doc_id").distinct(), bands, rows, words)
    sets = cut(full.join(sharing.drop("doc_id"), ["d1", "d2"]).select("rep", "sig", "shingles").dropDuplicates(["rep"]))

    def linked(pairs: DataFrame) -> DataFrame:
        return cut(_verified(pairs, sets, similar, least_agree, bands * rows))

    def ordered(one: str, other: str) -> list:
        return [F.greatest(one, other).alias("a"), F.least(one, other).alias("b")]

    pairs = cut(shared.where(F.col("rep") != F.col("hub")).select(*ordered("rep", "hub")).distinct())
    part = cut(components(linked(pairs), "a", "b"))

    placed = shared.select("bucket", "rep").join(part.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = cut(placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(F.col("low") < F.col("high")).select("bucket"))
    undecided = _with_unique(cut(placed.join(mixed, "bucket")), sets)
    order = F.struct((F.col("u") / F.col("n")).alias("r"), (-F.col("n")).alias("m"), F.col("rep").alias("rep"))
    hubs = cut(undecided.groupBy("bucket").agg(F.min(order).alias("h")))
    own_hub = undecided.join(hubs, "bucket").groupBy("rep").agg(F.min("h").alias("h"), F.first("component").alias("component"), F.first("n").alias("n"), F.first("u").alias("u"))
    own_hub = cut(_beside_hub(own_hub.select("rep", F.col("h.rep").alias("hub"), "component", "n", "u"), sets, similar))
    second = own_hub.where("linked").select(*ordered("rep", "hub"))

    # components joined by these links count as one below; joining more of them would only spare work
    joined = own_hub.where("linked").select("component", F.col("hub").alias("rep")).join(own_hub.select("rep", F.col("component").alias("into")), "rep").where(F.col("into") != F.col("component")).groupBy("component").agg(F.min("into").alias("into"))
    known = cut(own_hub.join(joined, "component", "left").select("rep", "n", "u", "in_hub", "beyond", F.coalesce("into", "component").alias("component")))
    placed = undecided.select("bucket", "rep").join(known.drop("beyond"), "rep")
    each = placed.groupBy("bucket", "component").agg(F.count("*").alias("m"))
    largest = cut(each.groupBy("bucket").agg(F.max(F.struct("m", "component")).alias("most"), F.count("*").alias("k")).where(F.col("k") > 1).select("bucket", F.col("most.component").alias("largest")))
    open_now = cut(placed.join(largest, "bucket"))
    seeking = open_now.where((F.col("component") != F.col("largest")) & (F.col("n") - F.col("u") >= F.col("n") * similar / 100))
    query = seeking.select("bucket", *(F.col(c).alias(f"x_{c}") for c in ("rep", "component", "n", "u", "in_hub")))
    apart = (F.col("x_component") != F.col("component")) & _possible("n", "u", "x_n", "x_u", similar)
    need = (F.col("x_n") + F.col("n")) * similar / (100 + similar)
    # pairs that may reach the similarity by what the one has of its hub
    inside = query.join(open_now.drop("in_hub"), "bucket").where(apart & (need <= F.col("x_in_hub"))).select("x_rep", "rep")
    # all others must have so many shingles in common that the hub doesn't have
    asking = known.join(seeking.select("rep").distinct(), "rep", "left_semi").select(*(F.col(c).alias(f"x_{c}") for c in ("rep", "component", "n", "u", "in_hub")), F.explode("beyond").alias("s"))
    having = known.drop("beyond", "in_hub").join(sets.select("rep", F.explode("shingles").alias("s")), "rep")
    beyond = asking.join(having, "s").where(apart).groupBy("x_rep", "rep", "x_in_hub", "x_n", "n").agg(F.count("*").alias("c")).where(F.col("x_in_hub") + F.col("c") >= need).select("x_rep", "rep")
    rest = inside.unionByName(beyond).select(*ordered("x_rep", "rep")).distinct()
    third = linked(rest.join(pairs, ["a", "b"], "left_anti"))

    # a document with rows of several texts joins their classes
    held = cut(some.select("doc_id", "d1", "d2").join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).select("doc_id", "rep").distinct())
    several = held.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where(F.col("a") < F.col("b")).select("doc_id", "a")
    clashes = held.join(several, "doc_id").select("a", F.col("rep").alias("b"))
    stars = part.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = components(stars.unionByName(second).unionByName(third).unionByName(clashes), "a", "b")
    named = cut(classes.select("rep", "doc_id").join(final.withColumnRenamed("node", "rep"), "rep").groupBy("component").agg(F.min("doc_id").alias("least")).join(final, "component").select(F.col("node").alias("rep"), "least"))
    # cut, so that the join below is of two exchanges and is split where a class is hot
    own = cut(classes.select("rep", F.col("doc_id").alias("low")).join(named, "rep", "left").select("rep", F.coalesce("least", "low").alias("component")))
    of_doc = held.join(own, "rep").groupBy("doc_id").agg(F.min("component").alias("component"))
    out = signed.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; rows with
    a null doc_id stay. Of rows that share a doc_id one stays, the first by a
    hash of its columns. All columns are kept."""
    kept = near_duplicates(docs).where(F.col("kept")).select("doc_id").distinct()
    quoted = {c: F.col(f"`{c.replace('`', '``')}`") for c in docs.columns}
    hashed = [quoted[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    one = F.min_by(F.struct(*quoted.values()), F.xxhash64(*hashed)).alias("row")
    rows = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(one).select("row.*")
    return rows.unionByName(docs.where(F.col("doc_id").isNull()))


def op10(spark, sf_dir: str) -> DataFrame:
    from quarrylark.llm.shared import table

    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 75 * (p.n + q.n - common)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(x, y) AS (SELECT a, b FROM both_ways UNION SELECT r.x, t.b FROM reach r JOIN both_ways t ON r.y = t.a),
m AS (SELECT x AS doc_id, least(x, min(y)) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, coalesce(m.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
