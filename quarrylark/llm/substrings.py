"""Substring dedup: content-defined chunks by a gear rolling hash.

The gear hash of the last 8 bytes is rolled over every text; a chunk ends
where the hash is smaller than at the 14 places before and not larger than at
the 14 after, or after `most` bytes, so that an insertion moves no boundary
but those beside it, and few chunks are long. A chunk's 64-bit digest is
aggregated over the corpus to the smallest and largest doc_id that holds it; a
chunk is repeated if different documents hold it, or if it stands twice in one
text. Adjoining repeated chunks of a text make a run; runs of at least
`min_bytes` bytes and `min_words` words are the result. A run lacks what of a
passage lies in the chunks over its ends, so `min_words` is half of the
shortest passage meant, 50 words.

Each repeated chunk stays in one place, its first: the smallest doc_id, there
the first place. A run is divided where kept changes: chunks that stand
earlier go, if a stretch of them reaches both bounds by itself; shorter ones
stay with the text beside them.

One row per span: doc_id, start and length (code points), n_words,
n_chunks, first_doc_id (this document where kept, else the smallest one that
holds the span's first chunk) and kept. Null and short texts give no rows;
nor do rows with a null doc_id. Repeated rows of one document count once.
Rows that share a doc_id but differ in text are texts of one document, each
with its own spans; a chunk that only they share isn't repeated. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylark.llm.bytescan import SPACED, mix64, runs, slices
from quarrylark.llm.shared import bounded_batches, cut

WINDOW_BITS, RADIUS, MOST, MIN_BYTES, MIN_WORDS = 3, 14, 256, 80, 25
_GEAR = mix64(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte: sum of GEAR[byte at distance j] << j over
    the last 8 bytes, by doubling the window."""
    h = _GEAR[data]
    for k in range(WINDOW_BITS):
        w = 1 << k
        if len(h) > w:
            h[w:] = h[w:] + (h[:-w] << np.uint32(w))
    return h


def least_ahead(h: np.ndarray, width: int) -> np.ndarray:
    """The least of the `width` values from every place on, by doubling."""
    out, n = h.copy(), 1
    while n < width:
        step = min(n, width - n)
        out[:-step] = np.minimum(out[:-step], out[step:])
        n += step
    return out


def chunks(data: np.ndarray, offs: np.ndarray, radius: int = RADIUS, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """(ends of all chunks, rows' places in them (rows + 1)) of a slice."""
    h = gear(data)
    low = least_ahead(h, radius)
    m = max(len(h) - 2 * radius, 0)
    here = h[radius : radius + m]
    cuts = np.flatnonzero((here < low[:m]) & (here <= low[radius + 1 : radius + 1 + m])) + radius + 1
    # no cut is taken where the window or the radius reaches over an end of the row
    row = np.searchsorted(offs, cuts - 1, "right") - 1
    cuts = cuts[(cuts >= offs[row] + (1 << WINDOW_BITS) + radius) & (cuts <= offs[row + 1] - radius)]
    ends = np.sort(np.concatenate((cuts, offs[1:][np.diff(offs) > 0])))
    begin = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    parts = np.maximum(ends - begin - 1, 0) // most + 1
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    ends = np.minimum(np.repeat(begin, parts) + (nth + 1) * most, np.repeat(ends, parts))
    return ends, np.searchsorted(ends, offs, "right")


def chunk_rows(docs: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """A row for each chunk: doc_id, digest, pos (31 bits of the text's hash,
    then the chunk's number), start, size (code points, words and bytes of 10
    bits each), again (whether its text holds an equal chunk elsewhere)."""
    if most >= 1 << 10:
        raise ValueError("chunks of so many bytes don't fit the sizes")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offs in slices(batch.column(1)):
                ends, at = chunks(data, offs, radius, most)
                n = np.diff(at)
                row = np.repeat(np.arange(len(n)), n)
                begin = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                if len(ends):
                    begin[at[:-1][n > 0]] = offs[:-1][n > 0]
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                starts, _, _ = runs(data, offs, SPACED)
                whole = data.tobytes()
                digest = np.array([xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)], np.uint64).view(np.int64)
                text = np.array([xxhash.xxh3_64_intdigest(whole[a:b]) >> 33 for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], np.int64)
                words = np.searchsorted(starts, ends) - np.searchsorted(starts, begin)
                size = (points[ends] - points[begin]) << 20 | words << 10 | (ends - begin)
                order = np.argsort(digest.view(np.uint64) ^ mix64(row.astype(np.uint64) + np.uint64(1)))
                same = (digest[order][1:] == digest[order][:-1]) & (row[order][1:] == row[order][:-1])
                again = np.zeros(len(digest), bool)
                again[order[1:][same]] = again[order[:-1][same]] = True
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first + row)), pa.array(digest), pa.array(text[row] << 32 | np.arange(len(row)) - at[row]), pa.array((points[begin] - points[offs[row]]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(again)],
                    names=["doc_id", "digest", "pos", "start", "size", "again"],
                )

    bounded_batches(docs.sparkSession)
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest long, pos long, start int, size int, again boolean")


def repeated_spans(docs: DataFrame, radius: int = RADIUS, most: int = MOST, min_bytes: int = MIN_BYTES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, length, n_words, n_chunks, first_doc_id, kept."""
    rows = chunk_rows(docs, radius, most)
    held = rows.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"), F.max("again").alias("again"))
    # cut, so that the join has an exchange of its own, which can be split where a digest is hot
    held = cut(held.where((F.col("first_doc_id") < F.col("last_doc_id")) | F.col("again")).select("digest", "first_doc_id"))
    # from here on a document's repeated chunks are in one task, and nothing is dealt again
    hits = rows.drop("again").join(held, "digest").repartition("doc_id").dropDuplicates(["doc_id", "pos"])
    sizes = [F.shiftright("size", 20).alias("length"), (F.shiftright("size", 10) % 1024).alias("n_words"), (F.col("size") % 1024).alias("bytes")]
    first_here = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("pos")) == 1
    hits = hits.withColumn("own", (F.col("first_doc_id") == F.col("doc_id")) & first_here).select("doc_id", "pos", "start", "first_doc_id", "own", *sizes)
    run = hits.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    # stretches of chunks that stay here, or don't
    run = run.withColumn("stretch", F.col("pos") - F.row_number().over(Window.partitionBy("doc_id", "own").orderBy("pos")))
    sums = [F.sum(c).alias(c) for c in ("length", "n_words", "bytes")]
    parts = run.groupBy("doc_id", "run", "own", "stretch").agg(F.min("pos").alias("pos"), F.min("start").alias("start"), *sums, F.count("*").alias("n_chunks"), F.min_by("first_doc_id", "pos").alias("first_doc_id"))
    by_run = Window.partitionBy("doc_id", "run")
    whole = (F.sum("bytes").over(by_run) >= min_bytes) & (F.sum("n_words").over(by_run) >= min_words)
    parts = parts.withColumn("whole", whole).where("whole").withColumn("kept", F.col("own") | (F.col("bytes") < min_bytes) | (F.col("n_words") < min_words))
    turned = F.coalesce((F.col("kept") != F.lag("kept").over(by_run.orderBy("pos"))).cast("int"), F.lit(0))
    parts = parts.withColumn("turned", turned).withColumn("piece", F.sum("turned").over(by_run.orderBy("pos")))
    sums = [F.sum(c).alias(c) for c in ("length", "n_words", "n_chunks")]
    spans = parts.groupBy("doc_id", "run", "piece", "kept").agg(F.min("start").alias("start"), *sums, F.min_by("first_doc_id", "pos").alias("held_by"))
    first = F.when(F.col("kept"), F.col("doc_id")).otherwise(F.col("held_by")).alias("first_doc_id")
    return spans.select("doc_id", F.col("start").cast("long").alias("start"), "length", "n_words", "n_chunks", first, "kept")


def op3(spark, sf_dir: str) -> DataFrame:
    from quarrylark.llm.shared import table

    return repeated_spans(table(spark, sf_dir, "documents"))
