"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The alphabet is words. Patterns are the windows of consecutive benchmark
words (whole items when shorter). Patterns of one length m share a shift
table over blocks of two words: a block that ends no pattern prefix lets the
scan jump m - 1 places, others jump to the nearest place where the block
could end a window. Where the shift is zero, the bucket of the suffix block
holds the candidate patterns, sorted by a hash of the whole window, which
selects among them as the prefix table does; the windows' words are then
compared by hash and by bytes. Many places advance at once: each document is
dealt over lanes of bounded length and all lanes step together.

Null or wordless documents have no words and no hits. Repeated rows are
judged one by one. Items without words have no window. A null item_id does
not count as an item, but its windows mark words. Other columns, whatever
their names, are ignored.

The benchmark is read in blocks of about `block_bytes` of text. The tables of
a block are flat arrays over the places of its words; they are made one block
at a time, written to the shared folder, and handed to all executors, which
map them into memory. So the driver holds one block, and a task's pages of
the tables are the system's to drop. One scan of the documents passes all
blocks, in one stage, without a shuffle.
"""

from __future__ import annotations

import mmap
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylark.llm.bytescan import ALNUM, LOWER, hash_spans, mix64, runs, slices
from quarrylark.llm.shared import bounded_batches, share_file

WINDOW = 10
BLOCK_BYTES = 4 << 20
LANE = 96
_HEAD = 16


def _whole(words: np.ndarray, start: np.ndarray, m: int) -> np.ndarray:
    """A hash of the m words from each start on."""
    out = words[start]
    for k in range(1, m):
        out = mix64(out ^ (words[start + k] * np.uint64(2 * k + 1)))
    return out


def _blocks_at(words: np.ndarray, block: int, bits: int) -> np.ndarray:
    """The table slot of the block that ends at each word."""
    key = words
    if block == 2:
        key = words.copy()
        key[1:] = mix64(words[:-1] * np.uint64(3) ^ words[1:])
    return (key >> np.uint64(bits)).astype(np.int64)


def build_tables(texts: list[bytes], window: int = WINDOW) -> bytes:
    """The file of one block of the benchmark: words' hashes, starts and ends,
    the words' items (places in texts), the text; then for each length of
    patterns the shift table, the buckets' edges and the patterns (places of
    their first words), sorted by bucket and hash, with their hashes."""
    offs = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    data = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    starts, ends, row_at = runs(data, offs, ALNUM)
    words, n = hash_spans(data, starts, ends), np.diff(row_at)
    item = np.repeat(np.arange(len(n)), n)
    lengths = np.minimum(n, window)
    parts = [words, starts.astype(np.int32), ends.astype(np.int32), item.astype(np.int32), data]
    head = [len(words), len(data), int(len(np.unique(lengths[lengths > 0])))]
    for m in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == m)
        many = n[rows] - m + 1
        first = np.repeat(row_at[rows] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))
        block = min(2, m)
        bits = 64 - max(12, min(22, int(n[rows].sum()).bit_length() + 2))
        key = _blocks_at(words, block, bits)
        shift = np.full(1 << 64 - bits, m - block + 1, np.uint8 if m < 256 else np.int32)
        for end in range(block - 1, m):
            np.minimum.at(shift, key[first + end], shift.dtype.type(m - 1 - end))
        whole, bucket = _whole(words, first, m), key[first + m - 1]
        order = np.lexsort((whole, bucket))
        edges = np.searchsorted(bucket[order], np.arange(len(shift) + 1))
        head += [m, bits, len(first)]
        parts += [shift, edges.astype(np.int32), first[order].astype(np.int32), whole[order]]
    out = [np.array([len(head), *head], np.int64).tobytes()]
    for part in parts:
        out += [part.tobytes(), b"\0" * (-part.nbytes % _HEAD)]
    return b"".join(out)


class Patterns:
    """Wu-Manber tables of the patterns of one length."""

    def __init__(self, m: int, bits: int, words: np.ndarray, shift: np.ndarray, edges: np.ndarray, first: np.ndarray, whole: np.ndarray):
        self.m, self.bits, self.block = m, bits, min(2, m)
        self.words, self.shift, self.edges, self.first, self.whole = words, shift, edges, first, whole

    def scan(self, words: np.ndarray, row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, first word of the pattern) of the places whose word hashes all agree."""
        m, n, none = self.m, np.diff(row_at), np.empty(0, np.int64)
        rows = np.flatnonzero(n >= m)
        if not len(rows):
            return none, none
        lanes = -(-(n[rows] - m + 1) // LANE)
        first = np.repeat(row_at[rows] + m - 1, lanes)
        nth = np.arange(len(first)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = first + nth * LANE
        stop = np.minimum(at + LANE, np.repeat(row_at[rows + 1], lanes))
        key = _blocks_at(words, self.block, self.bits)
        ends = []
        while len(at):
            jump = self.shift[key[at]]
            ends.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        end = np.sort(np.concatenate(ends))
        low, high = (self.edges[key[end] + k].astype(np.int64) for k in (0, 1))
        some = low < high
        start, low, high = end[some] - (m - 1), low[some], high[some]
        # binary search of the window's hash in its bucket: the first and the end of the equal ones
        whole = _whole(words, start, m)
        low, high = self._search(whole, low, high, False), self._search(whole, low, high, True)
        many = high - low
        start = np.repeat(start, many)
        which = self.first[np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))].astype(np.int64) if len(many) else none
        same = np.ones(len(start), bool)
        for k in range(m):
            same &= self.words[which + k] == words[start + k]
        return start[same], which[same]

    def _search(self, value: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while (low < high).any():
            mid = np.minimum((low + high) // 2, len(self.whole) - 1)
            seen = self.whole[mid]
            up = (low < high) & ((seen <= value) if after else (seen < value))
            high = np.where((low < high) & ~up, mid, high)
            low = np.where(up, mid + 1, low)
        return low


class Benchmark:
    """The mapped tables of one block of the benchmark."""

    def __init__(self, body):
        n_head = int(np.frombuffer(body, np.int64, 1)[0])
        head, at = np.frombuffer(body, np.int64, n_head, 8).tolist(), 8 * (n_head + 1)

        def part(kind, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, n, at)
            at += out.nbytes + -out.nbytes % _HEAD
            return out

        words, size, tables = head[:3]
        self.words, self.starts, self.ends, self.item = part(np.uint64, words), *(part(np.int32, words) for _ in range(3))
        self.data, self.tables = part(np.uint8, size), []
        for k in range(tables):
            m, bits, n = head[3 + 3 * k : 6 + 3 * k]
            shift, edges = part(np.uint8 if m < 256 else np.int32, 1 << 64 - bits), part(np.int32, (1 << 64 - bits) + 1)
            self.tables.append(Patterns(m, bits, self.words, shift, edges, part(np.int32, n), part(np.uint64, n)))

    @classmethod
    def open(cls, path: str) -> Benchmark:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, data: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, row_at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Yield (first word, words, place of the item) of each confirmed occurrence."""
        for table in self.tables:
            for p, k in zip(*(x.tolist() for x in table.scan(words, row_at)), strict=True):
                pairs = zip(starts[p : p + table.m].tolist(), ends[p : p + table.m].tolist(), self.starts[k : k + table.m].tolist(), self.ends[k : k + table.m].tolist(), strict=True)
                if all(data[a:b].tobytes() == self.data[c:d].tobytes() for a, b, c, d in pairs):
                    yield p, table.m, int(self.item[k])


def _pass(files: list[tuple[str, str]], schema: pa.Schema):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for tables, names in files:
            with pa.OSFile(SparkFiles.get(names)) as f:
                blocks.append((Benchmark.open(SparkFiles.get(tables)), pa.ipc.open_file(f).read_all()["item"].combine_chunks()))
        for batch in batches:
            names = batch.schema.names
            n_words, hits, items = np.zeros(len(batch), np.int64), [None] * len(batch), [None] * len(batch)
            for first, end, raw, offs in slices(batch.column(names.index("text"))):
                data = LOWER[raw]
                starts, ends, row_at = runs(data, offs, ALNUM)
                n_words[first:end] = np.diff(row_at)
                words = hash_spans(data, starts, ends)
                marks: dict[int, set[int]] = defaultdict(set)
                said: dict[int, set[str]] = defaultdict(set)
                for block, item in blocks:
                    found = list(block.find(data, words, starts, ends, row_at))
                    owner = np.searchsorted(row_at, [p for p, _, _ in found], "right") - 1 if found else np.empty(0, np.int64)
                    for (p, m, which), row in zip(found, owner.tolist(), strict=True):
                        k = p - int(row_at[row])
                        marks[row].update(range(k, k + m))
                        if item[which].is_valid:
                            said[row].add(item[which].as_py())
                for row, places in marks.items():
                    hits[first + row], items[first + row] = sorted(places), sorted(said[row])
            keep = [batch.column(names.index(f.name)) for f in schema if f.name not in ("n_words", "hits", "items")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(n_words), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], schema=schema)

    return scan


def _share(spark, rows: list[tuple[str | None, bytes]], window: int) -> tuple[str, str]:
    """The names of a block's two files: its tables and its items' ids."""
    name = f"benchmark-{uuid.uuid4().hex}"
    sink = pa.BufferOutputStream()
    ids = pa.table({"item": pa.array([r[0] for r in rows], pa.string())})
    with pa.ipc.new_file(sink, ids.schema) as f:
        f.write_table(ids)
    share_file(spark, f"{name}.items", sink.getvalue().to_pybytes())
    share_file(spark, f"{name}.tables", build_tables([r[1] for r in rows], window))
    return f"{name}.tables", f"{name}.items"


def _shared_blocks(benchmark: DataFrame, block_bytes: int, window: int) -> list[tuple[str, str]]:
    """Write the blocks one by one; only one is in memory at a time."""
    files, rows, size = [], [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        if text:
            rows.append((item, text.encode("utf-8", "surrogatepass")))
            size += len(rows[-1][1])
        if size >= block_bytes:
            files.append(_share(benchmark.sparkSession, rows, window))
            rows, size = [], 0
    return [*files, _share(benchmark.sparkSession, rows, window)] if rows else files


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` (doc_id) with n_words, hits (array of the hit
    words' places, null for none) and items (array of item ids as strings,
    null for none), a row for each document."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(docs.sparkSession)
    keep = keep or ["doc_id"]
    out = docs.select(*keep, F.col("text").cast("string").alias("text")) if "text" not in keep else docs.select(*keep)
    files = _shared_blocks(benchmark, block_bytes, window)
    kept = ", ".join(f"`{c}` {out.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kept}, n_words long, hits array<long>, items array<string>"
    arrow = to_arrow_schema(out.sparkSession.createDataFrame([], schema).schema)
    return out.mapInArrow(_pass(files, arrow), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    found = find_hits(docs, benchmark, window)
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.size("hits"), F.lit(0)).cast("long")
    n_hit = F.when(F.col("hits").isNull(), F.lit(0)).otherwise(n_hit).cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, all columns kept."""
    own = {c: "text" if c == "text" else f"_{k}" for k, c in enumerate(docs.columns)}
    found = find_hits(docs.select(*(F.col(f"`{c}`").alias(a) for c, a in own.items())), benchmark, window, keep=list(own.values()))
    return found.where(F.col("hits").isNull()).select(*(F.col(a).alias(c) for c, a in own.items()))


def op8(spark, sf_dir: str) -> DataFrame:
    from quarrylark.llm.shared import table

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Words of whole texts; windows as strings; a word is hit if an occurrence covers it.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bl AS (SELECT item_id, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bl)
), places AS (
  SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
), occ AS (
  SELECT p.r, p.i, k.m, k.item_id
  FROM (SELECT DISTINCT m FROM windows) AS lens, places p, windows k
  WHERE k.m = lens.m AND p.i + lens.m - 1 <= len(p.w) AND array_to_string(p.w[p.i:p.i + lens.m - 1], ' ') = k.win
), hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS j FROM occ) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM occ WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
