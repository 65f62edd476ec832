"""Best-fit packing: a grouping genetic algorithm over token sequences.

Tokens come from a public tokenizer file. The text is cut where the
tokenizer's own rules always cut (white space; between an ASCII letter or
digit and ASCII punctuation), each distinct word is encoded once for as long
as it stays in a bounded cache, and ids are put together by array indexing.
A document's ids end with `end_id`; documents longer than a sequence are cut
into whole sequences and a rest.

Pieces are dealt evenly over shards of about `shard` pieces. In each shard
several islands evolve packings apart, from different random orders: a
crossover injects well-filled bins of one parent into the other, removes the
bins that hold the same pieces and some of the emptiest, swaps displaced
pieces for shorter ones of the bins that stay, and best-fits the rest. The
islands' elites then migrate to one population, which evolves on. Islands and
the joint population always run all their generations. Plain best-fit
decreasing is only a yardstick: it is taken where evolution needs more bins.

Sequences that stay below `tight` of the capacity are opened again and their
pieces dealt anew over fewer shards, until one shard is left or a round saves
less than one sequence in a thousand of those it opened; so what the division
into shards costs is below that. Every piece is placed.

A null text counts as empty: one piece that holds only end_id. Rows are
packed one by one, so repeated rows are packed repeatedly. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylark.llm.bytescan import LOWER, SPACED, hash_spans, runs, slices
from quarrylark.llm.shared import bounded_batches, cut

CAPACITY, SHARD, TIGHT, SAVED = 2048, 4096, 0.995, 0.001
ISLANDS, POPULATION, GENERATIONS, CHILDREN = 3, 6, 10, 4
_SLOTS, _MOST_IDS = 1 << 20, 8 << 20
_CLASS = np.array([1 if 48 <= b <= 57 or 97 <= b <= 122 else 2 if b < 128 and SPACED[b] and b != 39 else 0 for b in range(256)], np.uint8)
_ENCODERS: dict[tuple[type, str], Encoder] = {}


class Encoder:
    """The tokenizer behind a direct-mapped cache of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    @classmethod
    def at(cls, path: str) -> Encoder:
        if (cls, path) not in _ENCODERS:
            _ENCODERS[cls, path] = cls(path)
        return _ENCODERS[cls, path]

    def _clear(self) -> None:
        self.keys, self.place, self.size = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int64), np.zeros(_SLOTS, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _store(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def spans(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes to encode and the starts and ends of what is encoded apart."""
        data = LOWER[raw]
        starts, ends, _ = runs(data, offs, SPACED)
        kind = _CLASS[data]
        inner = np.flatnonzero((kind[1:] ^ kind[:-1] == 3) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
        inner = inner[~np.isin(inner, offs)]
        return data, np.sort(np.concatenate((starts, inner)), kind="stable"), np.sort(np.concatenate((ends, inner)), kind="stable")

    def encode(self, raw: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice's rows and the rows' places in them (rows + 1)."""
        data, starts, ends = self.spans(raw, offs)
        row_at = np.searchsorted(starts, offs)
        if self.used > _MOST_IDS:
            self._clear()
        words = hash_spans(data, starts, ends)
        slot = (words & np.uint64(_SLOTS - 1)).astype(np.int64)
        place, size = self.place[slot], self.size[slot]
        missing = np.flatnonzero((self.keys[slot] != words) | (size == 0))
        if len(missing):
            new, first, back = np.unique(words[missing], return_index=True, return_inverse=True)
            at = missing[first]
            body = data.tobytes()
            said = [body[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(said, add_special_tokens=False)]
            sizes = np.array([len(g) for g in got], np.int64)
            base = self._store(np.array([i for g in got for i in g], np.uint32))
            places = base + np.cumsum(sizes) - sizes
            place[missing], size[missing] = places[back], sizes[back]
            s = slot[at]
            self.keys[s], self.place[s], self.size[s] = new, places, sizes
        end_at = self._store(np.array([end_id], np.uint32))
        place, size = np.insert(place, row_at[1:], end_at), np.insert(size, row_at[1:], 1).astype(np.int64)
        row_at = row_at + np.arange(len(row_at))
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(place - total[:-1], size) + np.arange(total[-1])]
        return ids, total[row_at]

    def rows(self, column: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray]]:
        for first, end, raw, offs in slices(column):
            ids, at = self.encode(raw, offs, end_id)
            whole = raw.tobytes()
            special = any(s in whole for s in self.specials)
            for r in range(end - first):
                text = whole[offs[r] : offs[r + 1]] if special else b""
                if special and any(s in text for s in self.specials):
                    said = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
                    yield first + r, np.array([*said, end_id], np.uint32)
                else:
                    yield first + r, ids[at[r] : at[r + 1]]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document.
    The driver's tokenizer file goes to the executors as a file of the job."""
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(SparkFiles.get(name))
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for r, ids in encoder.rows(batch.column(1), end_id):
                body = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    n = min(capacity, len(ids) - at)
                    row.append(r), piece.append(k), start.append(at), length.append(n)
                    crc.append(zlib.crc32(body[4 * at : 4 * (at + n)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], items: list[int], assigned: list[int], free: list[int], capacity: int) -> None:
    """Put each item into the fullest bin that takes it, opening bins as needed."""
    by_free: dict[int, list[int]] = {}
    mask = 0
    for b, room in enumerate(free):
        if room:
            by_free.setdefault(room, []).append(b)
            mask |= 1 << room
    for i in items:
        n = lengths[i]
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            bins = by_free[room]
            b = bins.pop()
            if not bins:
                mask &= ~(1 << room)
        else:
            b, room = len(free), capacity
            free.append(capacity)
        assigned[i] = b
        room -= n
        free[b] = room
        if room:
            by_free.setdefault(room, []).append(b)
            mask |= 1 << room


def swap_in(lengths: list[int], items: list[int], assigned: list[int], free: list[int], staying: list[int]) -> list[int]:
    """Let the longest waiting item that its bin can take replace each shorter
    one of those that stay. Returns the items that wait then."""
    by_length: dict[int, list[int]] = {}
    mask = 0
    for i in items:
        by_length.setdefault(lengths[i], []).append(i)
        mask |= 1 << lengths[i]
    for i in staying:
        room, n = free[assigned[i]], lengths[i]
        fits = mask >> n + 1 & (1 << room) - 1
        if fits:
            longer = n + fits.bit_length()
            j = by_length[longer].pop()
            if not by_length[longer]:
                mask &= ~(1 << longer)
            assigned[j], assigned[i] = assigned[i], -1
            free[assigned[j]] = room - (longer - n)
            by_length.setdefault(n, []).append(i)
            mask |= 1 << n
    return [i for same in by_length.values() for i in same]


def packed(order: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    assigned = [0] * len(lengths)
    best_fit(lengths.tolist(), order.tolist(), assigned, [], capacity)
    return np.array(assigned, np.int64)


def decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit decreasing, the yardstick."""
    return packed(np.argsort(-lengths, kind="stable"), lengths, capacity)


def random_packing(lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Best fit in the order of the lengths under a noise of random strength."""
    noise = rng.uniform(0.1, 0.9)
    return packed(np.argsort(-lengths * rng.uniform(1 - noise, 1 + noise, len(lengths)), kind="stable"), lengths, capacity)


def crossover(into: np.ndarray, of: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Inject the best-filled bins of one packing into another."""
    fill = np.bincount(of, lengths) / capacity + rng.normal(0, 0.02, int(of.max()) + 1)
    chosen = np.zeros(len(fill), bool)
    chosen[np.argsort(-fill)[: max(1, int(len(fill) * rng.uniform(0.2, 0.6)))]] = True
    injected = chosen[of]
    opened = np.zeros(int(into.max()) + 1, bool)
    opened[into[injected]] = True
    left = np.flatnonzero(~opened)
    if len(left):
        fill = np.bincount(into, lengths)[left]
        opened[left[np.argsort(fill, kind="stable")[: max(1, len(left) // 50)]]] = True
    kept = ~injected & ~opened[into]
    child = np.full(len(into), -1)
    child[injected] = np.unique(of[injected], return_inverse=True)[1]
    if kept.any():
        child[kept] = int(child.max()) + 1 + np.unique(into[kept], return_inverse=True)[1]
    free = (capacity - np.bincount(child[child >= 0], lengths[child >= 0])).astype(int).tolist()
    n, out = lengths.tolist(), child.tolist()
    waiting = swap_in(n, np.flatnonzero(child < 0).tolist(), out, free, np.flatnonzero(kept).tolist())
    best_fit(n, sorted(waiting, key=lambda i: -n[i]), out, free, capacity)
    return np.array(out, np.int64)


class Evolved(NamedTuple):
    bins: np.ndarray
    generations: int
    crossovers: int


def evolve(lengths: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int, population: int = POPULATION, generations: int = GENERATIONS, children: int = CHILDREN) -> Evolved:
    """The fewest bins found in so many generations, the fuller packing where
    several need as few. Without elites the population is random."""
    if not len(lengths):
        return Evolved(np.zeros(0, np.int64), 0, 0)
    rng = np.random.default_rng(seed)

    def scored(bins: np.ndarray) -> tuple[int, float, np.ndarray]:
        fill = np.bincount(bins, lengths) / capacity
        return -len(fill), float((fill**2).sum()), bins

    pool = [scored(e) for e in elites]
    pool += [scored(random_packing(lengths, capacity, rng)) for _ in range(population - len(pool))]
    crossovers = 0
    for _ in range(generations):
        pool = sorted(pool, key=lambda x: x[:2], reverse=True)[:population]
        for _ in range(children):
            a, b = rng.choice(max(2, len(pool) // 2 + 1), 2, replace=False)
            pool.append(scored(crossover(pool[a][2], pool[b][2], lengths, capacity, rng)))
            crossovers += 1
    return Evolved(max(pool, key=lambda x: x[:2])[2], generations, crossovers)


def _round(items: DataFrame, shards: int, level: int, capacity: int, islands: int) -> DataFrame:
    """items: doc_id, piece, start, length, ids_crc32, item (unique). Adds sequence_id, offset, fill."""
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)))
    copies = dealt.select("shard", "item", "length").withColumn("island", F.explode(F.array(*[F.lit(k) for k in range(islands)])))

    def island(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("item")
        n = table["length"].to_numpy()
        small = n < capacity
        bins = np.zeros(len(n), np.int64)
        bins[small] = evolve(n[small], [], capacity, key[0].as_py() * islands + key[1].as_py()).bins
        return pa.table({"shard": table["shard"], "item": table["item"], "island": table["island"].cast(pa.int32()), "bin": pa.array(bins)})

    elites = copies.groupBy("shard", "island").applyInArrow(island, "shard long, item long, island int, bin long")

    def settle(key: tuple, table: pa.Table, elite: pa.Table) -> pa.Table:
        table, elite = table.sort_by("item"), elite.sort_by([("island", "ascending"), ("item", "ascending")])
        n = table["length"].to_numpy()
        small = n < capacity
        bins = np.zeros(len(n), np.int64)
        if small.any():
            found = evolve(n[small], [b[small] for b in elite["bin"].to_numpy().reshape(-1, len(n))], capacity, key[0].as_py()).bins
            bins[small] = min(found, decreasing(n[small], capacity), key=lambda x: int(x.max()))
        bins[~small] = (int(bins[small].max()) + 1 if small.any() else 0) + np.arange(int((~small).sum()))
        order = np.argsort(bins, kind="stable")
        fill, before = np.bincount(bins, n).astype(np.int64), np.zeros(len(n), np.int64)
        total = np.cumsum(n[order]) - n[order]
        first = np.concatenate(([True], bins[order][1:] != bins[order][:-1])) if len(n) else np.zeros(0, bool)
        before[order] = total - np.maximum.accumulate(np.where(first, total, 0))
        base = (level << 56) + (key[0].as_py() << 20)
        table = table.drop_columns(["shard"])
        return table.append_column("sequence_id", pa.array(base + bins)).append_column("offset", pa.array(before)).append_column("fill", pa.array(fill[bins]))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return dealt.groupBy("shard").cogroup(elites.groupBy("shard")).applyInArrow(settle, f"{kinds}, sequence_id long, offset long, fill long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, shard: int = SHARD, islands: int = ISLANDS, tight: float = TIGHT, saved: float = SAVED) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    items = cut(token_pieces(docs, tokenizer, capacity, end_id)).withColumn("item", F.monotonically_increasing_id())
    done, level, opened = [], 0, None
    n = items.count()
    while True:
        shards = max(1, -(-n // shard))
        placed = _round(items, shards, level, capacity, islands)
        if shards == 1:
            done.append(placed)
            break
        placed = cut(placed)
        loose = F.col("fill") < int(tight * capacity)
        first = F.col("offset") == 0
        now, left, still = placed.agg(F.count_if(first), F.count_if(loose), F.count_if(first & loose)).first()
        if not left or opened is not None and opened - now < saved * opened:
            done.append(placed)
            break
        done.append(placed.where(~loose))
        items, n, level, opened = placed.where(loose).select(*items.columns), left, level + 1, still
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quarrylark.llm.shared import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
