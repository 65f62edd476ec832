"""Vector bin packing of training examples by the dot-product heuristic.

A sequence is limited in three ways at once: tokens, segments (pieces of
examples in it) and tokens that bear loss. Examples are dealt evenly over
shards. A shard fills one sequence after the other: of the examples that fit
all three of what is left, the one with the greatest dot product of its
demands and what is left goes in next, each dimension as a share of its limit
and weighted by the mean demand; an example that closes the tokens exactly
goes first. Equal scores go by the example's number.

Examples that may be cut (`cuttable`: plain documents, where every token bears
loss) leave no padding: where none fits whole, the longest one is cut at what
is left, and its rest waits for another sequence. A sequence that its segments
close, or the shard's last, is cut back to a power of two, a length that needs
no padding, and what was cut off is placed anew. Examples that may not be cut
(instruction data) stay whole; one that exceeds a limit by itself is not
dropped, it has a sequence of its own, marked `over`.

Ids go through one shuffle, in whole sequences of a long document and rests
below one, so a group holds at most `SHARD` short pieces or `SHARD_BYTES` of
text, whatever the documents' lengths. One long text is encoded at once in
its task, with about 21 bytes of arrays for each of its bytes.

A null text counts as empty: one piece that holds only end_id. Rows are packed
one by one, so repeated rows are packed repeatedly. An empty table gives an
empty result. Other columns are ignored. A conversation's tokens are those of
its turns, a null role or text as an empty one, a null conv_id is one
conversation.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylark.llm.packing import Encoder
from quarrylark.llm.shared import bounded_batches, table

SHARD, SHARD_BYTES = 4096, 16 << 20
_GONE = 1 << 40


class Limits(NamedTuple):
    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


LIMITS = Limits()


#: 1 a letter or digit of ASCII, 2 its other printing characters, 4 its white space.
_KIND = np.array([1 if b < 128 and chr(b).isalnum() else 2 if 33 <= b <= 126 else 4 if b == 32 or 9 <= b <= 13 else 0 for b in range(256)], np.uint8)


class ByteEncoder(Encoder):
    """A byte-level tokenizer. Texts are encoded apart where one of its tokens
    always ends: where white space of ASCII follows a printing character, and
    where other characters of ASCII follow its letters or digits. A character
    of two bytes prints unless it is one of U+0080 to U+00BF."""

    def spans(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(raw):
            return raw, np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = _KIND[raw]
        prints = (kind == 1) | (kind == 2)
        prints[1:] |= (raw[1:] >= 128) & (raw[:-1] >= 0xC3) & (raw[:-1] <= 0xDF)
        opens = np.zeros(len(raw) + 1, bool)
        opens[1:-1] = (kind[1:] == 4) & prints[:-1] | (kind[1:] == 2) & (kind[:-1] == 1)
        opens[offs] = True
        starts = np.flatnonzero(opens[:-1])
        return raw, starts, np.append(starts[1:], len(raw))


def document_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, start, doc_tokens, ids (4 bytes each, little-endian) of each
    whole sequence of a document and of its rest."""
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder.at(SparkFiles.get(name))
        for batch in batches:
            row, start, total, ids_of, held = [], [], [], [], 0
            said = encoder.rows(batch.column(1), end_id)

            def flush() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(total, pa.int64()), pa.array(ids_of, pa.binary())], names=["doc_id", "start", "doc_tokens", "ids"]
                )
                for held_list in (row, start, total, ids_of):
                    held_list.clear()
                return out

            for r, ids in said:
                for at in range(0, len(ids), capacity):
                    body = ids[at : at + capacity].astype("<u4").tobytes()
                    row.append(r), start.append(at), total.append(len(ids)), ids_of.append(body)
                    held += len(body)
                    if held > 4 << 20:
                        yield flush()
                        held = 0
            yield flush()

    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, doc_tokens long, ids binary")


class Placed(NamedTuple):
    """One entry a piece: the example's place in the input, the piece's first
    token in it, its length, its sequence and its offset there."""

    example: np.ndarray
    start: np.ndarray
    length: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def place(tokens: np.ndarray, loss: np.ndarray, limits: Limits = LIMITS, cuttable: bool = False) -> Placed:
    """Fill sequences one after the other. Examples are not empty; where they
    may be cut all of their tokens bear loss."""
    n, cap = len(tokens), min(limits.tokens, limits.loss) if cuttable else limits.tokens
    most = np.array([cap, limits.segments, limits.loss], np.int64)
    need = np.stack([tokens, np.ones(n, np.int64), loss]).astype(np.int64) if n else np.zeros((3, 0), np.int64)
    at, left = np.zeros(n, np.int64), n
    share = need / most[:, None]
    weight = share.mean(axis=1) / most if n else np.zeros(3)
    out: list[tuple[int, int, int, int]] = []
    sequence = 0
    while left:
        room, pieces = most.copy(), []

        def take(i: int, k: int, room=room, pieces=pieces) -> None:
            nonlocal left
            pieces.append((i, int(at[i]), k))
            room -= (k, 1, k if cuttable else need[2, i])
            at[i] += k
            rest = int(need[0, i]) - k
            need[0, i] = rest or _GONE
            if cuttable and rest:
                need[2, i] = rest
                share[0, i], share[2, i] = rest / most[0], rest / most[2]
            left -= not rest

        while left and room[0] and room[1]:
            fits = (need[0] <= room[0]) & (need[2] <= room[2])
            closing = fits & (need[0] == room[0])
            if closing.any():
                take(int(closing.argmax()), int(room[0]))
                break
            score = np.where(fits, (weight * room) @ share, -1.0)
            i = int(score.argmax())
            if fits[i]:
                take(i, int(need[0, i]))
            elif cuttable:
                take(int(np.where(need[0] < _GONE, need[0], -1).argmax()), int(room[0]))
            elif not pieces:  # it exceeds a limit by itself
                i = int((need[0] < _GONE).argmax())
                take(i, int(need[0, i]))
                break
            else:
                break
        fill = sum(k for _, _, k in pieces)
        if cuttable and fill < limits.tokens:
            over = fill - (1 << fill.bit_length() - 1)
            while over:  # cut back to a power of two
                i, start, k = pieces.pop()
                gone = min(k, over)
                left += need[0, i] == _GONE
                need[0, i] = need[2, i] = gone + (0 if need[0, i] == _GONE else need[0, i])
                share[0, i], share[2, i] = need[0, i] / most[0], need[2, i] / most[2]
                at[i] -= gone
                over -= gone
                if gone < k:
                    pieces.append((i, start, k - gone))
        out += [(*p, sequence) for p in pieces]
        sequence += 1
    example, start, length, bins = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
    before = np.cumsum(length) - length
    opens = np.concatenate(([True], bins[1:] != bins[:-1])) if len(bins) else np.zeros(0, bool)
    return Placed(example, start, length, bins, before - np.maximum.accumulate(np.where(opens, before, 0)))


def pack_examples(examples: DataFrame, limits: Limits = LIMITS, cuttable: bool = False, shards: int = 1) -> DataFrame:
    """examples: tokens, loss (tokens that bear loss) and any other columns,
    `ids` and `start` among them if they are documents' pieces. Gives their
    pieces with sequence_id, offset, length and over; start and ids are the
    piece's own."""
    tokens, loss = F.greatest(F.col("tokens"), F.lit(1)).cast("long"), F.coalesce(F.col("loss"), F.lit(0)).cast("long")
    dealt = examples.withColumns({"tokens": tokens, "loss": loss, "_item": F.monotonically_increasing_id()}).withColumn("_shard", F.pmod(F.xxhash64("_item"), F.lit(shards)))
    rest = [c for c in examples.columns if c not in ("tokens", "loss", "start", "ids")]
    whole = "ids" in examples.columns

    def settle(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("_item")
        n, bearing = group["tokens"].to_numpy(), group["loss"].to_numpy()
        got = place(n, bearing, limits, cuttable)
        out = {c: group[c].take(pa.array(got.example)) for c in rest}
        out["sequence_id"] = pa.array((key[0].as_py() << 32) + got.sequence)
        out["offset"], out["length"] = pa.array(got.offset), pa.array(got.length)
        out["over"] = pa.array((got.length > limits.tokens) | (bearing[got.example] > limits.loss) & (not cuttable))
        if whole:
            out["start"] = pa.array(group["start"].to_numpy()[got.example] + got.start)
            bodies = group["ids"].combine_chunks() if isinstance(group["ids"], pa.ChunkedArray) else group["ids"]
            out["ids"] = pa.array([bodies[e].as_py()[4 * s : 4 * (s + k)] for e, s, k in zip(got.example.tolist(), got.start.tolist(), got.length.tolist(), strict=True)], pa.binary())
        return pa.table(out)

    kinds = [f"`{c}` {examples.schema[c].dataType.simpleString()}" for c in rest]
    kinds += ["sequence_id long", "offset long", "length long", "over boolean", *(["start long", "ids binary"] if whole else [])]
    bounded_batches(examples.sparkSession)
    return dealt.groupBy("_shard").applyInArrow(settle, ", ".join(kinds))


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = LIMITS, end_id: int = 1, shard: int = SHARD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, doc_tokens, start, length, ids, sequence_id, offset of every
    piece. The number of shards comes from the rows and bytes of all texts."""
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("b")).first()
    pieces = document_pieces(docs, tokenizer, limits.tokens, end_id).withColumns({"tokens": F.octet_length("ids") / 4, "loss": F.octet_length("ids") / 4})
    return pack_examples(pieces, limits, True, max(1, -(-size.n // shard), -(-size.b // shard_bytes))).drop("over")


def pack_conversations(talks: DataFrame, tokenizer: str, limits: Limits = LIMITS, end_id: int = 1, shard: int = SHARD, bearing: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, tokens, loss, sequence_id, offset, over of every conversation,
    none cut. A turn is its role and text in a line with end_id behind; the
    tokens of the roles in `bearing` bear loss. Turns are counted where they
    are read and summed by conversation, so no conversation is gathered."""
    talks.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder.at(SparkFiles.get(name))
        for batch in batches:
            sizes = [len(ids) for _, ids in encoder.rows(batch.column(2), end_id)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["conv_id", "bears", "n"])

    bounded_batches(talks.sparkSession)
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    lines = talks.select("conv_id", role.isin(*bearing).alias("bears"), F.concat(role, F.lit("\n"), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("line"))
    turns = lines.mapInArrow(count, f"conv_id {talks.schema['conv_id'].dataType.simpleString()}, bears boolean, n long")
    sizes = turns.groupBy("conv_id").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("bears"), F.col("n")).otherwise(0)).alias("loss"))
    sizes = sizes.withColumn("loss_tokens", F.col("loss"))
    n = talks.select("conv_id").distinct().count()
    return pack_examples(sizes, limits, False, max(1, -(-n // shard))).withColumnRenamed("length", "tokens")


def op11(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
