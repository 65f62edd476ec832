"""Language identification by language-bitmask n-gram filters.

A gram is four consecutive bytes of the lower-cased text in which every run
of non-letters is one space. Counting grams over all training documents
gives each gram's relative frequency in each language. A gram belongs to
every language where that frequency is at least `floor`, so at most 1/floor
grams belong to one language, the bound of what reaches the driver. A
bit-sliced Bloom filter keeps a mask of languages in every slot; the masks at
a gram's slots, joined by AND, are all languages that contain it.
A document's grams are counted per language bit,
the counts are corrected for the filter's false positives, and the largest
wins (the first by name in a tie).

Training documents have a non-null lang and are not held out. Text, and of
training rows lang, are all that is read. A null text, or one without any
letter, is `und` with score 0; so is any text when nothing was learned. The
score is the winner's share of its own and the runner-up's corrected counts.
A text whose grams are all unknown gets the most frequent language of the
training rows with score 0. Rows are judged one by one; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylark.llm.bytescan import LOWER, mix64, slices
from quarrylark.llm.shared import bounded_batches, cut, held_out

FLOOR, PROBES, BITS_PER_GRAM, MIN_SLOTS = 2e-5, 4, 16, 1 << 12
_LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])


def grams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, row) of every gram of a slice; rows do not run into each other."""
    data = LOWER[raw]
    letter = _LETTER[data]
    data = np.where(letter, data, np.uint8(32))
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each run of letters
    data, row = data[keep].astype(np.uint32), row[keep]
    if len(data) < 4:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    gram = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
    inside = row[:-3] == row[3:]
    return gram[inside], row[:-3][inside]


class BitslicedBloom:
    """A Bloom filter whose slots hold one bit for each of many sets."""

    def __init__(self, members: list[np.ndarray]):
        most = max([len(m) for m in members], default=0)
        self.slots = max(MIN_SLOTS, 1 << int(np.ceil(np.log2(max(1, most * BITS_PER_GRAM)))))
        self.words = -(-max(1, len(members)) // 64)
        self.masks = np.zeros((self.slots, self.words), np.uint64)
        self.false_positive = np.zeros(len(members))
        for k, grams_of in enumerate(members):
            bit = np.uint64(1 << (k % 64))
            for at in self._at(grams_of):
                np.bitwise_or.at(self.masks[:, k // 64], at, bit)
            full = np.count_nonzero(self.masks[:, k // 64] & bit) / self.slots
            self.false_positive[k] = full**PROBES

    def _at(self, gram: np.ndarray) -> Iterator[np.ndarray]:
        h = mix64(gram.astype(np.uint64))
        step = (h >> np.uint64(32)) | np.uint64(1)
        for k in range(PROBES):
            yield ((h + np.uint64(k) * step) & np.uint64(self.slots - 1)).astype(np.int64)

    def languages(self, gram: np.ndarray) -> np.ndarray:
        """Masks of all sets that contain each gram, [grams, words]."""
        out = None
        for at in self._at(gram):
            out = self.masks[at] if out is None else out & self.masks[at]
        return out


class LanguageModel:
    def __init__(self, names: list[str], members: list[np.ndarray], common: str | None):
        self.names, self.common = names, common
        self.filter = BitslicedBloom(members)

    def predict(self, raw: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offs) - 1
        letters = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(_LETTER[LOWER[raw]], out=letters[1:])
        ascii_letters = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((LOWER[raw] >= 97) & (LOWER[raw] <= 122), out=ascii_letters[1:])
        has = ascii_letters[offs[1:]] > ascii_letters[offs[:-1]]
        for r in np.flatnonzero(~has & (letters[offs[1:]] > letters[offs[:-1]])).tolist():
            has[r] = any(c.isalpha() for c in raw[offs[r] : offs[r + 1]].tobytes().decode("utf-8", "replace") if c != "�")
        if not self.names:
            return ["und"] * n, np.zeros(n)
        gram, row = grams(raw, offs)
        total = np.bincount(row, minlength=n)
        masks = self.filter.languages(gram) if len(gram) else np.zeros((0, self.filter.words), np.uint64)
        counts = np.empty((n, len(self.names)))
        for k in range(len(self.names)):
            inside = (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
            counts[:, k] = np.bincount(row, inside.astype(float), minlength=n)
        fp = self.filter.false_positive
        counts = np.maximum((counts - fp * total[:, None]) / np.maximum(1 - fp, 1e-9), 0)
        best = counts.argmax(axis=1)
        top = counts[np.arange(n), best]
        second = np.partition(counts, -2, axis=1)[:, -2] if len(self.names) > 1 else np.zeros(n)
        score = np.where(has & (top > 0), top / np.maximum(top + second, 1e-12), 0.0)
        said = [(self.names[b] if t > 0 else self.common) if h else "und" for b, t, h in zip(best.tolist(), top.tolist(), has.tolist(), strict=True)]
        return said, score


def learn_languages(docs: DataFrame, floor: float = FLOOR) -> LanguageModel:
    bounded_batches(docs.sparkSession)
    taught = docs.where(F.col("lang").isNotNull() & ~held_out()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            names, code = lang.dictionary, lang.indices.to_numpy(zero_copy_only=False)
            parts = []
            for first, _, raw, offs in slices(batch.column(1)):
                gram, row = grams(raw, offs)
                parts.append(np.unique((code[first + row].astype(np.uint64) << np.uint64(32)) | gram, return_counts=True))
            keys = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.uint64)
            each = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int64)
            keys, back = np.unique(keys, return_inverse=True)
            rows = np.bincount(code, minlength=len(names))
            yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array([-1] * len(names), pa.int64()), pa.array(rows.astype(np.int64))], names=["lang", "gram", "n"])
            yield pa.RecordBatch.from_arrays(
                [names.cast(pa.string()).take(pa.array((keys >> np.uint64(32)).astype(np.int64))), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(np.bincount(back, each, len(keys)).astype(np.int64))],
                names=["lang", "gram", "n"],
            )

    counted = cut(taught.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r.lang: (r.rows, r.grams) for r in counted.groupBy("lang").agg(F.sum(F.when(F.col("gram") < 0, F.col("n")).otherwise(0)).alias("rows"), F.sum(F.when(F.col("gram") >= 0, F.col("n")).otherwise(0)).alias("grams")).collect()}
    names = sorted(totals)
    if not names:
        return LanguageModel([], [], None)
    size = F.element_at(F.create_map(*[F.lit(x) for k in names for x in (k, float(max(1, totals[k][1])))]), F.col("lang"))
    by = counted.where((F.col("gram") >= 0) & (F.col("n") / size >= floor)).select("gram", "lang").toPandas()
    members = [np.sort(by.gram[by.lang == k].to_numpy(np.uint32)) for k in names]
    return LanguageModel(names, members, max(names, key=lambda k: (totals[k][0], [-ord(c) for c in k])))


def identify_languages(docs: DataFrame, floor: float = FLOOR) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document."""
    model = docs.sparkSession.sparkContext.broadcast(learn_languages(docs, floor))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, offs in slices(batch.column(1)):
                said, score = model.value.predict(raw, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(said, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = docs.mapInArrow(predict, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4(spark, sf_dir: str) -> DataFrame:
    from quarrylark.llm.shared import table

    return identify_languages(table(spark, sf_dir, "documents"))
