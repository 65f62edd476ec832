"""Quality classifier: a sparse rule ensemble.

Statistics of each whole text are taken by numpy over Arrow batches. Boosted
trees are grown on the labelled rows; every path from a root to a node is a
conjunctive rule; a lasso-penalised logistic regression weighs the rules and
drops most of them; the rest are compiled into one Spark column expression.

Learning reads `quality` of labelled rows that are not held out, at most
about `max_rows` of them (a bounded sample by a hash of doc_id). Null labels
are skipped; a document with both labels counts once for each. Without labels of
both kinds the score is the share of label 1, or 0.5 with no label. A null
text counts as empty and gets the score of an empty text. Rows are scored
one by one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylark.llm.bytescan import SPACED, hash_spans, mix64, runs, slices
from quarrylark.llm.shared import bounded_batches, held_out

MAX_ROWS = 20_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, PENALTY = 24, 3, 32, 0.3, 0.0005

STATISTICS = [
    "log_chars", "log_words", "word_len", "upper", "digit", "space", "punct", "symbol", "bang", "pipe", "high",
    "repeat_next", "distinct", "symbol_end", "repeat_lines", "words_per_line", "long_words",
]


def _bytes_in(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars))


_UPPER, _DIGIT, _HIGH = _bytes_in(bytes(range(65, 91))), _bytes_in(b"0123456789"), np.arange(256) >= 192
_PUNCT, _SYMBOL = _bytes_in(b".,;:'\"()-?"), _bytes_in(b"#$%&*+/<=>@[\\]^_`{}~")
_LINE = np.arange(256) != 10


def _distinct(hashes: np.ndarray, row_at: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(row_at) - 1), np.diff(row_at))
    keys, at = np.unique(mix64(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(row[at], minlength=len(row_at) - 1)


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text of a slice."""

    def per_row(mask: np.ndarray, at: np.ndarray = offs) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[at[1:]] - total[at[:-1]]

    size = np.maximum(np.diff(offs), 1)
    starts, ends, row_at = runs(data, offs, SPACED)
    words = hash_spans(data, starts, ends)
    n = np.diff(row_at)
    some = np.maximum(n, 1)
    follows = np.zeros(len(words), bool)
    follows[1:] = words[1:] == words[:-1]
    follows[row_at[:-1][row_at[:-1] < len(words)]] = False
    last = data[ends - 1] if len(ends) else np.empty(0, np.uint8)
    lines, line_ends, line_at = runs(data, offs, _LINE)
    n_lines = np.diff(line_at)
    chars = per_row((data & 0xC0) != 0x80)
    share = lambda table: per_row(table[data]) / size
    return np.column_stack([
        np.log1p(chars), np.log1p(n), per_row((data & 0xC0) != 0x80) / some, share(_UPPER), share(_DIGIT), share(~SPACED), share(_PUNCT), share(_SYMBOL),
        share(_bytes_in(b"!")), share(_bytes_in(b"|")), share(_HIGH), per_row(follows, row_at) / some, _distinct(words, row_at) / some, per_row((_SYMBOL | _bytes_in(b"!"))[last], row_at) / some,
        1 - _distinct(hash_spans(data, lines, line_ends), line_at) / np.maximum(n_lines, 1), n / np.maximum(n_lines, 1), per_row(ends - starts > 24, row_at) / some,
    ]).round(9)


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and one double column f_<statistic> for each statistic."""
    bounded_batches(docs.sparkSession)
    fields = [*keep, *(["text"] if "text" not in keep else [])]
    docs = docs.select(*fields[: len(keep)], *([F.col("text").cast("string").alias("text")] if "text" not in keep else []))
    place = fields.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offs in slices(batch.column(place).cast(pa.string())):
                values = statistics(data, offs)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, end - first) for i in range(len(keep))), *(pa.array(v) for v in np.ascontiguousarray(values.T))], names=[*keep, *(f"f_{s}" for s in STATISTICS)])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(scan, ", ".join([kinds, *(f"f_{s} double" for s in STATISTICS)]))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, over, threshold), sorted


def _grow(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, at: np.ndarray, depth: int, path: Rule, out: list[tuple[Rule, float]], step: np.ndarray) -> None:
    value = -grad[at].sum() / (hess[at].sum() + 1.0)
    if path:
        out.append((tuple(sorted(set(path))), value))
    step[at] = value
    if not depth or len(at) < 40:
        return
    best, where = 1e-6, None
    total_g, total_h = grad[at].sum(), hess[at].sum()
    for j, cuts in enumerate(edges):
        if not len(cuts):
            continue
        g = np.bincount(binned[at, j], grad[at], len(cuts) + 1).cumsum()[:-1]
        h = np.bincount(binned[at, j], hess[at], len(cuts) + 1).cumsum()[:-1]
        gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
        k = int(gain.argmax())
        if gain[k] > best:
            best, where = gain[k], (j, k)
    if where:
        j, k = where
        over = binned[at, j] > k
        for side in (False, True):
            if len(part := at[over == side]):
                _grow(binned, edges, grad, hess, part, depth - 1, (*path, (j, side, float(edges[j][k]))), out, step)


def _holds(rule: Rule, values: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(values[:, j] > t) == over for j, over, t in rule])


class RuleEnsemble:
    """Weighted conjunctive rules over statistics; score() as a column."""

    def __init__(self, bias: float, rules: list[tuple[Rule, float]]):
        self.bias, self.rules = bias, rules

    @classmethod
    def fit(cls, values: np.ndarray, label: np.ndarray, penalty: float = PENALTY) -> RuleEnsemble:
        if not len(label) or label.min() == label.max():
            share = float(label.mean()) if len(label) else 0.5
            share = min(max(share, 1e-6), 1 - 1e-6)
            return cls(float(np.log(share / (1 - share))), [])
        edges = []
        for j in range(values.shape[1]):
            q = np.unique(np.quantile(values[:, j], np.linspace(0, 1, BINS + 1)[1:-1]))
            edges.append(q[q < values[:, j].max()])
        binned = np.column_stack([np.searchsorted(e, values[:, j], "left") for j, e in enumerate(edges)])
        margin, found = np.zeros(len(label)), {}
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            nodes, step = [], np.zeros(len(label))
            _grow(binned, edges, p - label, p * (1 - p), np.arange(len(label)), DEPTH, (), nodes, step)
            found |= dict.fromkeys(r for r, _ in nodes)
            margin += RATE * step
        rules = list(found)
        x = np.column_stack([np.ones(len(label)), *(_holds(r, values) for r in rules)]).astype(np.float32)
        w = np.zeros(x.shape[1], np.float32)
        w[0] = np.log(label.mean() / (1 - label.mean()))
        y, speed, target = w.copy(), 4 / (np.linalg.norm(x, 2) ** 2 / len(label)), label.astype(np.float32)
        t = 1.0
        for _ in range(300):
            grad = x.T @ (1 / (1 + np.exp(-(x @ y))) - target) / len(label)
            new = y - speed * grad
            new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - speed * penalty, 0)
            t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
            y, w, t = new + (t - 1) / t_new * (new - w), new, t_new
        return cls(float(w[0]), [(r, float(v)) for r, v in zip(rules, w[1:].tolist(), strict=True) if v])

    def score(self) -> Column:
        """The probability of label 1 over the f_ columns."""
        margin = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = reduce(lambda a, b: a & b, [(F.col(f"f_{STATISTICS[j]}") > F.lit(t)) if over else (F.col(f"f_{STATISTICS[j]}") <= F.lit(t)) for j, over, t in rule])
            margin = margin + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> RuleEnsemble:
    labels = labels.select("doc_id", "quality").where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    n = labels.count()
    if n > max_rows:  # a hash of the id chooses a share that gives about max_rows
        share = max_rows / n
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * max_rows)
    taught = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(labels), "doc_id")
    taught = with_statistics(taught, ["doc_id", "quality"]).groupBy("doc_id", "quality").agg(F.min(F.struct(*(f"f_{s}" for s in STATISTICS))).alias("f"))
    rows = taught.select("doc_id", "quality", "f.*").orderBy("doc_id", "quality").toPandas()
    return RuleEnsemble.fit(rows[[f"f_{s}" for s in STATISTICS]].to_numpy(float), rows["quality"].to_numpy(float))


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    model = fit_quality(docs, labels, max_rows)
    scored = with_statistics(docs, ["doc_id"]).select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, all columns kept."""
    model = fit_quality(docs, labels, max_rows)
    own = {c: "text" if c == "text" else f"_{k}" for k, c in enumerate(docs.columns)}
    marked = with_statistics(docs.select(*(F.col(f"`{c}`").alias(a) for c, a in own.items())), list(own.values()))
    return marked.where(model.score() >= threshold).select(*(F.col(a).alias(c) for c, a in own.items()))


def op7(spark, sf_dir: str) -> DataFrame:
    from quarrylark.llm.shared import table

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
