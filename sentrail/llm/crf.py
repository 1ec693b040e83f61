"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line that has a word is labelled good or bad. Its potentials use its own features and those of the lines
before and after it; a transition weight ties neighbouring labels. Training lines take the label of their
document. The score of a document is the length-weighted mean of the lines' forward-backward marginals for good.

The field is fitted on a bounded sample of whole labelled documents (at most ``sample``, and no more than have
``most_lines`` lines together); scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from sentrail.llm._text import byte_table, chunks, map_rows, mix, NOT_SPACE, tidily, Words, written

SAMPLE = 4000
MOST_LINES = 1_000_000
CUTOFF = 0.3
FOLDS, HELD_OUT = 5, 0

_UPPER = byte_table(lambda b: 0x41 <= b <= 0x5A)
_LETTER = byte_table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
_DIGIT = byte_table(lambda b: 0x30 <= b <= 0x39)
_SYMBOL = byte_table(lambda b: chr(b) in "#*$%&<>^~=_{}[]\\")
_PIPE = byte_table(lambda b: chr(b) == "|")
_BANG = byte_table(lambda b: chr(b) == "!")
_POINT = byte_table(lambda b: chr(b) in ".,;:?'\"()-")
_FINAL = byte_table(lambda b: chr(b) in ".!?")
N_FEATURES = 13


def _first_of(keys: np.ndarray) -> np.ndarray:
    """Marks the first place of every distinct key."""
    first = np.zeros(len(keys), dtype=bool)
    first[np.unique(keys, return_index=True)[1]] = True
    return first


def line_features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of a chunk, their lengths in bytes, and the first line of each row."""
    w = Words(col, NOT_SPACE)
    rows = len(w.offs) - 1
    if not len(w.s):
        return np.zeros((0, N_FEATURES)), np.zeros(0), np.zeros(rows + 1, dtype=np.int64)
    breaks = np.cumsum(w.data == 10)[w.s]
    row = w.row_of_word()
    new = np.ones(len(w.s), dtype=bool)
    new[1:] = (breaks[1:] != breaks[:-1]) | (row[1:] != row[:-1])
    a = np.flatnonzero(new)  # first word of each line
    b = np.append(a[1:], len(w.s))
    n = (b - a).astype(float)
    line = np.cumsum(new) - 1
    start, end = w.s[a], w.e[b - 1]
    size = (end - start).astype(float)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[w.data], dtype=np.int64)])
        return (total[end] - total[start]).astype(float)

    def by_line(flag: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flag.astype(float), a)

    h = w.hashes()
    with np.errstate(over="ignore"):
        first = _first_of(mix(h + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        whole = np.add.reduceat(h * mix(np.arange(len(h), dtype=np.uint64) - np.repeat(a, b - a).astype(np.uint64)), a)
        again = ~_first_of(mix(whole + row[a].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & ~new[1:]
    letters = np.maximum(share(_LETTER), 1)
    word_bytes = by_line(w.e - w.s)
    x = np.stack(
        [
            np.log1p(n),
            np.log(word_bytes / n),
            share(_UPPER) / letters,
            share(_SYMBOL) / size,
            np.minimum(share(_BANG) / n, 2),
            share(_DIGIT) / size,
            np.minimum(share(_PIPE) / n, 1),
            by_line(same) / n,
            1 - by_line(first) / n,
            by_line(w.e - w.s <= 3) / n,
            again.astype(float),
            _FINAL[w.data[end - 1]].astype(float),
            np.minimum(share(_POINT) / n, 2),
        ],
        axis=1,
    )
    return x, size, np.searchsorted(row[a], np.arange(rows + 1))


def _with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after in the same row, flags where there are none, and one."""
    n = len(x)
    head, tail = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    full = first[:-1] < first[1:]
    head[first[:-1][full]] = True
    tail[first[1:][full] - 1] = True
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[head], after[tail] = 0, 0
    return np.concatenate([x, before, after, head[:, None], tail[:, None], np.ones((n, 1))], axis=1)


def _marginals(node: np.ndarray, edge: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all chains at once: P(good) of every line, expected transitions, log partition.

    node: log potential of good against bad; edge: 2x2 log transition weights. Chains are advanced together, longest
    first, so the number of steps is the length of the longest chain.
    """
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    start, size = first[:-1][order], length[order]
    if not len(order):
        return np.zeros(0), np.zeros((2, 2)), 0.0
    live = np.searchsorted(-size, -np.arange(size[0]), side="left")  # chains longer than t
    psi = np.stack([np.exp(-np.maximum(node, 0)), np.exp(np.minimum(node, 0))], axis=1)  # scaled: the larger is 1
    scale = np.maximum(node, 0).sum()
    e = np.exp(edge)
    f, b = np.empty((len(node), 2)), np.empty((len(node), 2))
    z = np.empty(len(node))
    for t in range(size[0]):
        at = start[: live[t]] + t
        v = psi[at] if t == 0 else (f[at - 1] @ e) * psi[at]
        z[at] = v.sum(1)
        f[at] = v / z[at][:, None]
    b[start + size - 1] = 1
    for t in range(size[0] - 2, -1, -1):
        at = start[: live[t + 1]] + t
        b[at] = ((b[at + 1] * psi[at + 1]) @ e.T) / z[at + 1][:, None]
    good = f[:, 1] * b[:, 1] / (f * b).sum(1)
    inner = np.ones(len(node), dtype=bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    pair = f[at - 1].T @ ((b[at] * psi[at]) / z[at][:, None]) * e
    return good, pair, float(np.log(z).sum() + scale)


@dataclass
class Field:
    """A fitted field: feature means and deviations, node weights, transition weights."""

    mean: np.ndarray
    std: np.ndarray
    weight: np.ndarray
    edge: np.ndarray

    def scores(self, col: pa.Array) -> np.ndarray:
        """Score of every row of a chunk; a row without words gets the score of a chain with one featureless line."""
        x, size, first = line_features(col)
        node = _with_neighbours((x - self.mean) / self.std, first) @ self.weight
        good = _marginals(node, self.edge, first)[0]
        total = np.concatenate([[0], np.cumsum(size)])
        part = np.concatenate([[0], np.cumsum(size * good)])
        weight = total[first[1:]] - total[first[:-1]]
        empty = 1 / (1 + np.exp(-np.concatenate([np.zeros(3 * N_FEATURES), np.ones(3)]) @ self.weight))
        out = np.where(weight > 0, (part[first[1:]] - part[first[:-1]]) / np.maximum(weight, 1), empty)
        return np.clip(out, 0, 1)


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """Maximises the conditional likelihood of the line labels (Adam on the whole sample)."""
    mean, std = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    data = _with_neighbours((x - mean) / std, first)
    label = np.repeat(y, np.diff(first)).astype(float)
    n_lines = max(1, len(label))
    inner = np.ones(len(label), dtype=bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    seen = np.zeros((2, 2))
    at = np.flatnonzero(inner)
    np.add.at(seen, (label[at - 1].astype(int), label[at].astype(int)), 1)
    theta = np.zeros(data.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        good, pair, _ = _marginals(data @ theta[:-4], theta[-4:].reshape(2, 2), first)
        grad = np.concatenate([(good - label) @ data, (pair - seen).ravel()]) / n_lines + ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Field(mean, std, theta[:-4], theta[-4:].reshape(2, 2))


def fold_of(doc_id: str, folds: int):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE, most_lines: int = MOST_LINES, folds: int = FOLDS, held_out: int = HELD_OUT) -> Field:
    """Fits the field on at most ``sample`` labelled documents outside the held-out fold, each with all its lines.

    The sample takes the labelled ids with the smallest hashes; an id with several labels takes the smallest, and
    one with several texts takes that of the smallest hash. Documents are taken in that order while they have at most
    ``most_lines`` lines together (one at least). Rows with a null id or label are left out. Without any labelled row, every line is as likely good as bad.
    """
    chosen = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).where("_id is not null and _label is not null")
    chosen = chosen.where(fold_of("_id", folds) != held_out).groupBy("_id").agg(F.min("_label").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    found = found.groupBy("_id", "_label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))  # at most ``sample`` rows
    schema = "_id " + docs.schema[doc_id].dataType.simpleString() + ", y int, n int, x binary"
    found = written(found)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "_text"):
                x, _, first = line_features(part.column(1))
                n = np.diff(first)
                raw = [x[a : a + k].astype("<f4").tobytes() for a, k in zip(first[:-1], n, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int32()), pa.array(raw, pa.binary())], names=["_id", "y", "n", "x"])

    sizes = found.select("_id", (F.length("_text") - F.length(F.replace("_text", F.lit("\n"))) + 1).alias("n")).orderBy(F.xxhash64("_id"), "_id").collect()
    total = np.cumsum([r["n"] or 0 for r in sizes])
    found = found.where(F.col("_id").isin([r["_id"] for r, t in zip(sizes, total, strict=True) if t <= max(most_lines, total[0])]))
    rows = sorted({(r["_id"], r["y"], r["n"], bytes(r["x"])) for r in found.select("_id", "_text", "_label").mapInArrow(tidily(run), schema).collect()})
    x = np.frombuffer(b"".join(r[3] for r in rows), "<f4").reshape(-1, N_FEATURES).astype(float)
    first = np.concatenate([[0], np.cumsum([r[2] for r in rows])]).astype(np.int64)
    return fit(x, first, np.array([r[1] for r in rows], dtype=int))


def score(docs: DataFrame, field: Field, *, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """The columns ``keep`` and the score, for every row.

    Null and wordless texts have no lines and all get one score, that of a line of average features. Repeated rows
    are scored each; texts of any length are scored whole. ``labels`` and other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(field)
    return map_rows(docs, lambda part: [pa.array(model.value.scores(part.column(part.schema.get_field_index(text))), pa.float64())], [StructField(name, DoubleType())], keep, text)


def classify(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", cutoff: float = CUTOFF, folds: int = FOLDS, held_out: int = HELD_OUT, **how) -> DataFrame:
    """Trains and scores: doc_id, held_out, score, predicted."""
    field = train(docs, labels, text=text, doc_id=doc_id, folds=folds, held_out=held_out, **how)
    scored = score(docs, field, keep=[doc_id], text=text, name="_score")
    return scored.select(doc_id, (fold_of(doc_id, folds) == held_out).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= cutoff).cast("int").alias("predicted"))
