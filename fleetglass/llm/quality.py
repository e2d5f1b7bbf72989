"""Quality rules: counts over words, and a logistic regression on hashed word and character n-grams.

The model learns from labelled rows: at most ``TRAIN_ROWS`` of them, chosen by a hash of doc_id, reach the driver as
hashed frequencies. A fifth of these fit the calibration (a sigmoid over the raw score). Scoring runs in Arrow batches
over whole texts, and a document stays if it passes the rules and its calibrated probability reaches a fixed threshold.

Null texts have no words and fail the rules. Rows of equal or null doc_id are judged each for itself. Without labels of
both kinds there is no model and the rules alone decide. Empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, arrow_map, mixed, prefix_hash, slices, span_hash, utf8, windows_hash, words

TRAIN_ROWS = 3000
BITS = 16
KEEP_FROM = 0.3
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets]


def _later_equal(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier one of the same row."""
    own = mixed(keys + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    out = np.zeros(len(own), dtype=bool)
    out[order[1:][same]] = True
    return out


def counts(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> dict[str, np.ndarray]:
    """The rules' counts for each row."""
    starts, ends, word_at = words(data, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(word_at))
    sums = prefix_hash(data)
    solid = ~_SPACE[data]
    out = {"n_words": np.diff(word_at)}
    out["word_chars"] = np.diff(_per_row(solid & ((data & 0xC0) != 0x80), offsets))
    out["n_symbols"] = np.diff(_per_row(_SYMBOL[data], offsets))
    cut = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], cut + 1]))
    begin = begin[begin < len(data)]
    end = np.concatenate([begin[1:], [len(data)]])
    inside = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(solid, out=inside[1:])
    row = np.searchsorted(offsets, begin, "right") - 1
    stop = np.where((end > begin) & (data[end - 1] == 10) & (end <= offsets[row + 1]), end - 1, end) if len(begin) else end
    filled = inside[stop] > inside[begin] if len(begin) else np.zeros(0, dtype=bool)
    begin, stop, row = begin[filled], stop[filled], row[filled]
    out["n_dup_lines"] = np.bincount(row[_later_equal(span_hash(sums, begin, stop), row)], minlength=len(offsets) - 1)
    keys = windows_hash(span_hash(sums, starts, ends), width)
    inner = np.flatnonzero(rows[: len(keys)] == rows[width - 1 :]) if len(keys) else np.zeros(0, dtype=np.int64)
    keys, key_rows = keys[inner], rows[inner]
    own = mixed(keys + key_rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own)
    same = own[order][1:] == own[order][:-1]
    twice = np.zeros(len(own), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(rows) + 1, dtype=np.int64)
    np.add.at(edge, inner[twice], 1)
    np.add.at(edge, inner[twice] + width, -1)
    covered = np.cumsum(edge)[:-1] > 0
    out["n_repeat_words"] = np.bincount(rows[covered], minlength=len(offsets) - 1)
    return out


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def hashed(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Feature numbers of words and of byte trigrams, each with how many precede each row."""
    starts, ends, word_at = words(data, offsets)
    of_words = (span_hash(prefix_hash(data), starts, ends) >> np.uint64(64 - bits)).astype(np.int64)
    n = max(0, len(data) - 2)
    code = (data[:n].astype(np.uint32) << 16) | (data[1 : n + 1].astype(np.uint32) << 8) | data[2 : n + 2] if n else np.zeros(0, dtype=np.uint32)
    inner = np.ones(n, dtype=bool)
    for back in (1, 2):
        at = offsets[1:] - back
        inner[at[(at >= 0) & (at < n)]] = False
    of_grams = ((code[inner] * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64) + (1 << bits)
    return (of_words, word_at), (of_grams, _per_row(inner, np.minimum(offsets, n)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        score = np.full(len(offsets) - 1, self.bias)
        for index, at in hashed(data, offsets):
            total = np.concatenate([[0.0], np.cumsum(self.weights[index])])[at]
            score += np.diff(total) / np.maximum(np.diff(at), 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -30, 30)))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        data, offsets = utf8(batch["text"])
        index, value = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
        for of, at in hashed(data, offsets):
            for row, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                found, n = np.unique(of[a:b], return_counts=True)
                index[row].append(found)
                value[row].append(n / max(b - a, 1))
        made = [pa.array([np.concatenate(x).astype(t) for x in lists], pa.list_(k)) for lists, t, k in ((index, np.int32, pa.int32()), (value, np.float32, pa.float32()))]
        yield pa.RecordBatch.from_arrays([batch["_label"].cast(pa.int32()), *made], ["label", "index", "value"])


def fit(x_index: list[np.ndarray], x_value: list[np.ndarray], y: np.ndarray, bits: int = BITS, rounds: int = 200) -> Model | None:
    """Logistic regression by gradient steps, calibrated on every fifth row; None without both classes."""
    held = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[~held])) < 2:
        return None
    row = np.repeat(np.arange(len(y)), [len(x) for x in x_index])
    col, val = np.concatenate(x_index), np.concatenate(x_value).astype(np.float64)
    use = ~held[row]
    r, c, v, n = row[use], col[use], val[use], int((~held).sum())
    w, b = np.zeros(2 << bits), float(np.log(max(y[~held].mean(), 1e-3) / max(1 - y[~held].mean(), 1e-3)))
    step, mean, square = 3.0, np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        score = np.bincount(r, v * w[c], minlength=len(y)) + b
        gap = np.where(held, 0, 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y)
        slope = np.bincount(c, v * gap[r], minlength=len(w)) / n + 1e-7 * w
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        w -= step * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-6)
        b -= 0.5 * gap.sum() / n
    model = Model(w, b)
    s = np.clip(np.bincount(row, val * w[col], minlength=len(y))[held] + b, -50, 50)
    if len(np.unique(y[held])) == 2:
        t = (y[held] * (y[held].sum() + 1) + (1 - y[held])) / np.where(y[held] == 1, y[held].sum() + 2, (1 - y[held]).sum() + 2)
        z = np.stack([s, np.ones_like(s)], axis=1)
        theta = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
            theta -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (p - t) + 1e-3 * (theta - [1, 0]))
        model.slope, model.shift = (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Model | None:
    """A model from at most ``max_rows`` labelled documents."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("_label"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(max_rows)
    # rows that repeat a doc_id are bounded with the others
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), F.xxhash64("text"), "_label").limit(max_rows).select("_label", "text")
    got = arrow_map(texts, _frequencies, "label int, index array<int>, value array<float>").toArrow()
    if not got.num_rows:
        return None
    order = np.argsort([hash((int(y), len(i), int(i[0]) if len(i) else 0)) & 0xFFFFFFFF for y, i in zip(got["label"].to_pylist(), got["index"].to_pylist(), strict=True)], kind="stable")
    index, value = [[np.asarray(x, dtype=kind) for x in got[c].to_pylist()] for c, kind in (("index", np.int64), ("value", np.float64))]
    return fit([index[i] for i in order], [value[i] for i in order], got["label"].to_numpy()[order])


def _scorer(model, keep_from: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch["text"])
            found = counts(data, offsets)
            failed = base_failed(found)
            p = model.value.probability(data, offsets) if model.value else np.ones(batch.num_rows)
            made = [*(pa.array(found[k].astype(np.int64)) for k in COUNTS), pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_from))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *made], ["doc_id", *COUNTS, "base_failed", "p_quality", "kept"])

    return run


def judge(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, the counts, base_failed, the calibrated probability p_quality, and kept."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return arrow_map(docs.select("doc_id", "text"), _scorer(model, keep_from), f"doc_id long, {', '.join(f'{k} long' for k in COUNTS)}, base_failed boolean, p_quality double, kept boolean")
