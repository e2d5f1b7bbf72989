"""Language identification by bit-sliced Bloom filters of byte n-grams.

A slot of the filter holds one bit for each language, so one lookup tells all languages that contain an n-gram. A text's
hits are counted for each language, corrected for the filter's false positives in that language, and the largest share
decides. An n-gram belongs to a language if it makes up at least ``MIN_SHARE`` of that language's n-grams, which bounds
the filter by the number of languages and not by the corpus; counts cover all training rows and n-grams. More than
``MASK_BITS`` languages are dealt over several filters in order, so there is no limit to their number.

A text that is null or has no letter is ``und`` with score 0, as is any text if nothing could be learned. A text with
letters but no n-gram gets the most frequent language and score 0. Equal scores go to the language first in the alphabet.
Rows of equal or null doc_id are judged each for itself; a row without doc_id or lang teaches nothing. Empty tables give
no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh, mixed, slices, utf8

MIN_SHARE = 2e-5
MASK_BITS = 64
SLOTS_PER_ENTRY = 16
UNKNOWN = "und"
_HOLD = 1 << 20
_TO = np.full(256, 32, dtype=np.uint8)
_TO[97:123] = np.arange(97, 123)
_TO[65:91] = np.arange(97, 123)
_TO[128:] = np.arange(128, 256)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four-byte codes of runs of letters with a space at each end, and how many precede each row.

    Bytes other than ASCII letters and those above 127 count as spaces; codes with two spaces side by side are left out.
    """
    rows = len(offsets) - 1
    padded = np.full(len(data) + rows + 1, 32, dtype=np.uint8)
    at = offsets + np.arange(rows + 1)
    inside = np.ones(len(padded), dtype=bool)
    inside[at] = False
    padded[inside] = _TO[data]
    n = max(0, len(padded) - 3)
    x = padded.astype(np.uint32)
    code = (x[:n] << 24) | (x[1 : n + 1] << 16) | (x[2 : n + 2] << 8) | x[3 : n + 3]
    space = padded == 32
    twin = space[:-1] & space[1:]
    good = ~(twin[:n] | twin[1 : n + 1] | twin[2 : n + 2]) if n else np.zeros(0, dtype=bool)
    for back in (1, 2):
        cross = at[1:] - back
        good[cross[(cross >= 0) & (cross < n)]] = False
    return code[good], np.concatenate([[0], np.cumsum(good)])[np.minimum(at, n)]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where, np.concatenate(counts), minlength=len(key)).astype(np.int64)


def _counter(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys, counts = {x: i for i, x in enumerate(languages)}, [], []

        def out(key: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(32)).astype(np.int32)), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(count)], ["language", "gram", "n"])

        for batch in slices(batches, "text"):
            code, at = ngrams(*utf8(batch["text"]))
            of = np.array([number[x] for x in batch["lang"].to_pylist()], dtype=np.uint64)
            key, count = np.unique(code.astype(np.uint64) | (np.repeat(of, np.diff(at)) << np.uint64(32)), return_counts=True)
            keys.append(key)
            counts.append(count)
            if sum(map(len, keys)) > _HOLD:
                key, count = _summed(keys, counts)
                keys, counts = [key], [count]
                if len(key) > _HOLD // 2:
                    yield out(key, count)
                    keys, counts = [], []
        if keys:
            yield out(*_summed(keys, counts))

    return run


def held_out(doc_id: Column) -> Column:
    """Rows that teach nothing: the crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Filter:
    """The n-grams of up to MASK_BITS languages, the first of which has the number ``first``."""

    first: int
    slots: np.ndarray
    chance: np.ndarray

    def places(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, mask = mixed(code.astype(np.uint64)), np.uint64(len(self.slots) - 1)
        return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)

    def shares(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each language the part of each row's n-grams that it holds, less what chance gives."""
        a, b = self.places(code)
        mask = self.slots[a] & self.slots[b]
        n = np.diff(at)
        share = np.zeros((len(self.chance), len(n)))
        for i, chance in enumerate(self.chance):
            hits = np.diff(np.concatenate([[0], np.cumsum((mask >> mask.dtype.type(i)) & mask.dtype.type(1), dtype=np.int64)])[at])
            share[i] = (hits / np.maximum(n, 1) - chance) / max(1 - chance, 1e-9)
        return share


@dataclass
class Model:
    languages: list[str]
    common: int
    filters: list[Filter]

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the language and the score of each row."""
        code, at = ngrams(data, offsets)
        n = np.diff(at)
        best, score = np.zeros(len(n), dtype=np.int64), np.full(len(n), -np.inf)
        for part in self.filters:
            share = part.shares(code, at)
            top = share.max(axis=0)
            best = np.where(top > score, part.first + share.argmax(axis=0), best)
            score = np.maximum(score, top)
        return np.where(n > 0, best, self.common), np.where(n > 0, np.clip(score, 0, 1), 0.0)


def _filter(first: int, languages: int, of: np.ndarray, gram: np.ndarray) -> Filter:
    size = 1 << max(10, int(np.ceil(np.log2(max(len(gram), 1) * SLOTS_PER_ENTRY))))
    kind = next(t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if languages <= bits)
    found = Filter(first, np.zeros(size, dtype=kind), np.zeros(languages))
    for place in found.places(gram):
        for i in range(languages):
            found.slots[place[of == first + i]] |= kind(1 << i)
    for i in range(languages):
        found.chance[i] = float(((found.slots >> kind(i)) & kind(1)).mean()) ** 2
    return found


def learn(docs: DataFrame, min_share: float = MIN_SHARE) -> Model | None:
    """A model from the rows with doc_id and lang that are not held out; None if there are none."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    frequent = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not frequent:
        return None
    languages = sorted(r["lang"] for r in frequent)
    counts = arrow_map(rows.select("lang", "text"), _counter(languages), "language int, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("language").agg(F.sum("n").alias("_total"))
    got = counts.join(F.broadcast(totals), "language").where(F.col("n") >= F.col("_total") * min_share).select("language", "gram").toArrow()
    of, gram = got["language"].to_numpy(), got["gram"].to_numpy()
    filters = []
    for first in range(0, len(languages), MASK_BITS):
        own = (of >= first) & (of < first + MASK_BITS)
        filters.append(_filter(first, min(MASK_BITS, len(languages) - first), of[own], gram[own]))
    return Model(languages, languages.index(frequent[0]["lang"]), filters)


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in slices(batches, "text"):
            letters = batch["_letters"].to_numpy(zero_copy_only=False)
            if model:
                best, score = model.decide(*utf8(batch["text"]))
                names = np.where(letters, np.array(model.languages, dtype=object)[best], UNKNOWN)
            else:
                names, score = np.full(batch.num_rows, UNKNOWN, dtype=object), np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, min_share))
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    return arrow_map(rows, _predictor(model), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, min_score: float) -> DataFrame:
    """The rows, as they are, whose language is known with at least ``min_score``; all with a letter if nothing was learned."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs))
    (letters,) = fresh(docs, "letters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Model | None = model.value
        for batch in slices(batches, "text"):
            good = batch[letters].to_numpy(zero_copy_only=False)
            if found:
                good = good & (found.decide(*utf8(batch["text"]))[1] >= min_score)
            yield batch.drop_columns([letters]).filter(pa.array(good))

    return arrow_map(docs.withColumn(letters, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))), run, docs.schema)
