"""Ranked lexical search by NRA (Fagin, Lotem and Naor, "Optimal Aggregation Algorithms for Middleware", no random access).

Documents are tokenised once, into one row each that holds its number of terms and, of terms that some query has, places in
the vocabulary and occurrences. Corpus figures (N, L and each term's df) come from all these rows. Then every task deals its
rows into shards of bounded size and lays out each shard's lists in order of impact. A query reads its lists in that order,
a block of each in every round, and keeps for every document a lower bound, what its entries read so far add up to, and an
upper bound, which adds for each list not seen with it the impact at which that list stands. Reading ends when

* no document that might still enter has an upper bound as high as the k-th best score, unseen documents included, and
* every document that is left has equal bounds, so its score, and with it the order of ties, is final.

A task carries the k best of its shards on, so a later shard's reading starts with a threshold, and leaves at most k rows
for each query. The last step ranks those. Nothing is dropped but what can't be among the k best.

Queries come in blocks of at most ``BLOCK_BYTES`` of text (one longer item is a block of its own); only one block's terms
and numbers go to the tasks at once. Terms are compared as strings, not by hash.

Null and empty texts, of documents and queries, have no terms; such queries give no rows. Rows with equal doc_id are
documents of their own; a null doc_id comes last in ties. Rows with equal item_id, null included, are one query with the
terms of all of them. Empty tables give no rows. Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, lowered, prefix_hash, slices, span_hash, utf8, written

BLOCK_BYTES = 4 << 20
SHARD = 1 << 20
_STEP = 32
_TERM = np.ones(256, dtype=bool)
_TERM[:0x30] = _TERM[0x3A:0x41] = _TERM[0x5B:0x61] = _TERM[0x7B:0x80] = False

_COUNTED = "doc_id long, n long, terms array<int>, tf array<long>"
_RANKED = "query int, doc_id long, score long"


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of term bytes, and how many terms precede each row."""
    inside = _TERM[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.zeros(len(data) + 1, dtype=bool), np.zeros(len(data) + 1, dtype=bool)
    before[1:], after[:-1] = inside, inside
    starts = np.flatnonzero(after & (~before | edge))
    return starts, np.flatnonzero(before & (~after | edge)), np.searchsorted(starts, offsets)


@dataclass
class Block:
    """Queries of one block: their ids, the vocabulary in order of hash, and each one's places in it with repeats."""

    items: list[int | None]
    words: list[bytes]
    hashes: np.ndarray
    queries: list[tuple[np.ndarray, np.ndarray]]


def _block(rows: list) -> Block:
    texts: dict[int | None, list[bytes]] = {}
    for item, text in rows:
        data = lowered(np.frombuffer((text or "").encode(), dtype=np.uint8))
        starts, ends, _ = terms_of(data, np.array([0, len(data)]))
        raw = data.tobytes()
        texts.setdefault(item, []).extend(raw[a:b] for a, b in zip(starts, ends, strict=True))
    words = sorted({w for found in texts.values() for w in found})
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    hashes = span_hash(prefix_hash(data), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if words else np.zeros(0, dtype=np.uint64)
    order = np.argsort(hashes, kind="stable")
    words, place = [words[k] for k in order], {words[k]: at for at, k in enumerate(order)}
    queries = [np.unique(np.array([place[w] for w in found], dtype=np.int64), return_counts=True) for found in texts.values()]
    return Block(list(texts), words, hashes[order], queries)


def _counter(block: Block) -> Callable:
    """Documents as ``_COUNTED``, all rows, with the block's terms only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch["text"])
            data = lowered(data)
            starts, ends, at = terms_of(data, offsets)
            rows, n = np.repeat(np.arange(len(at) - 1), np.diff(at)), np.diff(at)
            found = np.zeros(0, dtype=np.int64)
            if len(block.words) and len(starts):
                hashes = span_hash(prefix_hash(data), starts, ends)
                found = np.minimum(np.searchsorted(block.hashes, hashes), len(block.words) - 1)
                mine = block.hashes[found] == hashes
                rows, found, starts, ends = rows[mine], found[mine], starts[mine], ends[mine]
            # a word that only shares a hash with one of the vocabulary is told apart by its bytes
            key, first, tf = np.unique(rows[: len(found)] * max(len(block.words), 1) + found, return_index=True, return_counts=True)
            raw = data.tobytes()
            same = np.array([raw[starts[k] : ends[k]] == block.words[found[k]] for k in first], dtype=bool)
            key, tf = key[same], tf[same]
            row, term = np.divmod(key, max(len(block.words), 1))
            bounds = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (term.astype(np.int32), tf.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n), *lists], ["doc_id", "n", "terms", "tf"])

    return run


@dataclass
class Figures:
    """What scores need of the whole corpus: documents and terms in all, and each term's weight."""

    n: int
    length: int
    weights: np.ndarray


def _figures(counted: DataFrame, words: int) -> Figures:
    n, length = counted.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(words, dtype=np.int64)
    for term, count in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the block's terms
        df[term] = count
    return Figures(n, length, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64))


class _Best:
    """The k best of one query so far: scores, ids, highest first, smaller ids first in ties."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.doc = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]


class Lists:
    """A shard's inverted lists in order of impact, and NRA over them."""

    def __init__(self, docs: np.ndarray, n: np.ndarray, bounds: np.ndarray, term: np.ndarray, tf: np.ndarray, figures: Figures):
        self.docs = docs
        m = 25 + (75 * n * figures.n) // max(figures.length, 1)
        row = np.repeat(np.arange(len(docs)), np.diff(bounds))
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
        order = np.lexsort((-impact, term))
        self.row, self.impact = row[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(len(figures.weights) + 1))
        self.weights = figures.weights

    def search(self, terms: np.ndarray, repeats: np.ndarray, best: _Best) -> int:
        """Adds to ``best`` what this shard has for it, reading no further than bounds ask for; the entries read."""
        factor = repeats * self.weights[terms]
        lo, hi = self.start[terms], self.start[terms + 1]
        live = (factor > 0) & (hi > lo)
        factor, lo, hi = factor[live], lo[live], hi[live]
        at, lower = lo.copy(), np.zeros(len(self.docs), dtype=np.int64)
        stands = factor * self.impact[lo]
        step, new = _STEP, True
        rows = np.zeros(0, dtype=np.int64)  # documents met while new ones may still enter
        while True:
            for t in range(len(factor)):
                end = min(at[t] + step, hi[t])
                part = self.row[at[t] : end]
                lower[part] += factor[t] * self.impact[at[t] : end]
                at[t] = end
                stands[t] = factor[t] * self.impact[end] if end < hi[t] else 0
            if new:
                rows = np.flatnonzero(lower)
            met = np.zeros(len(self.docs), dtype=np.int64)  # of each document the lists that it has been seen in
            np.add.at(met, np.concatenate([self.row[a:b] for a, b in zip(lo, at, strict=True)] or [rows]), np.repeat(stands, at - lo))
            upper = lower[rows] + stands.sum() - met[rows]
            bar = self._bar(lower[rows], best)
            rows, upper = rows[upper >= bar], upper[upper >= bar]
            new = new and int(stands.sum()) >= bar
            if not new and (upper == lower[rows]).all():
                best.add(lower[rows], self.docs[rows])
                return int((at - lo).sum())
            step *= 2

    @staticmethod
    def _bar(lower: np.ndarray, best: _Best) -> int:
        """The k-th best of the scores that are sure; 1 if there are fewer, as no score under it counts."""
        sure = np.concatenate([best.score, lower])
        return max(1, int(np.partition(sure, len(sure) - best.k)[len(sure) - best.k])) if len(sure) >= best.k else 1


def _ranker(block: Block, figures: Figures, k: int, shard: int) -> Callable:
    last = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in block.items]
        waiting: list[pa.RecordBatch] = []

        def search() -> None:
            table = pa.Table.from_batches(waiting).combine_chunks()
            lists = table["terms"].chunk(0), table["tf"].chunk(0)
            docs = table["doc_id"].fill_null(last).to_numpy()
            term, tf = (x.flatten().to_numpy() for x in lists)
            bounds = np.concatenate([[0], np.cumsum(table["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False))])
            made = Lists(docs, table["n"].to_numpy(), bounds, term.astype(np.int64), tf, figures)
            for (terms, repeats), found in zip(block.queries, best, strict=True):
                made.search(terms, repeats, found)
            waiting.clear()

        for batch in batches:
            for part in _portions(batch, shard):
                waiting.append(part)
                if sum(len(x["terms"].flatten()) + x.num_rows for x in waiting) >= shard:
                    search()
        if waiting:
            search()
        out = [(q, None if d == last else d, s) for q, found in enumerate(best) for s, d in zip(found.score.tolist(), found.doc.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["query", "doc_id", "score"])

    return run


def _portions(batch: pa.RecordBatch, shard: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about a shard's entries at most; a document is never cut."""
    if batch.num_rows:
        sizes = batch["terms"].value_lengths().to_numpy(zero_copy_only=False) + 1
        at = (np.cumsum(sizes) - sizes) // shard
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(lo, hi - lo)


def _search_block(docs: DataFrame, block: Block, k: int, shard: int) -> DataFrame:
    spark = docs.sparkSession
    counted = written(arrow_map(docs.select("doc_id", "text"), _counter(block), _COUNTED), "counted")
    figures = _figures(counted, len(block.words))
    best = arrow_map(counted.where("n > 0"), _ranker(block, figures, k, shard), _RANKED)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    items = spark.createDataFrame(list(enumerate(block.items)), "query int, item_id long")
    return top.join(F.broadcast(items), "query").select("item_id", "rank", "doc_id", "score")  # one block's ids


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents (doc_id, text) for each item (item_id, text)."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    dealt = items.select("item_id", "text", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block"))
    out = None
    for at in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in dealt.where(F.col("block") == at).select("item_id", "text").collect()]  # one block
        found = _search_block(docs, _block(rows), k, shard)
        out = found if out is None else out.unionByName(found)
    return out
