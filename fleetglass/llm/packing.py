"""Best-fit packing of tokenised documents into training sequences by the sum-of-squares rule.

Documents longer than a sequence are cut so that only the first piece is short; whole pieces fill sequences alone. The
others are dealt at random into shards of bounded size, and each shard is packed longest first: a piece goes where the sum
of the squared numbers of open sequences at each residual gap becomes smallest (Csirik et al., "On the sum-of-squares
algorithm for bin packing"), the smallest gap among equals. A full sequence counts nowhere. A sequence is opened only if no
open one has room, as the fewest sequences are wanted.

Null texts count as empty and hold the end id alone. Rows of equal or null doc_id are packed each for itself. An empty
table gives no rows. Other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices, written
from .tokens import TOKEN_SLICE, crc, library_encoder

SHARD_PIECES = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(path: str, end_id: int, capacity: int, keep_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        for batch in slices(batches, "text", TOKEN_SLICE):
            ids, bounds = encoder(batch["text"])
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            kept = []
            for doc, lo, hi in zip(batch["doc_id"].to_pylist(), bounds, bounds[1:], strict=False):
                own = np.append(ids[lo:hi], np.uint32(end_id)).astype("<u4")
                first = len(own) % capacity or capacity
                cuts = [0, *range(first, len(own) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for k, v in zip(out, (doc, piece, a, b - a, crc(own[a:b])), strict=True):
                        out[k].append(v)
                    if keep_ids:
                        kept.append(own[a:b].astype(np.int32))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            made = [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*made, pa.array(kept, pa.list_(pa.int32()))] if keep_ids else made, [*out, *["ids"] * keep_ids])

    return run


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """The pieces of each document with their place, length and checksum, and their ids if asked for."""
    return arrow_map(docs.select("doc_id", "text"), _cutter(tokenizer, end_id, capacity, keep_ids), PIECES + ", ids array<int>" * keep_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For lengths from longest to shortest the number of the sequence and the offset in it, by the sum-of-squares rule."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, places = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    opened = 0
    for i, size in enumerate(lengths.tolist()):
        gap, open_gaps = capacity, np.flatnonzero(counts[size:])
        if open_gaps.size:
            # what the sum of squares gains: a sequence less at the gap, and one more at what is left of it
            change = 1 - 2 * counts[open_gaps + size] + np.where(open_gaps > 0, 2 * counts[open_gaps] + 1, 0)
            gap = size + int(open_gaps[np.argmin(change)])
        if gap < capacity:
            to = stacks[gap].pop()
            counts[gap] -= 1
        else:
            to, opened = opened, opened + 1
        bins[i], places[i] = to, capacity - gap
        if gap > size:
            stacks[gap - size].append(to)
            counts[gap - size] += 1
    return bins, places


def _packer(capacity: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, places = sum_of_squares(table["length"].to_numpy(), capacity)
        shard = table["shard"][0].as_py()
        out = table.drop_columns(["shard"]).append_column("sequence_id", pa.array(bins + (shard << 40), pa.int64()))
        return out.append_column("offset", pa.array(places, pa.int64()))

    return run


def pack(cut: DataFrame, capacity: int = 2048, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length and any other columns); read twice, so pass a table."""
    shards = -(-max(cut.count(), 1) // shard_pieces)
    # rows without an id may be alike in all else; their place in the table tells them apart
    row = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "length", row), F.lit(shards)))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return dealt.groupBy("shard").applyInArrow(_packer(capacity), f"{kept}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """Documents as packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ``ids`` if asked for.

    Only numbers are packed; ids meet their places again by a key.
    """
    cut = pieces(docs, tokenizer, end_id, capacity, keep_ids)
    if not keep_ids:
        return pack(written(cut, "pieces"), capacity)
    table = written(cut.withColumn("key", F.monotonically_increasing_id()), "pieces")
    return pack(table.drop("ids"), capacity).join(table.select("key", "ids"), "key").drop("key")
