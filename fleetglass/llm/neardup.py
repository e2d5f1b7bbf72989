"""Near-duplicate documents by HyperMinHash (Yu and Weber, "HyperMinHash: MinHash in LogLog space").

A document's set holds the 64-bit hashes of its distinct five-word shingles. Documents with equal sets form one class and
only the smallest doc_id of a class goes on. Its sketch has one register for each of 128 buckets: the leading zeros of the
smallest hash there and ten bits after them. Empty buckets borrow from the next filled one, and say so in a bit, for
banding: bands of four registers name candidates. The agreement of own registers, corrected for chance collisions, discards
the hopeless, and the rest are confirmed on full sets.

Inside a band's bucket no list of all pairs is made. First every document meets the hub of its buckets, the one whose
buckets are largest in all, on full sets; a family of near copies hangs together after that. The rest of the work looks only
at buckets whose members still lie in different components: their sketches are compared in blocks inside tasks, what may be
linked forms families, and full sets of a family are searched in blocks too (``overlaps``). So no link is given up for the
size of a bucket, and no table of pairs grows with its square.

Null texts and texts without words have the empty set, class of their own, and no links. Rows of equal doc_id count as one
document with the union of their links. Rows with null doc_id are classes of their own without links: component_id null,
kept true. An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, mixed, slices, utf8, written
from .overlaps import SHINGLE_BYTES, Joined, all_components, labelled, shingle_sets, sides, tied_classes

WIDTH = 5
REGISTER_BITS = 7
REGISTERS = 1 << REGISTER_BITS
MANTISSA = 10
BORROWED = 1 << 15
BAND = 4


def registers(found: np.ndarray) -> np.ndarray:
    """The sketch of a sorted set: in each bucket leading zeros and mantissa of the smallest rest, packed in 15 bits."""
    bucket = (found >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)
    first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    filled, rest = bucket[first], found[first] << np.uint64(REGISTER_BITS)
    top = (rest >> np.uint64(12)).astype(np.float64)  # 52 bits, exact
    zeros = np.minimum(52 - np.frexp(top)[1], 31).astype(np.int64)
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    packed = (zeros.astype(np.uint64) << np.uint64(MANTISSA)) | mantissa
    places = np.arange(REGISTERS)
    owner = np.searchsorted(filled, places) % len(filled)
    return packed[owner].astype(np.uint16) | np.where(filled[owner] == places, 0, BORROWED).astype(np.uint16)


def possible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sketches and set sizes may be similar enough.

    The estimate is the share of agreeing registers among those that either set fills, less chance agreements. It rules a
    pair out only five deviations and two registers under the threshold; where the registers hold nearly all elements of
    the union, as with small sets, the deviation is small.
    """
    own_a, own_b = a < BORROWED, b < BORROWED
    seen = np.maximum((own_a | own_b).sum(axis=-1), 1)
    chance = 2.0 ** -(MANTISSA + 1)
    estimate = (((a == b) & own_a).sum(axis=-1) / seen - chance) / (1 - chance)
    share = percent / 100
    union = (n_a + n_b) / (1 + share)
    deviation = np.sqrt(share * (1 - share) / seen * np.clip(1 - seen / union, 0, 1))
    return (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (estimate >= share - 5 * deviation - 2 / seen)


_SKETCH = "doc_id long, n_shingles long, print1 long, print2 long, sketch binary"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SHINGLE_BYTES):
        sizes, one, two, made = [], [], [], []
        for found in shingle_sets(*utf8(batch["text"]), WIDTH):
            sizes.append(len(found))
            one.append(int(mixed(found).sum().astype(np.int64)) if len(found) else 0)
            two.append(int(mixed(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().astype(np.int64)) if len(found) else 0)
            made.append(registers(found).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "n_shingles", "print1", "print2", "sketch"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bands = REGISTERS // BAND
        sketch = np.frombuffer(b"".join(batch["sketch"].to_pylist()), dtype=np.uint16).reshape(-1, bands, BAND).astype(np.uint64) & np.uint64(BORROWED - 1)
        key = np.full(sketch.shape[:2], 0, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
        for k in range(BAND):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + sketch[:, :, k])
        doc = np.repeat(batch["doc_id"].to_numpy(), bands)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(doc)], ["bucket", "doc_id"])


def _hopeful(percent: int):
    """Pairs (a, b) with both sizes and sketches; those stay that may be links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = batch["size_a"].to_numpy(), batch["size_b"].to_numpy()
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("shape_a", "shape_b"))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(possible(a, b, n_a, n_b, percent)))

    return run


def _partners(percent: int):
    """For the documents of a pair of blocks that may be linked to one in another component: one of those they hang with."""

    def run(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        one, two, within = sides(table)
        doc, comp, size = (table[c].to_numpy() for c in ("doc_id", "component", "size"))
        sketch = np.frombuffer(b"".join(table["shape"].to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
        known, touched = Joined(np.arange(len(doc))), np.zeros(len(doc), dtype=bool)
        for i in one:
            others = two[(comp[two] != comp[i]) & (known.label[two] != known.label[i]) & ((two > i) if within else True)]
            others = others[100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i])]
            if len(others) and len(others := others[possible(sketch[others], sketch[i], size[others], size[i], percent)]):
                known.join(i, others)
                touched[i] = touched[others] = True
        root = np.full(len(doc), np.iinfo(np.int64).max)
        np.minimum.at(root, known.label[touched], doc[touched])
        return root[known.label[touched]], doc[touched]

    return run


def classes(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    facts = written(arrow_map(docs.select("doc_id", "text"), _sketches, _SKETCH), "sketches")
    alike = ["n_shingles", "print1", "print2"]
    filled = facts.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    by_class = filled.groupBy(*alike).agg(F.min_by(F.struct("doc_id", "sketch"), "doc_id").alias("r"))
    by_class = written(by_class.select(*alike, "r.doc_id", "r.sketch"), "classes")
    # sets of one or two shingles are similar to equal ones only
    bands = written(arrow_map(by_class.where("n_shingles > 2").select("doc_id", "sketch"), _banded, "list long, doc_id long").distinct(), "bands")
    members = written(bands.join(bands.groupBy("list").agg(F.count("*").alias("n")).where("n > 1"), "list"), "members")
    shapes = by_class.select("doc_id", F.col("n_shingles").alias("size"), F.col("sketch").alias("shape"))
    joined = all_components(members, tied_classes(filled, by_class, alike), shapes, docs, WIDTH, percent, _hopeful(percent), _partners(percent))
    discard(bands, members)
    component = labelled(by_class.select(*alike, "doc_id"), joined).select(*alike, F.col("component").alias("component_id"))
    linked_rows = filled.select("doc_id", *alike).join(component, alike).select("doc_id", "n_shingles", "component_id")
    # rows without a set or an id are components of their own and need no join, however many there are
    alone = facts.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked_rows.unionByName(alone)


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, and kept for the smallest doc_id of each component."""
    return classes(docs, percent).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows, as they are, of the smallest doc_id of each component."""
    late = near_duplicates(docs, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(late, "doc_id", "left_anti").select(*docs.columns)
