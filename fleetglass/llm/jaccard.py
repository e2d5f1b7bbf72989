"""Exact Jaccard join of documents on word shingles, by T-occurrence search (Li, Lu and Lu, "Efficient Merging and Filtering
Algorithms for Approximate String Searches", DivideSkip).

A document's set holds the 64-bit hashes of its distinct shingles. Documents with equal sets form one class, and only the
smallest doc_id of a class goes on. Two sets A and B are linked if they share at least ``need(|A|, |B|)`` elements. All
shingles have one order, frequent ones last, where frequency comes from a table of counters of fixed size; any order gives
the same links, this one keeps the lists below short. As a partner must share all but ``rare(|A|)`` - 1 elements of A, linked
sets have one of their ``rare`` first elements in common: only these elements' inverted lists name candidates.

1. Every list's members meet its hub, the member whose lists are longest in all. What full sets confirm makes components;
   a family of near copies hangs together after this step, at a cost that is linear in its size.
2. Lists whose members all lie in one component are done, and of lists with equal members one is enough. In what is left,
   members of different components are compared in blocks by size and by ``outline``: the number of elements in each of
   256 ranges of hashes. The sum of smaller numbers is at least the overlap, so no linked pair is lost here.
3. What that leaves hangs together in groups, whose full sets go to tasks in blocks of bounded size. There DivideSkip finds
   partners of every set: the longest lists are set aside, short ones are merged and counted, documents seen often enough
   are probed in the long lists by binary search, and stay if they reach the needed overlap. Only links that join two
   components leave the task.

No list is cut for its length and no table of pairs grows with the square of a list. Null texts and texts without words
have the empty set: components of their own, without links, as are rows with null doc_id, whose component_id is null. Rows
of equal doc_id count as one document with the links of all of them. An empty table gives no rows; other columns play no
part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, mixed, slices, utf8, written
from .overlaps import Joined, all_components, labelled, need, shingle_sets, sides, tied_classes

WIDTH = 4
PERCENT = 85
#: Counters of shingle frequency, a byte each, all of which go to every task.
COUNTERS = 1 << 16
OUTLINE = 256



def rare(size: int, percent: int) -> int:
    """How many of a set's first elements hold one of any linked set: it shares percent of the larger set at least."""
    return size - -(-percent * size // 100) + 1


# ---------------------------------------------------------------- sets and lists
def outline(found: np.ndarray) -> np.ndarray:
    """How many elements of a sorted set lie in each range of hashes."""
    return np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=OUTLINE).astype(np.uint16)


def _prints(sets: list[np.ndarray], salt: int) -> pa.Array:
    return pa.array([int(mixed(x ^ np.uint64(salt)).sum().astype(np.int64)) for x in sets], pa.int64())


def _facts(width: int) -> Callable:
    """Size, fingerprint and outline of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(*utf8(batch["text"]), width)
            # counts beyond 16 bits would not bound overlaps any more; such a set meets all partners of its size
            shapes = [outline(x).tobytes() if len(x) < 1 << 16 else None for x in sets]
            columns = [pa.array([len(x) for x in sets], pa.int64()), _prints(sets, 0), _prints(sets, 0xA5A5A5A5A5A5A5A5), pa.array(shapes, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_shingles", "print1", "print2", "outline"])

    return run


def _slot(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64(COUNTERS - 1)).astype(np.int64)


def _slots(width: int) -> Callable:
    """One row for each counter that a task has moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(COUNTERS, dtype=np.int64)
        for batch in slices(batches, "text"):
            count += np.bincount(_slot(np.concatenate(shingle_sets(*utf8(batch["text"]), width))), minlength=COUNTERS)
        moved = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(moved), pa.array(count[moved])], ["slot", "n"])

    return run


def counters(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """Roughly how many documents hold the shingles of each slot, as powers of two; fixed size."""
    out = np.zeros(COUNTERS, dtype=np.uint8)
    for slot, n in arrow_map(docs.select("text"), _slots(width), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[slot] = int(n).bit_length()
    return out


def _listed(width: int, percent: int, frequent: np.ndarray) -> Callable:
    """Rows (list, print1) for the rare elements of each set; copies of a text give equal rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keys = [np.zeros(0, dtype=np.uint64)]
            sets = [x for x in shingle_sets(*utf8(batch["text"]), width) if 100 * len(x) >= percent * (len(x) + 1)]  # smaller ones are linked to equal ones only
            for found in sets:
                keys.append(found[np.lexsort((found, frequent[_slot(found)]))[: rare(len(found), percent)]])
            prints = np.repeat(_prints(sets, 0).to_numpy(), [len(x) for x in keys[1:]]) if sets else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(prints)], ["list", "print1"])

    return run


# ---------------------------------------------------------------- comparing inside tasks
def _shapes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    unknown = np.full(OUTLINE, 2**16 - 1, dtype=np.uint16)
    return np.stack([unknown if x is None else np.frombuffer(x, dtype=np.uint16) for x in column.to_pylist()])


def _hopeful_pairs(percent: int) -> Callable:
    """Pairs (a, b) with sizes and outlines; those stay that may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                shared = np.minimum(_shapes(batch["shape_a"]), _shapes(batch["shape_b"])).sum(axis=1, dtype=np.int64)
                good = shared >= need(batch["size_a"].to_numpy(), batch["size_b"].to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(good))

    return run


def _hopeful(percent: int) -> Callable:
    """For the members of a pair of blocks that may be linked across components: one of those they hang with."""

    def run(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        one, two, within = sides(table)
        doc, comp, size = (table[c].to_numpy() for c in ("doc_id", "component", "size"))
        shape = _shapes(table["shape"])
        known, touched = Joined(np.arange(len(doc))), np.zeros(len(doc), dtype=bool)
        for i in one:
            others = two[(comp[two] != comp[i]) & (known.label[two] != known.label[i]) & ((two > i) if within else True)]
            others = others[100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i])]
            if len(others):
                shared = np.minimum(shape[others], shape[i]).sum(axis=1, dtype=np.int64)
                others = others[shared >= need(size[others], size[i], percent)]
            if len(others):
                known.join(i, others)
                touched[i] = touched[others] = True
        root = np.full(len(doc), np.iinfo(np.int64).max)
        np.minimum.at(root, known.label[touched], doc[touched])
        return root[known.label[touched]], doc[touched]

    return run


# ---------------------------------------------------------------- the join
def _members(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """list, doc_id and n, the list's length, of lists that several classes share, a row for each class."""
    lists = written(arrow_map(docs.where("doc_id IS NOT NULL").select("text"), _listed(width, percent, counters(docs, width)), "list long, print1 long"), "lists")
    several = written(lists.groupBy("list").agg(F.min("print1").alias("lo"), F.max("print1").alias("hi")).where("lo < hi").select("list"), "several")
    shared = lists.join(several, "list").distinct().join(classes.select("print1", "doc_id").distinct(), "print1").select("list", "doc_id").distinct()
    shared = written(shared, "shared")
    discard(lists, several)
    return written(shared.join(shared.groupBy("list").agg(F.count("*").alias("n")), "list"), "members")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of a table with doc_id and text."""
    facts = written(arrow_map(docs.select("doc_id", "text"), _facts(width), "doc_id long, n_shingles long, print1 long, print2 long, outline binary"), "facts")
    alike = ["n_shingles", "print1", "print2"]
    filled = facts.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    by_class = written(filled.groupBy(*alike).agg(F.min("doc_id").alias("doc_id")), "classes")
    members = _members(docs, by_class, width, percent)
    shapes = facts.select("doc_id", F.col("n_shingles").alias("size"), F.col("outline").alias("shape"))
    joined = all_components(members, tied_classes(filled, by_class, alike), shapes, docs, width, percent, _hopeful_pairs(percent), _hopeful(percent))
    discard(members)
    component = labelled(by_class, joined).select(*alike, F.col("component").alias("component_id"))
    out = filled.select("doc_id", *alike).join(component, alike).select("doc_id", "n_shingles", "component_id")
    # rows without a set or an id are components of their own and need no join, however many there are
    return out.unionByName(facts.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
