"""What both near-duplicate operators do with candidates: hubs first, then groups of full sets in blocks, with DivideSkip.

Candidates come as a table of members: rows (list, doc_id) with the list's length ``n``, where the lists of linked documents
meet. Neither step makes a table of pairs that grows with the square of a list or a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import arrow_map, lowered, mixed, prefix_hash, slices, span_hash, utf8, windows_hash, words, written

BLOCK = 1024
#: Elements of a block of full sets.
SET_BLOCK = 1 << 19
#: Bytes of texts whose words are hashed at once: about thirty times as many are held meanwhile, beside all other tasks of an executor.
SHINGLE_BYTES = 1 << 19
#: Weighs probing against merging, as the paper's mu.
MU = 0.0085


def need(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap of linked sets of these sizes: 100 * o >= percent * (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles; A-Z count as a-z."""
    data = lowered(data)
    starts, ends, at = words(data, offsets)
    h = span_hash(prefix_hash(data), starts, ends)
    full = windows_hash(h, width)
    out = []
    for a, b in zip(at, at[1:], strict=False):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            out.append(mixed(windows_hash(h[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share enough of their union."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


class Joined:
    """Which of a task's documents are known to be connected."""

    def __init__(self, labels: np.ndarray):
        _, self.label = np.unique(labels, return_inverse=True)

    def join(self, i: int, others: np.ndarray) -> None:
        gone = np.unique(self.label[others])
        self.label[np.isin(self.label, gone)] = self.label[i]


def sets_of(width: int, *kept: str) -> Callable:
    """The sets of texts, beside other columns of their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SHINGLE_BYTES):
            found = [x.tobytes() for x in shingle_sets(*utf8(batch["text"]), width)]
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in kept], pa.array(found, pa.binary())], [*kept, "set"])

    return run


def each_group(keys: list[str], f: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> Callable:
    """Applies ``f`` to each run of rows with equal keys of a sorted partition; gives its pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, last = [], None
        found_a, found_b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]

        def close() -> None:
            a, b = f(pa.Table.from_batches(waiting).combine_chunks())
            found_a.append(a)
            found_b.append(b)
            waiting.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = np.stack([batch[k].to_numpy().astype(np.int64) for k in keys])
            cuts = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if waiting and tuple(columns[:, lo]) != last:
                    close()
                waiting.append(batch.slice(lo, hi - lo))
                last = tuple(columns[:, lo])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], ["a", "b"])
            found_a, found_b = found_a[:1], found_b[:1]
        if waiting:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], ["a", "b"])

    return run


def compared(rows: DataFrame, key: str, f: Callable, *columns: str) -> DataFrame:
    """``f`` over each pair of blocks of each key, a group of bounded size."""
    keys = [key, "left", "right"]
    dealt = rows.select(*keys, "side", "doc_id", "component", *columns).repartition(*keys).sortWithinPartitions(*keys)
    return arrow_map(dealt, each_group(keys, f), "a long, b long")


def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """The rows of the first and of the second block, and whether both are the same block."""
    within = table["left"][0].as_py() == table["right"][0].as_py()
    side, every = table["side"].to_numpy(), np.arange(table.num_rows)
    return (every, every, True) if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1), False)


class Index:
    """Inverted lists over some sets, and DivideSkip over them."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets], dtype=np.int64)
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(every, kind="stable")  # owners rise within a list
        self.owner, every = owner[order], every[order]
        self.element, self.start = np.unique(every, return_index=True)
        self.end = np.append(self.start[1:], len(every))

    def partners(self, found: np.ndarray, percent: int, wanted: np.ndarray) -> np.ndarray:
        """Which of the wanted sets (a mask) are linked to this one."""
        at = np.minimum(np.searchsorted(self.element, found), len(self.element) - 1)
        at = at[self.element[at] == found]
        least = -(-percent * len(found) // 100)  # what any partner shares
        if len(at) < least:
            return np.zeros(0, dtype=np.int64)
        length = self.end[at] - self.start[at]
        at = at[np.argsort(length, kind="stable")]
        longest = int((self.end[at[-1]] - self.start[at[-1]]))
        n_long = min(int(least / (MU * np.log2(max(longest, 2)) + 1)), least - 1)
        short, long_ = at[: len(at) - n_long], at[len(at) - n_long :]
        merged = np.concatenate([self.owner[self.start[k] : self.end[k]] for k in short])
        count = np.bincount(merged, minlength=len(self.size))
        must = need(self.size, len(found), percent)
        rows = np.flatnonzero((count >= np.maximum(must - n_long, 1)) & wanted)
        count = count[rows]
        for done, k in enumerate(long_[::-1]):
            if not len(rows):
                break
            lists = self.owner[self.start[k] : self.end[k]]
            place = np.minimum(np.searchsorted(lists, rows), len(lists) - 1)
            count = count + (lists[place] == rows)
            open_ = count + (n_long - done - 1) >= must[rows]
            rows, count = rows[open_], count[open_]
        return rows[count >= must[rows]]


def group_linker(percent: int) -> Callable:
    """Inside a pair of blocks of a group: links on full sets that join two components."""

    def run(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        one, two, _ = sides(table)
        if not len(one) or not len(two):  # no member fell into one of the blocks
            return one[:0], two[:0]
        doc, comp = table["doc_id"].to_numpy(), table["component"].to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table["set"].to_pylist()]
        index, known, a, b = Index([sets[k] for k in two]), Joined(comp), [], []
        for i in one:
            wanted = known.label[two] != known.label[i]
            if not wanted.any():
                continue
            for k in two[index.partners(sets[i], percent, wanted)]:
                if known.label[k] != known.label[i]:
                    known.join(i, np.array([k]))
                    a.append(doc[i])
                    b.append(doc[k])
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)

    return run


def near_hub(percent: int) -> Callable:
    """The hub's row, the first of a group, and rows of members: the links between both."""

    def run(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        doc, is_hub = table["doc_id"].to_numpy(), table["side"].to_numpy() == 0
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table["set"].to_pylist()]
        hubs = np.flatnonzero(is_hub)
        near = [k for k in np.flatnonzero(~is_hub) if any(linked(sets[h], sets[k], percent) for h in hubs)]
        return np.full(len(near), doc[hubs[0]] if len(hubs) else 0), doc[near]

    return run


def dealt(rows: DataFrame, blocks: str) -> DataFrame:
    """Rows of a key with a number of blocks dealt into pairs of blocks (left, right), with the side they are on."""
    one = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col(blocks)).cast("int"))
    pairs = one.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
    return pairs.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")).withColumn("side", (F.col("block") > F.col("other")).cast("int"))


def labelled(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """With each document's component so far."""
    return rows.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def hub_links(members: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links between documents and the hub with which they share most of their lists.

    A hub's members are dealt into blocks, each of which gets the hub's set, so a text is shuffled once and a set twice. Texts
    meet roles by a sorted join at every size, as a broadcast would send a row for each text that shares a list.
    """
    reach = members.groupBy("doc_id").agg(F.sum(F.log2("n")).alias("reach"))
    ranked = members.join(reach, "doc_id").select("list", "doc_id", F.struct(F.col("reach"), (-F.col("doc_id")).alias("id")).alias("at"))
    hubs = ranked.groupBy("list").agg(F.max("at").alias("hub"))
    met = members.join(hubs, "list").where(F.col("doc_id") != -F.col("hub.id")).groupBy("doc_id", "hub").agg(F.count("*").alias("shared"))
    best = met.groupBy("doc_id").agg(F.max(F.struct("shared", "hub")).alias("m"))
    pairs = written(best.select((-F.col("m.hub.id")).alias("hub"), "doc_id"), "pairs")
    blocks = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = pairs.join(blocks, "hub").select("doc_id", "hub", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("left"), F.lit(1).alias("side"))
    centre = blocks.select(F.col("hub").alias("doc_id"), "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("left"), F.lit(0).alias("side"))
    roles = own.unionByName(centre).groupBy("doc_id").agg(F.collect_set(F.struct("hub", "left", "side")).alias("roles"))  # a row for each block
    texts = docs.select("doc_id", "text").join(roles.hint("merge"), "doc_id")
    sets = arrow_map(texts.select("doc_id", "roles", "text"), sets_of(width, "doc_id", "roles"), "doc_id long, roles array<struct<hub:long,left:int,side:int>>, set binary")
    rows = sets.select("doc_id", "set", F.inline("roles")).withColumn("right", F.col("left")).withColumn("component", F.col("hub"))
    return compared(rows, "hub", near_hub(percent), "set")


def open_groups(members: DataFrame, joined: DataFrame, shapes: DataFrame, percent: int, pair_test: Callable, block_test: Callable) -> DataFrame:
    """doc_id and ``family`` of documents that may still be linked across components.

    Of lists whose members lie in several components, and of equal ones one only, members are compared by ``shapes``
    (doc_id, size, shape): a list of two is one pair for ``pair_test``, longer ones go to ``block_test`` in pairs of blocks.
    """
    placed = labelled(members.select("list", "doc_id"), joined)
    print_ = F.sum(F.xxhash64("doc_id").cast("decimal(38,0)"))
    of = placed.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), print_.alias("print"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    lists = written(of.where("lo < hi").groupBy("print", "n").agg(F.min(F.struct("list", "a", "b")).alias("l")).select("l.*", "n"), "open")
    pairs, longer = lists.where("n = 2").select("a", "b").distinct(), lists.where("n > 2").withColumn("blocks", F.ceil(F.col("n") / BLOCK)).select("list", "blocks")
    rest = written(placed.join(longer, "list"), "rest")
    ids = rest.select("doc_id").unionByName(pairs.select(F.col("a").alias("doc_id"))).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    needed = shapes.join(ids, "doc_id", "left_semi")
    both = pairs
    for side in ("b", "a"):
        both = both.join(needed.select(F.col("doc_id").alias(side), F.col("size").alias(f"size_{side}"), F.col("shape").alias(f"shape_{side}")), side)
    both = both.where(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
    found = arrow_map(both.select("a", "b", "size_a", "size_b", "shape_a", "shape_b"), pair_test, "a long, b long")
    found = found.unionByName(compared(dealt(rest, "blocks").join(needed, "doc_id"), "list", block_test, "size", "shape"))
    return written(components(written(found.distinct(), "hopeful")).select(F.col("node").alias("doc_id"), F.col("component").alias("family")), "families")


def group_links(families: DataFrame, joined: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links on full sets that join two components of a family, whose sets go to tasks in pairs of blocks."""
    texts = docs.select("doc_id", "text").join(families.select("doc_id"), "doc_id", "left_semi")
    sets = written(arrow_map(texts, sets_of(width, "doc_id"), "doc_id long, set binary"), "sets")
    own = families.join(sets, "doc_id")
    elements = own.groupBy("family").agg(F.ceil(F.sum(F.octet_length("set")) / F.lit(8 * SET_BLOCK)).alias("blocks"))
    rows = dealt(labelled(own.join(elements, "family"), joined), "blocks")
    return compared(rows, "family", group_linker(percent), "set")


def all_components(members: DataFrame, tied: DataFrame, shapes: DataFrame, docs: DataFrame, width: int, percent: int, pair_test: Callable, block_test: Callable) -> DataFrame:
    """node and component of all documents with links: those with hubs, those in what is left open, and ``tied`` (a, b)."""
    links = written(hub_links(members, docs, width, percent).unionByName(tied), "links")
    joined = written(components(links), "joined")
    families = open_groups(members, joined, shapes, percent, pair_test, block_test)
    if not families.isEmpty():
        more = written(group_links(families, joined, docs, width, percent), "links")
        joined = written(components(links.unionByName(more)), "joined")
    return joined


def tied_classes(filled: DataFrame, classes: DataFrame, alike: list[str]) -> DataFrame:
    """An id with several texts ties their classes: links (a, b) between it and the classes' first ids."""
    several = filled.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    return filled.join(several, "doc_id").join(classes.select(F.col("doc_id").alias("a"), *alike), alike).select("a", F.col("doc_id").alias("b")).distinct()
