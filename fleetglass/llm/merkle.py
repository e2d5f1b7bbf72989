"""Merkle manifest of a table of documents, kept as a postorder append log (the order in which a log can only grow).

Every row is a leaf; the leaves of a source, in the order of doc_id, hang in runs of sixteen under their hash, those again,
until one node stays: the source's subroot. Subroots, in the order of source, make the same kind of tree above.

Aligned builders write the log. A builder owns 256 consecutive leaves of one tree, a whole subtree or the ragged end of one,
takes them in order and appends each node as soon as its last child is there. The subtree roots are the leaves of the next
generation of builders, so ``log_256(leaves)`` generations are enough, none of them with more than 273 nodes in a task's
memory, whatever share of the rows one source has.

Where a node lies in the log follows from its level and number alone (``position``), as the subtrees before it are complete:
before leaf e there are e leaves and e // 16 + e // 256 + ... inner nodes, and a node follows its last leaf by its level. So
proofs need no links between nodes: the siblings of a path are read at computed places of the builder's segment, and what
lies above a segment is one short row for all its leaves.

H is the lower-case hexadecimal SHA-256 of its inputs, end to end. Null fields are ``-``; texts of any length are hashed
whole. Rows with equal doc_id, null included, are leaves of their own, in the order of their hashes; equal rows have equal
proofs up to their place. A null source is a source and comes first. Rows without a doc_id are not tampered with. An empty
table gives an empty log and no proofs; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, written

FAN_BITS = 4
FAN = 1 << FAN_BITS
#: Levels of a builder's subtree.
SPAN = 2
SEGMENT = FAN**SPAN
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LEAVES = "tree long, n long, i long, hash string, tag string, other string"
_LOG = "tree long, n long, segment long, pos long, level int, i long, hash string, tag string, other string"
_PATHS = "tree long, i long, subroot string, path string"
_PROVED = "tag string, leaf string, subroot string, proof_sha256 string, folded_root string"


def height(n: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def position(level: int, i: int, n: int) -> int:
    """Place in its tree's log, from 0, of the i-th node of a level, if the tree has n leaves."""
    last = min((i + 1) << (FAN_BITS * level), n) - 1
    before, e = last, last
    while e := e >> FAN_BITS:
        before += e
    return before + level


def size(n: int) -> int:
    """Nodes of a tree with n leaves."""
    return position(height(n), 0, n) + 1 if n else 0


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value with its length in front, so that no two rows read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)).cast("binary"), 256)


class _Segment:
    """What one builder has appended: nodes by place, from the place of its first leaf."""

    def __init__(self, n: int, segment: int, base: int):
        self.n, self.segment, self.base = n, segment, base
        self.levels = min(SPAN, height(n) - base)
        self.open: list[list[str]] = [[] for _ in range(self.levels)]

    def append(self, i: int, hash_: str) -> Iterator[tuple[int, int, str]]:
        """The nodes (level, number, hash) that this one completes, itself first."""
        level, total = 0, self.count(0)
        while True:
            yield level, i, hash_
            if level == self.levels:
                return
            self.open[level].append(hash_)
            if (i + 1) % FAN and i + 1 < total:
                return
            hash_, self.open[level] = h(*self.open[level]), []
            level, i, total = level + 1, i >> FAN_BITS, -(-total // FAN)

    def count(self, level: int) -> int:
        """Nodes on a level of the segment's generation."""
        return -(-self.n // (FAN ** (level + self.base)))


def _builder(base: int):
    """Rows of ``_LEAVES`` sorted by tree and number, as the log's rows; leaves of this generation lie ``base`` levels up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key = None, None
        for batch in batches:
            out: list[tuple] = []
            for tree, n, i, hash_, tag, other in zip(*(batch[k].to_pylist() for k in range(6)), strict=True):
                if key != (tree, i // SEGMENT):
                    key, now = (tree, i // SEGMENT), _Segment(n, i // SEGMENT, base)
                for level, at, made in now.append(i, hash_):
                    own = (tag, other) if level == 0 else (None, None)
                    out.append((tree, n, now.segment, position(base + level, at, n), base + level, at, made, *own))
            yield _table(out, _LOG)

    return run


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names = [x.split(" ") for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], [n for n, _ in names])


def _by_segment(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("tree", "segment").sortWithinPartitions("tree", "segment", *order)


def _reaches(level: int) -> Column:
    """Whether one node of the level covers all of a tree's n leaves."""
    return F.col("n") <= FAN**level


def build(leaves: DataFrame, most: int) -> list[DataFrame]:
    """The log of all trees by generation, from the leaves up. Leaves have the columns of ``_LEAVES``; ``most`` is the largest n."""
    logs, base, null = [], 0, F.lit(None).cast("string")
    while True:
        placed = leaves.withColumn("segment", F.shiftright("i", FAN_BITS * SPAN))
        names = [x.split(" ")[0] for x in _LEAVES.split(", ")]
        logs.append(written(arrow_map(_by_segment(placed, "i").select(*names), _builder(base), _LOG), "log"))
        base += SPAN
        if base >= height(most):
            return logs
        roots = logs[-1].where((F.col("level") == base) & ~_reaches(base))
        leaves = roots.select("tree", "n", "i", "hash", null.alias("tag"), null.alias("other"))


def tops(logs: list[DataFrame]) -> DataFrame:
    """tree, n and ``hash`` of each tree's root, the last node of its log."""
    found = None
    for k, log in enumerate(logs):
        levels = range(k * SPAN + (k > 0), (k + 1) * SPAN + 1)
        last = log.where(" OR ".join(f"level = {at} AND i = 0 AND n <= {FAN**at}" + (f" AND n > {FAN ** (at - 1)}" if at else "") for at in levels)).select("tree", "n", "hash")
        found = last if found is None else found.unionByName(last)
    return found


def _siblings(now: dict[int, str], i: int, n: int, base: int, levels: int) -> Iterator[tuple[int, list[str]]]:
    """For each level of a segment the place of node i's path in its run and the run's other nodes, read by position."""
    for level in range(base, base + levels):
        total, first = -(-n // FAN**level), i & ~(FAN - 1)
        yield i - first, [now[position(level, j, n)] for j in range(first, min(first + FAN, total)) if j != i]
        i >>= FAN_BITS


def encoded(path: list[tuple[int, list[str]]]) -> str:
    return ";".join(f"{at}:{''.join(others)}" for at, others in path)


def decoded(path: str) -> list[tuple[int, list[str]]]:
    steps = [step.partition(":") for step in path.split(";")] if path else []
    return [(int(at), [run[k : k + 64] for k in range(0, len(run), 64)]) for at, _, run in steps]


def fold(hash_: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its siblings make."""
    for at, others in path:
        hash_ = h(*others[:at], hash_, *others[at:])
    return hash_


def _prover(base: int, whole: bool):
    """Log rows of segments in order, each segment closed by a row of level -1 with the subroot and the path above it.

    Gives the path from each of the segment's leaves to the top, or with ``whole`` the proof's digest and the folded root.
    """

    def proofs(rows: list[tuple], subroot: str, above: str) -> Iterator[tuple]:
        now, upper = {row[2]: row[5] for row in rows}, decoded(above)
        for tree, n, _, level, i, hash_, tag, other in rows:
            if level != base:
                continue
            path = [*_siblings(now, i, n, base, min(SPAN, height(n) - base)), *upper]
            if whole:
                yield tag, hash_, subroot, h(*(x for _, others in path for x in others)), fold(other or hash_, path)
            else:
                yield tree, i, subroot, encoded(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch[k].to_pylist() for k in ("tree", "n", "pos", "level", "i", "hash", "tag", "other")), strict=True):
                if row[3] >= 0:
                    rows.append(row)
                else:
                    out += proofs(rows, row[5], row[7])
                    rows = []
            yield _table(out, _PROVED if whole else _PATHS)

    return run


def prove(logs: list[DataFrame], above: DataFrame, whole: bool = False) -> DataFrame:
    """The paths (``_PATHS``) of all leaves through their trees and then ``above`` (tree, subroot, path); ``whole``: ``_PROVED``.

    From the top down: a generation's paths are what the segments below have above them, one row for 256 nodes.
    """
    paths = None
    for k in range(len(logs) - 1, -1, -1):
        base, last = k * SPAN, k == 0
        firsts = logs[k].where((F.col("level") == base) & (F.col("i") % SEGMENT == 0)).select("tree", "n", "segment")
        over = firsts.where(_reaches(base + SPAN)).join(above, "tree").select("tree", "segment", "subroot", "path")
        if paths is not None:
            lower = paths.withColumnRenamed("i", "segment")
            over = over.unionByName(firsts.where(~_reaches(base + SPAN)).join(lower, ["tree", "segment"]).select(*over.columns))
        zero = F.lit(0).cast("long")
        end = over.select("tree", zero.alias("n"), "segment", F.lit(2**62).alias("pos"), F.lit(-1).alias("level"), zero.alias("i"), F.col("subroot").alias("hash"), F.lit("").alias("tag"), F.col("path").alias("other"))
        paths = arrow_map(_by_segment(logs[k].unionByName(end), "pos"), _prover(base, whole and last), _PROVED if whole and last else _PATHS)
        paths = paths if last else written(paths, "paths")
    return paths


@dataclass
class Manifest:
    """Logs of the sources' trees and of the tree above, by generation; ``trees`` has the source of each tree."""

    logs: list[DataFrame]
    upper: list[DataFrame]
    trees: DataFrame
    root: str | None

    def log(self) -> DataFrame:
        """The sources' logs as one table: a node's place in its source's log, its level, number and hash, in order within files."""
        parts = [log.where((F.col("level") > k * SPAN) | F.lit(k == 0)) for k, log in enumerate(self.logs)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        rows = out.join(self.trees.select("tree", "source"), "tree").select("source", "tree", "pos", "level", "i", "hash")
        return rows.repartitionByRange("tree", "pos").sortWithinPartitions("tree", "pos")

    def proofs(self) -> DataFrame:
        """For each leaf its doc_id as ``tag``, its subroot, its proof's digest, and the root that folding gives."""
        above = prove(self.upper, self.upper[0].select("tree", F.lit("").alias("subroot"), F.lit("").alias("path")).distinct())
        subroots = self.upper[0].where("level = 0").select("i", F.col("hash").alias("subroot"))
        over = above.drop("tree", "subroot").join(subroots, "i").withColumnRenamed("i", "tree")
        return prove(self.logs, written(over.select("tree", "subroot", "path"), "above"), whole=True)


def _placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves as ``_LEAVES`` wants them, and a row (tree, source, n) for each source, trees numbered in the order of source.

    Numbers come from range partitions and from one row for each partition and source, so a source may lie in all of them.
    """
    # null first, then by bytes
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("source")))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf(F.translate("text", _UPPER, _LOWER)))
    rows = written(docs.select(key.alias("key"), "doc_id", leaf(F.col("text")).alias("hash"), tampered.alias("other")), "leaves")
    table = _in_order(rows, "key", "doc_id", "hash")
    along = Window.partitionBy("key").orderBy("part")
    runs = table.groupBy("key", "part").agg(F.count("*").alias("k"), F.min("at").alias("first"))
    runs = written(runs.withColumn("before", F.sum("k").over(along) - F.col("k")), "runs")
    sources = _in_order(runs.groupBy("key").agg(F.sum("k").alias("n")), "key")
    parts = sources.groupBy("part").agg(F.count("*").alias("k"), F.min("at").alias("first"))
    parts = parts.withColumn("before", F.sum("k").over(Window.orderBy("part")) - F.col("k"))  # a row for each range
    trees = written(sources.join(parts, "part").select("key", "n", (F.col("before") + F.col("at") - F.col("first")).alias("tree")), "trees")
    starts = runs.join(trees, "key").select("key", "part", "tree", "n", "before", "first")
    i = F.col("before") + F.col("at") - F.col("first")
    leaves = table.join(starts, ["key", "part"]).select("tree", "n", i.alias("i"), "hash", F.col("doc_id").cast("string").alias("tag"), "other")
    return leaves, trees.select("tree", F.when(F.col("key") != "", F.substr("key", F.lit(2))).alias("source"), "n")


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    """The rows in range partitions, ``part``, with their rising place, ``at``; written, as the ranges might be cut elsewhere again."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered").withColumn("part", F.shiftright("at", 33))


def manifest(docs: DataFrame) -> Manifest:
    """The tree of all rows of a table with doc_id, source, lang, n_chars and text."""
    leaves, trees = _placed(docs)
    of = trees.agg(F.max("n"), F.count("*")).first()
    logs = build(leaves, of[0] or 0)
    null = F.lit(None).cast("string")
    subroots = tops(logs).select(F.lit(0).cast("long").alias("tree"), F.lit(of[1]).alias("n"), F.col("tree").alias("i"), "hash", null.alias("tag"), null.alias("other"))
    upper = build(subroots, of[1])
    root = tops(upper).first()
    return Manifest(logs, upper, trees, root and root["hash"])


def verified(docs: DataFrame) -> DataFrame:
    """Each row's leaf, subroot, root and proof, and what the proof says of the row after tampering."""
    made = manifest(docs)
    out = made.proofs().withColumn("root", F.lit(made.root))
    return out.select(F.col("tag").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
