"""Exact-substring deduplication: every byte that a long enough string covers which also starts earlier is removed.

Equal strings must meet in one shard although documents are scattered. Each string of ``length`` bytes (a window) has an
anchor, the gram inside it whose hash is smallest, so equal windows have equal anchors at equal places (string
synchronising sets, Kempa and Kociumaka). Neighbouring windows with one anchor form a run, and runs are what is shuffled:

1. Runs of equal bytes are combined before the shuffle, inside each slice of text: all but the first are repeats.
2. By anchor hash, runs equal to an earlier one are repeats as a whole. Of the rest only those go on whose anchor also
   stands in another context.
3. These are cut into parts of at most ``PART`` windows at places fixed by the anchor. The windows of a part share a core
   of bytes, whose hash names the shard, so a frequent anchor spreads over its contexts.
4. Each shard is sorted by recursive induction with bounded memory (``induced``), which finds the windows that occur
   earlier among all of its parts.

Order is by (doc_id, start). Null texts count as empty. Rows without a doc_id take no part and come back unchanged. Rows
that share a doc_id are one document in the order: equal places in both are equally early, and what is removed from one is
removed from each, as far as it is long. An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, fresh, prefix_hash, slices, span_hash, utf8, written
from .induced import repeated_windows

LENGTH = 100
GRAM = 24
PART = 16
#: Longer slices, which are single long texts, are searched a segment at a time, for memory and for the bits of a place.
SEGMENT = 1 << 22
_PLACE = 24


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbouring keys."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: row, first window ``lo``, number of windows, place of the anchor, hashes."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return {"row": none, "lo": none, "windows": none, "anchor": none, "g": none, "content": none}
    if len(data) > SEGMENT + length:
        # a run that a segment's end cuts has other contents than its like, which sends all of them on to the sort
        found = []
        for row in np.flatnonzero(np.diff(offsets) >= length):
            for at in range(offsets[row], offsets[row + 1] - length + 1, SEGMENT):
                part = data[at : min(at + SEGMENT + length - 1, offsets[row + 1])]
                got = runs(part, np.array([0, len(part)]), length, gram)
                found.append(got | {"row": got["row"] + row, "lo": got["lo"] + at - offsets[row]})
        return {k: np.concatenate([f[k] for f in found]) for k in found[0]} if found else runs(data[:0], offsets[:1], length, gram)
    sums = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = span_hash(sums, at, at + gram)
    low = np.uint64((1 << _PLACE) - 1)
    best = (_smallest((grams & ~low) | at.astype(np.uint64), length - gram + 1) & low).astype(np.int64)
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    valid = np.repeat(offsets[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(valid):
        return runs(data[:0], offsets[:1], length, gram)
    anchor = best[valid]
    begins = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    windows = np.diff(np.concatenate([begins, [len(valid)]]))
    lo, anchor = valid[begins], anchor[begins]
    row = np.searchsorted(offsets, lo, "right") - 1
    content = span_hash(sums, lo, lo + windows + length - 1)
    return {"row": row, "lo": lo - offsets[row], "windows": windows, "anchor": anchor - lo, "g": grams[anchor].view(np.int64), "content": content.view(np.int64)}


def packed(lo: np.ndarray, windows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """A run's place in one number: lo, then ten bits for the windows and ten for the anchor."""
    return (lo << 20) | (windows << 10) | anchor


def _runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = runs(*utf8(batch["text"]), length, gram)
            doc = batch["doc_id"].to_numpy(zero_copy_only=False)[found["row"]].astype(np.int64)
            place = packed(found["lo"], found["windows"], found["anchor"])
            order = np.lexsort((place, doc, found["content"], found["g"]))
            g, content = found["g"][order].copy(), found["content"][order]
            late = np.concatenate([[False], (g[1:] == g[:-1]) & (content[1:] == content[:-1])]) if len(g) else np.zeros(0, dtype=bool)
            same_place = np.concatenate([[False], (doc[order][1:] == doc[order][:-1]) & (place[order][1:] == place[order][:-1])]) if len(g) else late
            late &= ~same_place
            # what is known needs no partner: it is dealt by its place
            g[late] = (doc[order][late] * 0x9E3779B1 + place[order][late] * 0x85EBCA77).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(content), pa.array(doc[order]), pa.array(place[order]), pa.array(late)], ["g", "content", "doc_id", "place", "known"])

    return run


def _spans(doc: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """Windows as spans of bytes, neighbours joined."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)])) if len(doc) else np.zeros(0, dtype=np.int64)
    last = np.concatenate([cut[1:], [len(doc)]])[: len(cut)] - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[cut]), pa.array(start[cut]), pa.array(start[last] + length)], ["doc_id", "lo", "hi"])


def _parts(length: int, part: int, column: str):
    """Cuts the runs of a text into parts and takes their bytes.

    Places may come from another row with the same doc_id; what lies beyond this text is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch["text"])
            whole = data.tobytes()
            core, piece, doc, lo, n = [], [], [], [], []
            for d, base, stop, places in zip(batch["doc_id"].to_pylist(), offsets.tolist(), offsets[1:].tolist(), batch[column].to_pylist(), strict=False):
                most = stop - base - length
                for place in places:
                    first, windows, anchor = place >> 20, (place >> 10) & 1023, place & 1023
                    # offsets of the anchor in the windows: from ``anchor`` down to ``anchor - windows + 1``
                    high = anchor
                    while high > anchor - windows:
                        low = max(high // part * part, anchor - windows + 1)
                        start, end = first + anchor - high, min(first + anchor - low, most)
                        if start <= end:
                            a = base + first + anchor - high // part * part
                            core.append(xxhash.xxh3_64_intdigest(whole[a : a - part + 1 + length]))
                            piece.append(whole[base + start : base + end + length])
                            doc.append(d)
                            lo.append(start)
                            n.append(end - start + 1)
                        high = low - 1
            hashes = np.array(core, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(doc, pa.int64()), pa.array(lo, pa.int64()), pa.array(n, pa.int64()), pa.array(piece, pa.binary())], ["core", "doc_id", "lo", "windows", "piece"])

    return run


SHARD_BYTES = 1_500_000


def _shards(length: int, shard_bytes: int):
    """Whole groups of equal core, gathered up to a bound; a larger group streams through the sorter alone."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple[bytes, int, int, int]]]:
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("core", "piece", "doc_id", "lo", "windows"))
            for core, *piece in zip(*columns, strict=True):
                yield core, tuple(piece)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        for doc, start in repeated_windows(held, length, shard_bytes):
            yield _spans(doc, start, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rows = [], 0, groups(batches)
        ahead = next(rows, None)
        while ahead is not None:
            core, group, own = ahead[0], [], 0
            while ahead is not None and ahead[0] == core and own < shard_bytes:
                group.append(ahead[1])
                own += len(ahead[1][0])
                ahead = next(rows, None)
            if ahead is not None and ahead[0] == core:

                def rest(first: list = group, of: int = core) -> Iterator[tuple[bytes, int, int, int]]:
                    nonlocal ahead
                    yield from first
                    while ahead is not None and ahead[0] == of:
                        yield ahead[1]
                        ahead = next(rows, None)

                yield from flush(rest())
            elif len(group) > 1:  # a core that stands alone repeats nothing
                if size + own > shard_bytes:
                    yield from flush(held)
                    held, size = [], 0
                held += group
                size += own
        yield from flush(held)

    return run


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, part: int = PART, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, lo and hi of byte spans to remove; spans may touch or overlap."""
    (places,) = fresh(docs, "places")
    known = docs.where(F.col("doc_id").isNotNull())
    found = arrow_map(known.select("doc_id", "text"), _runs(length, gram), "g long, content long, doc_id long, place long, known boolean")
    dealt = found.repartition("g")
    # one exchange and one sort serve both windows
    along = Window.partitionBy("g").orderBy("content", "doc_id", "place")
    same = Window.partitionBy("g", "content").orderBy("doc_id", "place")
    run = F.struct("doc_id", "place")
    marked = dealt.withColumn("_first", F.first(run).over(same)).withColumn("_least", F.first("content").over(along))
    marked = marked.withColumn("_most", F.last("content").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    marked = marked.withColumn("_repeat", F.col("known") | (run != F.col("_first")))
    # the first run of a content goes on if its anchor has other contents too
    kept = written(marked.where(F.col("_repeat") | (F.col("_least") != F.col("_most"))).select("doc_id", "place", "_repeat"), "runs")
    whole = kept.where("_repeat").select("doc_id", F.shiftright("place", 20).alias("lo"), (F.shiftright("place", 20) + F.shiftright("place", 10).bitwiseAND(1023) + (length - 1)).alias("hi"))
    wanted = kept.where("NOT _repeat").groupBy("doc_id").agg(F.collect_list("place").alias(places))
    # all columns go along, so that the shuffle of the documents can serve the caller's join with the spans too
    cut = arrow_map(known.join(wanted, "doc_id").select(*[F.col(f"`{c}`") for c in docs.columns], places), _parts(length, part, places), "core long, doc_id long, lo long, windows long, piece binary")
    sorted_parts = cut.repartition("core").sortWithinPartitions("core")
    return whole.unionByName(arrow_map(sorted_parts, _shards(length, shard_bytes), "doc_id long, lo long, hi long"))


def _kept(texts: bool, cut: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch["text"])
            data = data.tobytes()
            out: list[tuple] = []
            for base, end, spans in zip(offsets.tolist(), offsets[1:].tolist(), batch[cut].to_pylist(), strict=False):
                merged: list[list[int]] = []
                for s in sorted((x["lo"], min(x["hi"], end - base)) for x in spans or ()):
                    if s[0] >= s[1]:
                        continue
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                edges = [0, *(x for s in merged for x in s), end - base]
                rest = b"".join(data[base + a : base + b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((end - base, sum(b - a for a, b in merged), len(merged), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if texts else None))
            sizes = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)]
            rest = batch.drop_columns(["text", cut])
            made = [*sizes, pa.array([x[3] for x in out], pa.string()), *[pa.array([x[4] for x in out], pa.string())] * texts]
            yield pa.RecordBatch.from_arrays([*rest.columns, *made], [*rest.schema.names, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["text"] * texts])

    return run


def dedup_substrings(docs: DataFrame, length: int = LENGTH, texts: bool = True, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents with n_bytes, n_removed, n_spans and kept_sha256, and ``text`` as what is left of it.

    Where a removed span ends inside a character, the rest of that character goes from ``text`` too. Input columns with the
    names of the new ones are replaced. ``shard_bytes`` bounds what one sort holds in memory.
    """
    added = {"n_bytes", "n_removed", "n_spans", "kept_sha256", "text"}
    others = [c for c in docs.columns if c not in added]
    (cut,) = fresh(docs, "spans_to_cut")
    base = docs.select(*[f"`{c}`" for c in others], "text")
    known = base.where(F.col("doc_id").isNotNull())
    spans = removed_spans(known, length, shard_bytes=shard_bytes).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias(cut))
    nothing = F.lit(None).cast(spans.schema[cut].dataType)
    names = [F.col(f"`{c}`") for c in base.columns]
    joined = known.join(spans, "doc_id", "left").select(*names, cut).unionByName(base.where(F.col("doc_id").isNull()).select(*names, nothing.alias(cut)))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    schema = f"{kinds}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * texts
    return arrow_map(joined.select(*[f"`{c}`" for c in others], "text", cut), _kept(texts, cut), schema)


def substring_digests(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""
    return dedup_substrings(docs.select("doc_id", "text"), length, texts=False, shard_bytes=shard_bytes)
