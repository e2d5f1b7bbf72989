"""Sorting the windows of a shard of text by recursive induction, within bounded memory.

In memory a run of text is sorted by its suffixes: positions off a third of the places are named by three symbols and
sorted by recursion on the names, the last third is induced from the first symbol and the rank behind it, and both are
merged by rank tuples (Kaerkkaeinen, Sanders and Burkhardt, "Linear work suffix array construction"; its external form is
due to Dementiev et al.). Only a bounded prefix counts, so the recursion stops when the names cover it.

A shard beyond the memory bound is sorted run by run. Each run goes to disk as tuples of window, document, start and the
prefix shared with the tuple before; a priority queue over the runs merges them, ``FAN`` at a time over as many levels as
it takes, and a tuple that shares the whole window with the last one is of its class. The files have no names and vanish
with the task.
"""

from __future__ import annotations

import heapq
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np

RUN_BYTES = 2_000_000
FAN = 64


def _named(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64) + 1


def _ranks(symbols: np.ndarray, cover: int, stride: int, depth: int) -> np.ndarray:
    """Ranks from 1 of the suffixes of ``symbols`` as far as ``depth`` characters.

    A symbol stands for ``cover`` characters and begins ``stride`` characters after the one before.
    """
    n = len(symbols)
    if cover >= depth or n < 3 or symbols.max() == n:
        return symbols
    size = -(-n // 3) * 3 + 3
    s = np.zeros(size + 3, dtype=np.int64)
    s[:n] = symbols
    wide = int(s.max()) + 1
    one, two, zero = np.arange(1, size, 3), np.arange(2, size, 3), np.arange(0, size, 3)
    sample = np.concatenate([one, two])
    names = _named((s[sample] * wide + s[sample + 1]) * wide + s[sample + 2])
    rank = np.zeros(size + 3, dtype=np.int64)
    rank[sample] = _ranks(names, cover + 2 * stride, 3 * stride, depth)
    order = sample[np.argsort(rank[sample], kind="stable")]
    most = int(rank.max()) + 1
    short = lambda p: s[p] * most + rank[p + 1]
    long = lambda p: (s[p] * wide + s[p + 1]).astype(np.uint64) * np.uint64(most) + rank[p + 2].astype(np.uint64)
    zero = zero[np.argsort(short(zero), kind="stable")]
    first, second = order[order % 3 == 1], order[order % 3 == 2]
    short_zero, long_zero = short(zero), np.sort(long(zero))
    place = np.zeros(size + 3, dtype=np.int64)
    place[zero] = np.arange(len(zero)) + np.searchsorted(short(first), short_zero) + np.searchsorted(np.sort(long(second)), long(zero))
    place[order] = np.arange(len(order))
    place[first] += np.searchsorted(short_zero, short(first), "right")
    place[second] += np.searchsorted(long_zero, long(second), "right")
    return place[:n] + 1


def sorted_windows(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the order of the windows that begin there, and the prefix that each shares with the one before."""
    if not len(starts):
        return starts, np.zeros(0, dtype=np.int64)
    padded = np.concatenate([data, np.zeros(length + 8, dtype=np.uint8)])
    eight = np.zeros(len(data), dtype=np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k : k + len(data)]
    rank = _ranks(_named(eight), 8, 1, length)
    order = starts[np.argsort(rank[starts], kind="stable")]
    shared = np.zeros(len(order), dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(padded, length)
    for at in range(1, len(order), 20_000):
        end = min(len(order), at + 20_000)
        differ = views[order[at:end]] != views[order[at - 1 : end - 1]]
        shared[at:end] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    return order, shared


class _Segments:
    """Pieces of documents end to end: bytes, and for every window its document and its start there."""

    def __init__(self, pieces: list[tuple[bytes, int, int, int]]):
        sizes = np.array([len(p[0]) for p in pieces], dtype=np.int64)
        counts = np.array([p[3] for p in pieces], dtype=np.int64)
        self.data = np.frombuffer(b"".join(p[0] for p in pieces), dtype=np.uint8)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.starts = np.repeat(np.cumsum(sizes) - sizes, counts) + within
        self.doc = np.repeat(np.array([p[1] for p in pieces], dtype=np.int64), counts)
        self.at = np.repeat(np.array([p[2] for p in pieces], dtype=np.int64), counts) + within

    def ordered(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows by content, then document and start: their numbers, shared prefixes and places in the bytes."""
        where = np.zeros(len(self.data) + 1, dtype=np.int64)
        where[self.starts] = np.arange(len(self.starts))
        order, shared = sorted_windows(self.data, self.starts, length)
        own = where[order]
        own = own[np.lexsort((self.at[own], self.doc[own], np.cumsum(shared < length)))]
        return own, shared, self.starts[own]


def _stored(tuples: Iterable[tuple[bytes, int, int]], length: int):
    """One sorted run on disk: document, start and the prefix shared with the tuple before, then the rest of the window."""
    file, last = tempfile.TemporaryFile(), b""
    for window, doc, at in tuples:
        common = length if window == last else next((k for k, (x, y) in enumerate(zip(window, last)) if x != y), 0)
        file.write(struct.pack("<qqH", doc, at, common) + window[common:])
        last = window
    file.seek(0)
    return file


def _run(segments: _Segments, length: int) -> Iterator[tuple[bytes, int, int]]:
    """The windows of a run in memory by content, document and start."""
    own, _, order = segments.ordered(length)
    data = segments.data.tobytes()
    for k, p in zip(own.tolist(), order.tolist(), strict=True):
        yield data[p : p + length], int(segments.doc[k]), int(segments.at[k])


def _tuples(file, length: int) -> Iterator[tuple[bytes, int, int]]:
    """The tuples of a run on disk; a window is rebuilt from the prefix that it shares with the one before."""
    last = b""
    while head := file.read(18):
        doc, at, common = struct.unpack("<qqH", head)
        last = last[:common] + file.read(length - common)
        yield last, doc, at
    file.close()


class _Runs:
    """Sorted runs on disk, never more than ``FAN`` of one level: when these are there, a queue merges them into one of the next."""

    def __init__(self, length: int):
        self.length, self.levels = length, []

    def add(self, tuples: Iterable[tuple[bytes, int, int]], level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(_stored(tuples, self.length))
        if len(self.levels[level]) == FAN:
            files, self.levels[level] = self.levels[level], []
            self.add(heapq.merge(*(_tuples(f, self.length) for f in files)), level + 1)

    def merged(self) -> Iterator[tuple[bytes, int, int]]:
        return heapq.merge(*(_tuples(f, self.length) for level in self.levels for f in level))


def repeated_windows(pieces: Iterable[tuple[bytes, int, int, int]], length: int, run_bytes: int = RUN_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents and starts of the windows that occur earlier too, in (document, start) order, among all the pieces.

    A piece is (bytes, document, start of its first window, number of windows).
    """
    run, held, stored = [], 0, None
    for piece in pieces:
        run.append(piece)
        held += len(piece[0])
        if held >= run_bytes:
            stored = stored or _Runs(length)
            stored.add(_run(_Segments(run), length))
            run, held = [], 0
    if not stored:
        if run:
            s = _Segments(run)
            own, shared, _ = s.ordered(length)
            doc, at = s.doc[own], s.at[own]
            first = np.flatnonzero(shared < length)[np.cumsum(shared < length) - 1]
            # a window at the very place of the earliest, as rows that repeat a doc_id have, is as early
            late = (doc != doc[first]) | (at != at[first])
            yield doc[late], at[late]
        return
    if run:
        stored.add(_run(_Segments(run), length))
    last, first, docs, starts = None, None, [], []
    for window, doc, at in stored.merged():
        if window != last:
            last, first = window, (doc, at)
        elif (doc, at) != first:
            docs.append(doc)
            starts.append(at)
            if len(docs) >= 100_000:
                yield np.array(docs, dtype=np.int64), np.array(starts, dtype=np.int64)
                docs, starts = [], []
    yield np.array(docs, dtype=np.int64), np.array(starts, dtype=np.int64)
