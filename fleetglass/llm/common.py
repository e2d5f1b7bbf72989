"""What the text operators share: byte-level views of Arrow columns, hashes of words.

Null texts count as empty. All hashes are 64-bit and wrap around.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import discard, fresh, shared_path, written

__all__ = ["discard", "fresh", "shared_path", "written"]

SLICE_BYTES = 2 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes rather than rows, so that neither long texts nor many short ones hurt a Python worker.

    Spark reads these settings when a frame runs, so they hold for the session from here on, with one value for all operators.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``most`` bytes of ``column``; one longer text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(lo, hi - lo)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, end to end, and where each row begins (one more than rows)."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return whole[where[0] : where[-1]], where - where[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than ASCII space, and how many words precede each row."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = solid
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = solid
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return _LOWER[data]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of each 64-bit value."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Powers that a worker keeps between tasks, and what else it keeps by name: the value, and whether this task has used it.
_KEPT_POWERS = 1 << 16
_held: dict[str, list] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task, made when it is first asked for; a task that does not use it lets it go."""
    if name not in _held:
        _held[name] = [make(), True]
    _held[name][1] = True
    return _held[name][0]


def let_go() -> None:
    """Gives back the memory that the next task, which may be of another operator, need not use: workers live on for a whole session."""
    for name in [k for k, (_, used) in _held.items() if not used]:
        del _held[name]
    for kept in _held.values():
        kept[1] = False
    if len(_powers.get("up", ())) > _KEPT_POWERS:
        _powers.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n + n // 4, 1 << 16)
        for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 2**64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers, from which ``span_hash`` takes the hash of any span."""
    up, _ = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span that depends only on its bytes."""
    _, down = _power(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows_hash(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` values."""
    if len(h) < width:
        return np.zeros(0, dtype=np.uint64)
    n, out = len(h) - width + 1, np.zeros(len(h) - width + 1, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(0xFF51AFD7ED558CCD) + h[k : k + n]
    return mixed(out)


def arrow_map(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with batches of bounded size, after which a worker keeps little (``let_go``)."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            let_go()

    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
