"""What near-duplicate detection holds."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from fleetglass.llm import common, neardup, overlaps


@pytest.mark.parametrize("step", [neardup._sketches, overlaps.sets_of(5, "doc_id")])
def test_hashing_of_shingles_holds_little_beside_its_rows(step):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50_000, 300)) for _ in range(4000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(4000), pa.int64()), "text": texts})
    common._powers.clear()
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in step(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 4000
    assert peak < 64 << 20
