"""What a Python worker keeps when a task ends."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa

from fleetglass.llm import common, overlaps, tokens


class Frame:
    """Takes the function that a frame would run in its workers."""

    def __init__(self, spark):
        self.sparkSession = spark

    def mapInArrow(self, f, schema):  # noqa: N802
        return f


def test_a_task_leaves_no_vocabulary_and_no_powers_to_the_next_operator(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")

    def encode(batches):
        for batch in batches:
            tokens.library_encoder(path)(batch["text"])
            yield batch

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50_000, 300)) for _ in range(400)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(400), pa.int64()), "text": texts})
    run = lambda f: sum(x.num_rows for x in common.arrow_map(Frame(spark), f, "")(iter([batch])))
    common._held.clear()
    assert run(encode) == run(encode) == 400
    assert list(common._held) == [path]  # the next task of the same operator finds it
    assert run(overlaps.sets_of(5, "doc_id")) == 400
    assert not common._held
    assert len(common._powers.get("up", ())) <= 1 << 16
