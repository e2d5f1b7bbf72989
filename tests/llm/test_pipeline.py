"""The pipeline's stages one after the other on a small table."""

from __future__ import annotations

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import corpus


def test_stages(spark, tmp_path):
    rows = [(d, t, "en", "s", len(t or "")) for d, t in corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    columns = docs.columns
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, "")
        out.write.parquet(str(tmp_path / str(at)))
        docs = spark.read.parquet(str(tmp_path / str(at)))
        after = {r["doc_id"]: r for r in docs.collect()} if at < 4 else {}
        if at < 4:
            assert docs.columns == columns, name
        if at == 0:
            assert {d for d, t in before if t and len(t) > 50} <= set(after)
        if at == 1:
            assert {d: brute.sha((r["text"] or "").encode()) for d, r in after.items()} == {d: x[2] for d, x in brute.lines(before).items()}
        if at == 2:
            assert set(after) == {d for d, (_, c) in brute.components(before).items() if c == d}
        if at == 3:
            assert sum(len(r["text"].encode()) for r in after.values()) <= sum(x[0] - x[1] for x in brute.substrings(before).values())
    assert {r["doc_id"] for r in docs.collect()} == {d for d, _ in before}
