"""Token ids as Parquet: list columns in dictionary or delta encoding, bounded row groups, page indexes.

Documents are range-partitioned and sorted by doc_id before they are encoded, so the files hold the ids in ascending
doc_id order. Beside ``ids`` a row carries its metadata (part, local_start, n_tokens): reading those columns alone, or a
range of doc_id, touches few pages. Absolute starts follow from one total for each part.

Null texts count as empty and hold the end id alone. Rows of equal doc_id stand in the order of their texts, null doc_id
first. An empty table writes no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, shared_path, slices
from .tokens import TOKEN_SLICE, crc, library_encoder

SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def _tokeniser(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = library_encoder(path), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", TOKEN_SLICE):
            ids, bounds = encoder(batch["text"])
            rows = batch.num_rows
            ended = bounds + np.arange(rows + 1)
            with_end = np.insert(ids, bounds[1:], np.uint32(end_id)).astype(np.int32)
            columns = [batch["doc_id"], pa.array(np.full(rows, part, dtype=np.int32)), pa.array(start + ended[:-1]), pa.array(np.diff(ended)), pa.ListArray.from_arrays(pa.array(ended.astype(np.int32)), pa.array(with_end))]
            start += int(ended[-1])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "local_start", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int, encoding: str = "dictionary", group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Writes the ids of all documents under ``path``; ``encoding`` is ``dictionary`` or ``delta``."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding}")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    out = arrow_map(ordered, _tokeniser(tokenizer, end_id), SCHEMA).write.option("compression", "zstd")
    out = out.option("parquet.enable.dictionary", str(encoding == "dictionary").lower()).option("parquet.dictionary.page.size", 1 << 20)
    out = out.option("parquet.writer.version", "v2").option("parquet.block.size", group_bytes).option("parquet.page.size", page_bytes)
    out.parquet(path)


def _with_starts(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """``start`` in place of part and local_start; ``totals`` has the number of ids of each part."""
    bases = totals.select("part", (F.sum("_total").over(Window.orderBy("part")) - F.col("_total")).alias("_base"))
    others = [c for c in rows.columns if c not in ("doc_id", "part", "local_start")]
    return rows.join(bases, "part").select("doc_id", (F.col("_base") + F.col("local_start")).alias("start"), *others)


def _files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows, rows.groupBy("part").agg(F.sum("n_tokens").alias("_total"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the number of ids of all documents before, in place of part and local_start."""
    return _with_starts(*_files(spark, path))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["ids"]
        values, bounds = ids.values.to_numpy(), ids.offsets.to_numpy()
        sums = [crc(values[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["part"], batch["local_start"], pa.array(np.diff(bounds), pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def token_digests(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the token files, reads them back: doc_id, start, n_tokens, ids_crc32.

    Ids are summed up where they are read; only the numbers meet the totals of the parts.
    """
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path, end_id)
    rows, totals = _files(docs.sparkSession, path)
    return _with_starts(arrow_map(rows, _checksums, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long"), totals)
