"""Recursive rules over one key's rows in order, in bounded memory.

Rows are partitioned by key and sorted inside the partitions, so a fold holds one state at a time however long a key's
history is. The same step classes serve the streaming processors. ``fold_tables`` hands whole Arrow batches to rules that
work on columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def key_codes(table: pa.Table, column: str = "vehicle_id") -> tuple[list[str], np.ndarray]:
    """The key of each stretch of rows with one key, and where the stretches begin (one more than stretches)."""
    coded = pa.chunked_array([table[column].combine_chunks()]).combine_chunks().dictionary_encode() if table.num_rows else None
    if coded is None:
        return [], np.zeros(1, dtype=np.int64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
    names = coded.dictionary.to_pylist()
    return [names[codes[k]] for k in starts], np.append(starts, len(codes))


def _by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Partitioned by key, in as many parts as shuffles have: a fold costs more than its bytes tell, so small parts stay apart."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def fold_tables(df: DataFrame, keys: list[str], order: list[str], step: Callable, schema: str) -> DataFrame:
    """Runs one ``step()`` for each task over its sorted rows.

    The object's ``take(table)`` gets the rows batch by batch, every key's rows together and in order, and gives a table or
    None; ``end()`` gives what is left. Columns are put in the order of ``schema``.
    """
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = step()

        def shaped(out: pa.Table | None) -> Iterator[pa.RecordBatch]:
            if out is not None and out.num_rows:
                yield from out.select(shape.names).cast(shape).to_batches()

        for batch in batches:
            yield from shaped(state.take(pa.Table.from_batches([batch])))
        yield from shaped(state.end())

    return _by_key(df, keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _top_level(schema: str) -> list[str]:
    """The fields of a DDL string, split at commas outside brackets."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append(schema[start:i])
            start = i + 1
    return [*parts, schema[start:]]
