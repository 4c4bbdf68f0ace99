"""Ordered folds: what a row gives depends on what the rows before it gave."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def folded(df: DataFrame, key: str, order: list[str], used: list[str], start: Callable[[], Any], step: Callable[..., tuple], out: str) -> DataFrame:
    """key and `out` (a schema) of each row: rows of a key go by in order, one state is carried along. step(state, *values of used) gives (state, row).

    Rows are sorted by Spark, which spills, and go by in batches, so a key may have any number of rows; nothing of a key is collected. Null keys are one key.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = T._parse_datatype_string(f"`{key}` {kind}, {out}")
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, first = None, None, True
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            rows = []
            for k, *values in zip(*cols, strict=True):
                if first or k != last:
                    last, state, first = k, start(), False
                state, row = step(state, *values)
                rows.append(row)
            made = [b.column(0)] + [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * (len(names) - 1), types, strict=True)]
            yield pa.RecordBatch.from_arrays(made, names)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in schema.fields[1:]]
    x = df.repartition(key).sortWithinPartitions(key, *order).select(key, *used)
    return x.mapInArrow(run, schema)
