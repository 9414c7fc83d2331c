"""Folds over rows in order: what a row gives depends on the state its forerunners left.

Rows are dealt by key and sorted within partitions; a task walks its sorted rows once, batch by batch, with
one state a key, and passes results on as it goes. A key of any size takes the memory of a batch.
One key's rows are one task's: their order is the meaning of the fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..functions.session import python_ready

#: Arrow types of the simple types that folds return.
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def ordered_fold(rows: DataFrame, by: str, order: tuple[str, ...], given: tuple[str, ...], start: Any, step: Callable[..., tuple[Any, tuple]], returns: str) -> DataFrame:
    """Columns `by`, `order` and `returns` (DDL) of every row.

    step(state, *values of `given`) -> (next state, values of `returns`); `start` is a key's first state.
    Null keys are one key; ties in `order` go by `given`.
    """
    python_ready(rows.sparkSession)
    keys = (by, *order)
    kept = rows.select(*dict.fromkeys((*keys, *given)))
    made = StructType.fromDDL(returns)
    schema = ", ".join([*(f"{c} {kept.schema[c].dataType.simpleString()}" for c in keys), returns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), start
        for batch in batches:
            out = []
            for key, *values in zip(*(batch.column(c).to_pylist() for c in (by, *given)), strict=True):
                if key != now:
                    now, state = key, start
                state, row = step(state, *values)
                out.append(row)
            columns = list(zip(*out, strict=True)) if out else [()] * len(made.fields)
            arrays = [pa.array(c, _ARROW[f.dataType.simpleString()]) for c, f in zip(columns, made.fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *arrays], names=[*keys, *made.names])

    return kept.repartition(by).sortWithinPartitions(by, *order, *given).mapInArrow(run, schema)
