"""An ordered fold by key whose state is more than one row: rows are dealt by key and sorted in their partition, and one pass carries a key's state from batch to batch.

A key's rows are never gathered, so a key with a third of all rows costs one task time but no memory beyond its state. Keys that end give their last rows
and are forgotten. The pass is a pure function of its input, so a lost task is simply done again."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of an output batch.
ROWS = 2000
Step = Callable[[Any, dict], Iterator[dict]]


def folded(rows: DataFrame, key: str, order: list[str], out: StructType, begin: Callable[[dict], Any], step: Step, end: Callable[[Any], Iterator[dict]]) -> DataFrame:
    """begin(first row) makes a key's state, step(state, row) changes it and may give rows, end(state) gives the last ones. Rows are dicts; columns that a given row lacks are null."""
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, made = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row[key] != now:
                    if state is not None:
                        made += end(state)
                    now, state = row[key], begin(row)
                made += step(state, row)
                if len(made) >= ROWS:
                    yield pa.RecordBatch.from_pylist(made, schema=schema)
                    made = []
        if state is not None:
            made += end(state)
        for at in range(0, len(made), ROWS):
            yield pa.RecordBatch.from_pylist(made[at : at + ROWS], schema=schema)

    return rows.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(run, out)
