"""Folds over the ordered rows of each key.

Rows are dealt by key and sorted within partitions, and each task streams through
its own once, holding one key's rows at a time. Unlike a call per group, the cost
of a small group is only its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def folded(rows: DataFrame, key: str, order: list[str], fold: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """Applies ``fold`` to the ordered rows of every key; ``key`` must be the first column."""
    if rows.columns[0] != key:
        raise ValueError(f"{key} must be the first column")
    kind = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        held: list[tuple] = []

        def made(groups: list[list[tuple]]) -> pa.RecordBatch:
            out = [row for group in groups for row in fold(group)]
            columns = list(zip(*out, strict=True)) or [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            groups = [list(g) for _, g in groupby(held, key=itemgetter(0))]
            held = groups.pop() if groups else []
            if groups:
                yield made(groups)
        if held:
            yield made([held])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
