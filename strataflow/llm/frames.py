"""Applying a pandas function to some columns of a frame of any shape."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import giving_back


def map_rows(df: DataFrame, run: Callable, added: str, reads: list[str]) -> DataFrame:
    """``df`` with the columns ``added`` that ``run`` makes of the columns ``reads``.

    ``run`` takes and gives an iterator of pandas frames, row for row.  The other columns travel as
    Arrow data and come back as they were, whatever their type.
    """
    new = T.StructType.fromDDL(added)
    names = [f.name for f in new]
    at = [df.columns.index(c) for c in reads]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.RecordBatch.from_arrays([batch.column(i) for i in at], names=reads)
            for out in run(iter([part.to_pandas()])):
                made = pa.RecordBatch.from_pandas(out[names], schema=kinds, preserve_index=False)
                yield pa.RecordBatch.from_arrays([*batch.columns, *made.columns], names=[*batch.schema.names, *names])

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(new)
    return df.mapInArrow(giving_back(work), T.StructType([*df.schema.fields, *new.fields]))
