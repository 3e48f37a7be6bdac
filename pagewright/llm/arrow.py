"""Batch functions over Arrow, with the types taken from a Spark schema string."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from pagewright.session import with_package


def map_batches(df: DataFrame, fn: Callable[..., dict[str, list]], schema: str, start: Callable[[], object] | None = None) -> DataFrame:
    """Apply ``fn(columns as lists...)`` to each Arrow batch of ``df``.

    ``fn`` gets one list per column of ``df``, in order, after the value of ``start()``
    if that is given (made once per task), and returns lists by output column. Empty
    batches give empty batches; the number of rows may change.
    """
    with_package(df.sparkSession)
    spark_schema = _parse_datatype_string(schema)
    assert isinstance(spark_schema, StructType)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = () if start is None else (start(),)
        for batch in batches:
            if not batch.num_rows:
                continue
            out = fn(*first, *[c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
