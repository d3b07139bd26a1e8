"""New columns of Arrow batches. A column that has the name of a new one is replaced: it doesn't clash."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def without(df: DataFrame, new: dict[str, str], *needed: str) -> DataFrame:
    """df less the columns that new ones replace, whatever their letter case; the columns needed have to stay."""
    names = {n.lower() for n in new}
    if lost := [n for n in needed if n.lower() in names]:
        raise ValueError(f"{lost} would be replaced before being read")
    return df.drop(*[c for c in df.columns if c.lower() in names])


def with_columns(df: DataFrame, new: dict[str, str]) -> T.StructType:
    """The schema of df with the new columns behind its own."""
    return T.StructType([*df.schema.fields, *df.select(*[F.lit(None).cast(t).alias(n) for n, t in new.items()]).schema.fields])


def replaced(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """batch with the new columns behind its own."""
    return pa.RecordBatch.from_arrays([*batch.columns, *new.values()], [*batch.schema.names, *new])
