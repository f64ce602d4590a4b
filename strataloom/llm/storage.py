"""Shared-folder tables, as the rest of the package keeps them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strataloom.storage import Scratch, new_folder, remove, settle, shared_dir

__all__ = ["Scratch", "map_rows", "named", "new_folder", "remove", "settle", "shared_dir"]


def named(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name: Spark sees numbered columns, ``run`` the names of ``df``; it yields columns in the order of ``schema``."""
    names = df.columns
    plain = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    numbered = plain.names

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches):
            yield pa.RecordBatch.from_arrays(out.columns, names=numbered)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, plain).toDF(*schema.names)
