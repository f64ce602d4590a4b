"""Bounded samples by hash, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lowest_hashes(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows whose ``key`` hashes lowest (ties: least key).

    Where there are many more rows, those whose hash lies in a share that holds
    2 ``n`` rows on average are taken first, so that what is ordered in one
    place has a size that doesn't grow with the table.
    """
    place = F.xxhash64(key).cast("double") / 2.0**64 + 0.5
    total = rows.count()
    if total > 4 * n:
        rows = rows.where(place < 2.0 * n / total)
    return rows.orderBy(F.xxhash64(key), key).limit(n)
