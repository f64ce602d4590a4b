"""Nearest vectors by cosine: a query set against all rows, block by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of vectors and of queries; a task holds one of each and their products.
VECTOR_ROWS, QUERY_ROWS = 16_384, 1_024
DIGITS = 6


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, item, score, rank): for each query (id, v) the k vectors (id, v) of other ids with the greatest cosine.

    Scores are rounded to ``DIGITS``; equal ones go by id; a vector without
    length has the score 0 to all.  Every block of queries meets every block of
    vectors in a task of its own, and only k rows a query leave it.
    """
    n_v, n_q = (max(1, -(-df.count() // rows)) for df, rows in ((vectors, VECTOR_ROWS), (queries, QUERY_ROWS)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select(F.col("id").cast("long").alias("id"), "v", block(n_v).alias("vb")).withColumn("qb", every(n_q))
    right = queries.select(F.col("id").cast("long").alias("query"), F.col("v").alias("q"), block(n_q).alias("qc")).withColumn("vc", every(n_v))

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query": [], "item": [], "score": []}).astype({"query": "int64", "item": "int64", "score": "float64"})
        if not len(a) or not len(b):
            return out
        ids, asked = a["id"].to_numpy(), b["query"].to_numpy()
        x, y = (np.vstack([np.asarray(z, dtype=float) for z in col]) for col in (a["v"], b["q"]))
        x, y = (z / np.where(n > 0, n, 1.0) for z in (x, y) for n in [np.linalg.norm(z, axis=1, keepdims=True)])
        score = np.round(y @ x.T, DIGITS) + 0.0
        parts = []
        for i, row in enumerate(score):
            order = np.lexsort((ids, -row))
            order = order[ids[order] != asked[i]][:k]
            parts.append(pd.DataFrame({"query": asked[i], "item": ids[order], "score": row[order]}))
        return pd.concat(parts)

    best = left.groupBy("vb", "qb").cogroup(right.groupBy("vc", "qc")).applyInPandas(run, "query long, item long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)
