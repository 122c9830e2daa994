"""Shared pieces of the two vector searches: usable vectors, shards of bounded size, blocks of queries, best of all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors of a shard and queries of a block: what one task holds at a time.
SHARD_ROWS, BLOCK_QUERIES = 4096, 32_768

HITS = "query_id long, vec_id long, score {kind}"


def finite(column: str = "embedding"):
    """Whether a vector is there, not empty and has only finite components."""
    return F.coalesce((F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    """Equally long lists as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1 if len(column) else 0).astype(kind, copy=False)


def best(hits: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores, ties to the smaller vec_id; hits hold k a shard."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score first, ties to the smaller id."""
    if len(scores) > 4 * k:
        worst = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= worst)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]
