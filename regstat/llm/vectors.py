"""What both vector searches share: valid vectors, packed blocks, merging."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid_vectors(df: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>) of the rows that take part: the id
    is not null, the vector neither null nor empty, without null or
    non-finite components. Repeated rows count once."""
    vec = F.col("embedding").cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (df.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("embedding"))
            .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
            .filter((F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(False)))
            .dropDuplicates(["vec_id", "embedding"]))


def matrix(column, dim: int, dtype) -> np.ndarray:
    """Rows of an Arrow list column as a matrix; short rows end in zeros."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    lengths = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), dim), dtype)
    if len(lengths) and (lengths == lengths[0]).all():
        out[:, :lengths[0]] = values.reshape(len(lengths), lengths[0])
    else:
        row = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[row, at] = values
    return out


def top_of_rows(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """(query row, candidate, score): per row the k highest scores among the
    candidates with another id than ``own``; ties to the smaller id."""
    rows, cols = [], []
    n = scores.shape[1]
    for i in range(scores.shape[0]):
        line = scores[i]
        take = min(n, k + int((ids == own[i]).sum()))
        if take < n:
            least = np.partition(line, n - take)[n - take]
            at = np.flatnonzero(line >= least)
        else:
            at = np.arange(n)
        at = at[ids[at] != own[i]]
        at = at[np.lexsort((ids[at], -line[at]))][:k]
        rows.append(np.full(len(at), i))
        cols.append(at)
    r, c = np.concatenate(rows), np.concatenate(cols)
    return r, c, scores[r, c]


def best_per_query(found: DataFrame, k: int, kind: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every query."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", F.col("score").cast(kind).alias("score")))
