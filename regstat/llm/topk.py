"""Exact top-k by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights by term (component). The rows are
dealt by hash into blocks of bounded size, the queries too, and every query
block meets every row block once, on a key of its own, so a task holds two
blocks whatever the tables hold. In a task the row block becomes postings,
term by term (row numbers and weights; a list that holds most rows is kept
as a dense column); each term's posting list, times the query weights of the
term, is scattered into the queries' dense score arrays. Each pair of blocks
selects its best by partition; a window merges them. Every row is scored,
nothing is pruned: the work is queries x rows by the definition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regstat.llm.common import buckets_for, written
from regstat.llm.vectors import best_per_query, matrix, top_of_rows, valid_vectors

K, STEP, SCALE = 5, 50, 256
ROW_BLOCK, QUERY_BLOCK = 8192, 1024


def postings(rows: np.ndarray):
    """Per term: (term, row numbers or None for all rows, weights)."""
    for t in range(rows.shape[1]):
        weights = rows[:, t]
        at = np.flatnonzero(weights)
        if not len(at):
            continue
        if 2 * len(at) >= len(weights):
            yield t, None, weights
        else:
            yield t, at, weights[at]


def accumulate(queries: np.ndarray, rows: np.ndarray, tile: int = 32) -> np.ndarray:
    """Scores [queries, rows], int64, accumulated term by term."""
    scores = np.zeros((len(queries), len(rows)), np.int64)
    lists = [(t, at, np.ascontiguousarray(w)) for t, at, w in postings(rows)]
    for a in range(0, len(queries), tile):
        part = scores[a:a + tile]
        for t, at, w in lists:
            weights = queries[a:a + tile, t]
            live = np.flatnonzero(weights)
            if not len(live):
                continue
            if at is None and len(live) == len(weights):
                part += weights[:, None] * w
            elif at is None:
                part[live] += weights[live, None] * w
            else:
                part[np.ix_(live, at)] += weights[live, None] * w
    return scores


def exact_topk(queries: DataFrame, rows: DataFrame, n_rows: int, n_queries: int, k: int = K,
               row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score (long) of the k highest integer inner
    products of every query with all rows of another id; ties to the smaller
    id. Both tables: (vec_id, weights array<long>)."""
    nr, nq = buckets_for(n_rows, row_block), buckets_for(n_queries, query_block)
    block = lambda n: F.pmod(F.xxhash64("vec_id", "weights"), F.lit(n)).cast("int")
    left = (queries.withColumn("_q", block(nq))
            .withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)))))
    right = (rows.withColumn("_r", block(nr))
             .withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))))

    def search(q: pa.Table, r: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                         "score": pa.array([], pa.int64())})
        if not q.num_rows or not r.num_rows:
            return none
        dim = max(int(np.diff(c.combine_chunks().offsets.to_numpy()).max())
                  for c in (q.column("weights"), r.column("weights")))
        own, ids = q.column("vec_id").to_numpy(), r.column("vec_id").to_numpy()
        ws, rs = matrix(q.column("weights"), dim, np.int64), matrix(r.column("weights"), dim, np.int64)
        parts = []
        for a in range(0, len(own), 128):
            scores = accumulate(ws[a:a + 128], rs)
            i, c, s = top_of_rows(scores, ids, own[a:a + 128], k)
            parts.append(pa.table({"query_id": own[a:a + 128][i], "vec_id": ids[c], "score": s}))
        return pa.concat_tables(parts)

    found = (left.groupBy("_q", "_r").cogroup(right.groupBy("_q", "_r"))
             .applyInArrow(search, "query_id long, vec_id long, score long"))
    return best_per_query(found, k, "long")


def search_embeddings(embeddings: DataFrame, step: int = STEP, k: int = K,
                      scale: int = SCALE, **blocks) -> DataFrame:
    """The exact top k of every row whose vec_id is divisible by ``step``
    against all rows with another vec_id: query_id, rank, vec_id, score.

    A component x becomes the weight floor(scale * x). Rows with a null id, a
    null or empty vector, or null or non-finite components take no part;
    repeated rows count once; vectors of different lengths meet in their
    common components. Other columns are ignored; an empty table gives an
    empty result.
    """
    weights = F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    rows = written(valid_vectors(embeddings).select("vec_id", weights.alias("weights")), "weights")
    queries = rows.filter(F.col("vec_id") % step == 0)
    return exact_topk(queries, rows, rows.count(), queries.count(), k, **blocks)
