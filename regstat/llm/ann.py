"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector to K integers floor((a . x + b) / w) with Gaussian
(2-stable) directions a. Scaled to unit length, the nearest vectors by inner
product of unit queries are the nearest in angle times length; the hash works
on directions, the exact reranking on the original vectors.

The buckets that have rows, with their counts, are few: a unit vector's
projection is standard normal, whatever the table holds. A query goes through
those of a table in the order of the estimated probability that a near vector
lies there: the projection of a vector at cosine c is normal with mean c *
(projection of the query) and variance 1 - c^2. It goes on until the
probabilities visited reach ``TARGET`` for c and for cosines between c and 1,
and the buckets hold more than k rows. In the first round c is what k / n of
a bounded sample reach with this query. In the second it is the least cosine
that a vector can have with a score of the query's own k-th best found, and
what that asks for beyond the first round is visited. Queries that hold fewer
than k rows of positive score then visit every bucket of one table.

Every row is in a bucket of every table; buckets are cut into blocks of
bounded size, and each block goes to the groups of queries of which one probes
its bucket, nowhere else. The candidates are scored exactly there; a query keeps the k best of each block
and a window merges the tables, each vector once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regstat.llm.common import buckets_for, written
from regstat.llm.vectors import best_per_query, matrix, valid_vectors

K, STEP = 20, 20
TABLES, HASHES, WIDTH, TARGET = 2, 3, 1.5, 0.75
SAMPLE, BLOCK, QUERY_BLOCK = 2000, 8192, 1024
TOWARDS_ONE = (0.0, 1 / 3, 2 / 3, 0.95, 0.9999)   # the cosines from c to 1 that are looked after


class Hashing:
    """The directions of all tables; made from a seed, the same everywhere."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables, hashes, dim))
        self.b = rng.uniform(0, width, (tables, hashes))
        self.width = width

    def projections(self, unit: np.ndarray, table: int) -> np.ndarray:
        return unit @ self.a[table].T


def bucket_key(cells: np.ndarray) -> np.ndarray:
    """One long per row of cell numbers (12 bits each)."""
    out = np.zeros(len(cells), np.int64)
    for j in range(cells.shape[1]):
        out = out << 12 | (np.clip(cells[:, j], -2048, 2047) + 2048)
    return out


def _below(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2)))


def cells_of(keys: np.ndarray, hashes: int) -> np.ndarray:
    """The cell numbers of bucket keys."""
    return np.stack([(keys >> 12 * (hashes - 1 - j) & 4095) - 2048 for j in range(hashes)], 1)


def probes(proj: np.ndarray, b: np.ndarray, width: float, cosine: np.ndarray, target: float,
           cells: np.ndarray, counts: np.ndarray, least: int) -> np.ndarray:
    """Per query (row) and bucket that has rows (column) whether to visit it:
    the likeliest first, until they hold ``target`` of the probability of a
    vector at the query's ``cosine``, and at every step from there to 1, and
    ``least`` rows."""
    out = np.zeros((len(proj), len(cells)), bool)
    ids = np.arange(len(proj))[:, None]
    for step in TOWARDS_ONE:
        c = (cosine + (1 - cosine) * step)[:, None]
        spread = np.sqrt(np.maximum(1e-9, 1 - c * c))
        p = np.ones(out.shape)
        for j in range(cells.shape[1]):
            known, at = np.unique(cells[:, j], return_inverse=True)
            low = known * width - b[j] - c * proj[:, j:j + 1]
            p *= (_below((low + width) / spread) - _below(low / spread))[:, at]
        order = np.argsort(-p, axis=1, kind="stable")
        reached = np.cumsum(np.take_along_axis(p, order, 1), 1)
        before = np.concatenate([np.zeros((len(p), 1)), reached[:, :-1]], 1)
        held = np.cumsum(counts[order], 1) - counts[order]
        out[ids, order] |= (before < target * reached[:, -1:]) | (held < least)
    return out


def near_cosine(unit: np.ndarray, ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray,
                n_rows: int, k: int) -> np.ndarray:
    """Per query the cosine that about k of n_rows vectors reach with it."""
    if not len(sample):
        return np.zeros(len(unit))
    cos = np.where(ids[:, None] == sample_ids, -1.0, unit @ sample.T)
    place = max(0, len(sample) - max(1, round(len(sample) * min(1.0, k / max(1, n_rows)))))
    return np.clip(np.partition(cos, place, axis=1)[:, place], 0.0, 0.98)


def search_embeddings(embeddings: DataFrame, step: int = STEP, k: int = K, tables: int = TABLES,
                      hashes: int = HASHES, width: float = WIDTH,
                      target: float = TARGET, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """The k nearest found (largest inner product, double) of every row whose
    vec_id is divisible by ``step`` among all rows with another vec_id:
    query_id, rank, vec_id, score; ties to the smaller id.

    Rows with a null id, null, empty or zero vectors, or null or non-finite
    components take no part; repeated rows count once; short vectors end in
    zeros. Other columns are ignored; an empty table gives an empty result.
    """
    zero = ~F.exists("embedding", lambda x: x != 0)
    rows = written(valid_vectors(embeddings).filter(~zero), "vectors")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim"),
                    F.max(norm).alias("longest")).first()
    n_rows, dim, longest = size["n"], size["dim"] or 1, size["longest"] or 1.0
    picked = rows.orderBy(F.xxhash64("vec_id")).limit(sample).toArrow()
    sample_ids = picked.column("vec_id").to_numpy()
    units = unit_rows(matrix(picked.column("embedding"), dim, np.float64)) if n_rows else np.zeros((0, dim))
    hashing = Hashing(dim, tables, hashes, width)

    def hashed(batches):
        """(vec_id, embedding, table, bucket)."""
        for batch in batches:
            unit = unit_rows(matrix(batch.column("embedding"), dim, np.float64))
            for t in range(tables):
                cells = np.floor((hashing.projections(unit, t) + hashing.b[t]) / width).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(np.full(len(unit), t, np.int32)), pa.array(bucket_key(cells))],
                    ["vec_id", "embedding", "_t", "_bucket"])

    index = rows.mapInArrow(hashed, "vec_id long, embedding array<double>, _t int, _bucket long")
    # buckets: at most (cells per hash) ** hashes * tables rows, whatever the table holds
    counted = sorted((r["_t"], r["_bucket"], r["_n"]) for r in
                     index.groupBy("_t", "_bucket").agg(F.count(F.lit(1)).alias("_n")).collect())
    of_table, keys, counts = np.array(counted or np.zeros((0, 3)), np.int64).reshape(-1, 3).T
    sizes = F.broadcast(rows.sparkSession.createDataFrame(
        [(i, t, key, -(-n // block)) for i, (t, key, n) in enumerate(counted)],
        "_b int, _t int, _bucket long, _nb int"))

    def asked(batches, again: bool):
        """The queries and the numbers of the buckets to visit; ``again``: of
        those not visited yet, by the k-th best score found (null: none)."""
        for batch in batches:
            out = []
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                x = matrix(part.column("embedding"), dim, np.float64)
                unit = unit_rows(x)
                if again:
                    least = part.column("_least").to_numpy(zero_copy_only=False).astype(float)
                    length = np.maximum(np.linalg.norm(x, axis=1), 1e-300)
                    cosine = np.clip(np.nan_to_num(least / length / longest), 0.0, 0.98)
                    lacking = ~(least > 0)
                else:
                    cosine = near_cosine(unit, part.column("vec_id").to_numpy(), units, sample_ids, n_rows, k)
                visit = np.zeros((len(x), len(keys)), bool)
                for t in range(tables):
                    own = np.flatnonzero(of_table == t)
                    visit[:, own] = probes(hashing.projections(unit, t), hashing.b[t], width, cosine, target,
                                           cells_of(keys[own], hashes), counts[own], k + 1)
                if again:
                    visit[lacking] = of_table == 0
                    for i, seen in enumerate(part.column("_visit")):
                        visit[i, seen.values.to_numpy()] = False
                out += [np.flatnonzero(v).astype(np.int32) for v in visit]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"),
                                              pa.array(out, pa.list_(pa.int32()))], ["vec_id", "embedding", "_visit"])

    shape = "vec_id long, embedding array<double>, _visit array<int>"
    first = written(rows.filter(F.col("vec_id") % step == 0).mapInArrow(lambda b: asked(b, False), shape), "asked")
    n_query_blocks = buckets_for(first.count(), QUERY_BLOCK)
    salted = F.xxhash64("vec_id", "embedding")
    blocks = (index.join(sizes, ["_t", "_bucket"])
              .withColumn("_rb", F.pmod(salted, F.col("_nb")).cast("int")))
    key = ["_b", "_rb", "_qb"]

    def rerank(q: pa.Table, r: pa.Table) -> pa.Table:
        parts = [pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                           "score": pa.array([], pa.float64())})]
        if q.num_rows and r.num_rows:
            own, ids = q.column("vec_id").to_numpy(), r.column("vec_id").to_numpy()
            qs, rs = (matrix(x.column("embedding"), dim, np.float64) for x in (q, r))
            for a in range(0, len(own), 256):
                i, c, s = nearest(qs[a:a + 256], rs, own[a:a + 256], ids, k)
                parts.append(pa.table({"query_id": own[a:a + 256][i], "vec_id": ids[c], "score": s}))
        return pa.concat_tables(parts)

    def visited(queries: DataFrame) -> DataFrame:
        probing = (queries.withColumn("_b", F.explode("_visit")).drop("_visit")
                   .withColumn("_qb", F.pmod(salted, F.lit(n_query_blocks)).cast("int")))
        left = (probing.join(sizes, "_b")
                .withColumn("_rb", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))))
        # at most buckets x query blocks rows
        right = blocks.join(written(probing.select("_b", "_qb").distinct(), "probed"), "_b")
        return (left.select("vec_id", "embedding", *key).groupBy(*key)
                .cogroup(right.select("vec_id", "embedding", *key).groupBy(*key))
                .applyInArrow(rerank, "query_id long, vec_id long, score double"))

    def best(found: DataFrame) -> DataFrame:
        return best_per_query(found.dropDuplicates(["query_id", "vec_id", "score"]), k, "double")

    found = written(best(visited(first)).select("query_id", "vec_id", "score"), "found")
    least = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("_least"))
    second = (first.join(least.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
              .select("vec_id", "embedding", "_visit", "_least").mapInArrow(lambda b: asked(b, True), shape))
    return best(found.unionByName(visited(written(second, "asked"))))


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def nearest(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int):
    """(query row, row, exact inner product) of the k best per query among
    rows of another id. Products for the choice come from one matrix product;
    those of the chosen are summed component by component, so that equal
    vectors get equal scores wherever they lie."""
    rough = queries @ rows.T
    slack = 1e-12 * np.abs(queries).sum(1) * max(1e-300, np.abs(rows).max()) + 1e-300
    out = []
    for i in range(len(queries)):
        line = np.where(ids == own[i], -np.inf, rough[i])
        take = min(k, int(np.isfinite(line).sum()))
        if not take:
            continue
        least = np.partition(line, len(line) - take)[len(line) - take]
        at = np.flatnonzero(line >= least - slack[i])
        exact = np.zeros(len(at))
        for j in range(queries.shape[1]):
            exact += queries[i, j] * rows[at, j]
        best = np.lexsort((ids[at], -exact))[:k]
        out.append((np.full(len(best), i), at[best], exact[best]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))
