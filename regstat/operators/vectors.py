"""Vector retrieval (S4 support, V1-V4, F4).

* ``coseno``: cosine of two array columns with built-in higher-order
  functions (sequential fold in double; a zero norm gives null).
* ``topk``: exact top-k per query over blocks that are pruned by bounds.
* ``embed``: hashing embedder stand-in for an embedding service, applied
  batch-wise with ``mapInPandas``.

Norms and the scores given out are accumulated one dimension at a time in
float64 (the same order as the SQL fold), so scores match an independent
engine bit for bit before rounding; BLAS products only select what is scored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regstat import config as cfg
from regstat.functions import columns as C
from regstat.functions.sizing import materializar

QUERY_BLOCK, CORPUS_BLOCK = 512, 4096


def _fold_dot(a, b) -> F.Column:
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, v: acc + v)


def norma(a) -> F.Column:
    """Euclidean norm of an array column (double)."""
    return F.sqrt(_fold_dot(C.col_(a), C.col_(a)))


def coseno(a, b) -> F.Column:
    """V1: cosine similarity; null when either norm is 0."""
    a, b = C.col_(a), C.col_(b)
    return _fold_dot(a, b) / F.nullif(norma(a) * norma(b), F.lit(0.0))


def boost(score, chunk_dep, chunk_year, q_dep, q_year) -> F.Column:
    """V2: x1.3 when the chunk's region equals the detected region, then x1.2
    when its year equals the detected year (no boost for an absent filter)."""
    s = C.col_(score)
    s = F.when(C.col_(q_dep).isNotNull() & (C.col_(chunk_dep) == C.col_(q_dep)),
               s * F.lit(cfg.REGION_BOOST)).otherwise(s)
    return F.when(C.col_(q_year).isNotNull() & (C.col_(chunk_year) == C.col_(q_year)),
                  s * F.lit(cfg.YEAR_BOOST)).otherwise(s)


def representantes(chunks: DataFrame, group: str = "label") -> DataFrame:
    """One query per group: the vector (and metadata) of its lowest id."""
    return chunks.groupBy(group).agg(
        F.min("vec_id").alias("q_vec_id"),
        F.min_by("embedding", "vec_id").alias("q_embedding"),
        F.min_by("meta_departamento", "vec_id").alias("q_departamento"),
        F.min_by("meta_anio", "vec_id").alias("q_anio"))


def _exact_dots(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise dot products accumulated one dimension at a time."""
    out = np.empty(len(m))
    step = max(1, 2_000_000 // max(1, m.shape[1]))
    for at in range(0, len(m), step):
        out[at:at + step] = (m[at:at + step] * q[at:at + step]).cumsum(axis=1)[:, -1]
    return out


def _matrix(column) -> np.ndarray:
    """An Arrow list column whose lists have one length, as float64 rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt(_exact_dots(m, m)) if m.shape[1] else np.zeros(len(m))


def _units(column):
    """(length, row numbers, unit vectors) of each length in a list column;
    null, zero and non-finite vectors are left out."""
    lengths = np.array([n or 0 for n in pc.list_value_length(column).to_pylist()], np.int64)
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        m = _matrix(column.take(pa.array(rows)))
        with np.errstate(over="ignore", invalid="ignore"):
            norm = _norms(m)
        ok = np.isfinite(norm) & (norm > 0)
        yield int(d), rows[ok], m[ok] / norm[ok, None]


#: Index of the exact search: most pivots, and the width of a ring around a
#: pivot (radians). Angles are widened by ``SLACK`` against rounding.
PIVOTS, RING, SLACK = 1024, 0.1, 1e-6
#: a query first visits blocks with this many times k rows
HOME_ROWS = 4


def _pivots(corpus: DataFrame, rows: int, per_block: int) -> dict[int, np.ndarray]:
    """Unit vectors the blocks are built around, by length: at most ``PIVOTS``
    rows, those with the smallest hashes; none if one block holds all rows."""
    n = 0 if rows <= per_block else min(PIVOTS, -(-2 * rows // per_block))
    out: dict[int, list] = {}
    for r in corpus.select("embedding", F.xxhash64("vec_id", "embedding").alias("h")).orderBy("h").limit(n).collect():
        for d, _, unit in _units(pa.array([r["embedding"]], pa.list_(pa.float32()))):
            out.setdefault(d, []).extend(unit)
    return {d: np.array(units) for d, units in out.items()}


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def _placed(corpus: DataFrame, pivots: dict) -> DataFrame:
    """Corpus rows with their block: dim (length), cell (nearest pivot, -1
    without one) and ring (angle to it); vectors that no cosine is defined
    for are left out."""
    schema = T.StructType([*corpus.schema.fields, T.StructField("dim", T.IntegerType()),
                           T.StructField("cell", T.IntegerType()), T.StructField("ring", T.IntegerType()),
                           T.StructField("angle", T.DoubleType())])

    def place(batches):
        for batch in batches:
            for d, rows, units in _units(batch.column("embedding")):
                if d in pivots:
                    angles = _angles(units, pivots[d])
                    cell = angles.argmin(axis=1)
                    angle = angles[np.arange(len(rows)), cell]
                else:
                    cell, angle = np.full(len(rows), -1), np.zeros(len(rows))
                own = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(np.full(len(rows), d, np.int32)), pa.array(cell.astype(np.int32)),
                     pa.array((angle / RING).astype(np.int32)), pa.array(angle)],
                    names=[*own.schema.names, "dim", "cell", "ring", "angle"])

    return corpus.mapInArrow(place, schema)


BLOCK = ("dim", "cell", "ring")
VISIT = ("query_id long, q_embedding array<float>, q_departamento string, q_anio int, "
         "dim int, cell int, ring int, home boolean")


def _bounds(d: int, units: np.ndarray, factor: np.ndarray, blocks: list, pivots: dict) -> np.ndarray:
    """Upper bound of the boosted cosine that each block can give each query:
    no row of a ring is nearer to the query than the ring itself (triangle
    inequality of angles); a boost can only raise a positive cosine."""
    gap = np.zeros((len(units), len(blocks)))
    known = [i for i, b in enumerate(blocks) if b.cell >= 0]
    if known:
        to = _angles(units, pivots[d])[:, [blocks[i].cell for i in known]]
        low = np.array([blocks[i].low for i in known]) - SLACK
        high = np.array([blocks[i].high for i in known]) + SLACK
        gap[:, known] = np.maximum(0.0, np.maximum(to - high, low - to) - SLACK)
    best = np.cos(np.minimum(gap, np.pi))
    return np.where(best > 0, best * factor[:, None], best) + 1e-9


def _visits(queries: DataFrame, blocks: list, pivots: dict, k: int, first: bool) -> DataFrame:
    """Which blocks a query visits. ``first``: those with the best bounds that
    hold some multiple of k rows together; else all others whose bound
    reaches ``floor``, the query's k-th best score so far (null: all)."""
    by_dim: dict[int, list] = {}
    for b in sorted(blocks, key=lambda b: (b.dim, b.cell, b.ring)):
        by_dim.setdefault(b.dim, []).append(b)
    schema = pa.schema([("query_id", pa.int64()), ("q_embedding", pa.list_(pa.float32())),
                        ("q_departamento", pa.string()), ("q_anio", pa.int32()), ("dim", pa.int32()),
                        ("cell", pa.int32()), ("ring", pa.int32()), ("home", pa.bool_())])

    def visit(batches):
        for batch in batches:
            known = [np.array(batch.column(c).is_valid()) for c in ("q_departamento", "q_anio")]
            floor = batch.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
            for d, rows, units in _units(batch.column("q_embedding")):
                own = by_dim.get(d)
                if not own:
                    continue
                size = np.array([b.rows for b in own])
                step = max(1, 4_000_000 // len(own))
                for at in range(0, len(rows), step):
                    r, u = rows[at:at + step], units[at:at + step]
                    factor = (np.where(known[0][r], cfg.REGION_BOOST, 1.0)
                              * np.where(known[1][r], cfg.YEAR_BOOST, 1.0))
                    bound = _bounds(d, u, factor, own, pivots)
                    order = np.argsort(-bound, axis=1, kind="stable")
                    held = np.cumsum(size[order], axis=1) - size[order]
                    home = np.zeros(bound.shape, bool)
                    np.put_along_axis(home, order, held < HOME_ROWS * k, axis=1)
                    wanted = home if first else ~home & ~(bound < floor[r][:, None])
                    q, b = np.nonzero(wanted)
                    for part in range(0, len(q), 20_000):
                        qi, bi = q[part:part + 20_000], b[part:part + 20_000]
                        taken = batch.take(pa.array(r[qi]))
                        yield pa.RecordBatch.from_arrays(
                            [taken.column(c) for c in ("query_id", "q_embedding", "q_departamento", "q_anio")]
                            + [pa.array(np.full(len(qi), d, np.int32)),
                               pa.array(np.array([own[i].cell for i in bi], np.int32)),
                               pa.array(np.array([own[i].ring for i in bi], np.int32)),
                               pa.array(home[qi, bi])], schema=schema)

    return (queries.select("query_id", "q_embedding", "q_departamento", "q_anio", "floor")
            .mapInArrow(visit, VISIT))


def _scorer(k: int):
    def score(q: pa.Table, c: pa.Table) -> pa.Table:
        """The k best rows of a block for each query that visits it. One BLAS
        product gives all cosines up to rounding; only rows within the error
        bound of a query's k-th are scored again, one dimension at a time."""
        out_q, out_c, out_s = [], [], []
        if len(q) and len(c):
            m, qm = _matrix(c["embedding"]), _matrix(q["q_embedding"])
            nm, nq = _norms(m), _norms(qm)

            def codes(left, right):
                seen: dict = {}
                return [np.array([-1 if v is None else seen.setdefault(v, len(seen)) for v in x.to_pylist()])
                        for x in (left, right)]

            (qdep, dep), (qyear, year) = (codes(q["q_departamento"], c["meta_departamento"]),
                                          codes(q["q_anio"], c["meta_anio"]))

            def boosted(s, i, j):
                s = np.where((qdep[i] >= 0) & (dep[j] == qdep[i]), s * cfg.REGION_BOOST, s)
                return np.where((qyear[i] >= 0) & (year[j] == qyear[i]), s * cfg.YEAR_BOOST, s)

            rows = np.arange(len(m))[None, :]
            rough = boosted((qm @ m.T) / (nq[:, None] * nm[None, :]), np.arange(len(qm))[:, None], rows)
            error = 4 * (m.shape[1] + 8) * 2.0 ** -52 * cfg.REGION_BOOST * cfg.YEAR_BOOST
            if len(m) > k:
                kth = np.partition(rough, len(m) - k, axis=1)[:, len(m) - k]
                i, j = np.nonzero(rough >= kth[:, None] - 2 * error)
            else:
                i, j = np.nonzero(np.ones(rough.shape, bool))
            s = np.concatenate([_exact_dots(m[j[at:at + 100_000]], qm[i[at:at + 100_000]])
                                for at in range(0, len(i), 100_000)]) / (nm[j] * nq[i])
            s = boosted(s, i, j)
            place = np.empty(len(m), np.int64)
            place[pc.sort_indices(c["vec_id"]).to_numpy()] = np.arange(len(m))
            order = np.lexsort((place[j], -s, i))
            i, j, s = i[order], j[order], s[order]
            top = np.arange(len(i)) - np.searchsorted(i, i) < k
            out_q, out_c, out_s = i[top], j[top], s[top]
        take = pa.array(np.asarray(out_q, np.int64)), pa.array(np.asarray(out_c, np.int64))
        return pa.table({"query_id": q["query_id"].take(take[0]), "vec_id": c["vec_id"].take(take[1]),
                         "score": pa.array(np.asarray(out_s, np.float64))})
    return score


def _scored(visits: DataFrame, placed: DataFrame, blocks: DataFrame, k: int,
            query_block: int, corpus_block: int) -> DataFrame:
    """(query_id, vec_id, score): every visited block meets its queries; a
    block goes to as many tasks as it and its queries have pieces, and a
    block that no query visits goes nowhere."""
    plan = (visits.groupBy(*BLOCK).agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("_nq"))
            .join(blocks.select(*BLOCK, F.ceil(F.col("rows") / corpus_block).cast("int").alias("_nc")), list(BLOCK)))

    def pieces(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = (visits.join(plan, list(BLOCK))
            .withColumn("_q", F.pmod(F.xxhash64("query_id"), F.col("_nq")).cast("int"))
            .withColumn("_c", pieces("_nc")))
    right = (placed.join(plan, list(BLOCK))
             .withColumn("_c", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("_nc")).cast("int"))
             .withColumn("_q", pieces("_nq")))
    keys = [*BLOCK, "_q", "_c"]
    schema = T.StructType([T.StructField("query_id", T.LongType()), placed.schema["vec_id"],
                           T.StructField("score", T.DoubleType())])
    return (left.select(*keys, "query_id", "q_embedding", "q_departamento", "q_anio").groupBy(*keys)
            .cogroup(right.select(*keys, "vec_id", "embedding", "meta_departamento", "meta_anio").groupBy(*keys))
            .applyInArrow(_scorer(k), schema))


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return (found.withColumn("posicion", F.row_number().over(w).cast("int"))
            .where(F.col("posicion") <= k))


def topk(queries: DataFrame, corpus: DataFrame, k: int = cfg.TOP_K,
         types: list | None = None, id_col: str = "vec_id",
         query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK,
         conteo: dict | None = None) -> DataFrame:
    """V3 (+V1, V2, F4): exact top-k chunks per query by boosted cosine.

    ``queries``: query_id, q_embedding, q_departamento, q_anio.
    ``corpus``: ``id_col`` (any orderable type), embedding, chunk_type,
    meta_departamento, meta_anio. Result: query_id, ``id_col``, score,
    posicion (1..k; ties by id ascending). Null, zero and non-finite vectors
    are never ranked; a query only meets vectors of its own length.

    The corpus is dealt into blocks: the nearest of at most ``PIVOTS`` sampled
    pivots and a ring of the angle to it. A query first visits the blocks
    with its best bounds, a few times k rows; its k-th score there is a floor,
    and of the other blocks only those are visited whose bound reaches it.
    Blocks are shipped to the queries that visit them, in pieces of
    ``corpus_block`` x ``query_block`` rows; neither size nor the pivots ever
    change the result. ``conteo`` receives the pairs of a query and a block
    there are, and those visited (this counts them, with two more jobs).
    """
    if types:
        corpus = corpus.where(F.col("chunk_type").isin(*types))
    c = corpus.select(F.col(id_col).alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"),
                      "meta_departamento", F.col("meta_anio").cast("int").alias("meta_anio")
                      ).where("embedding is not null")
    pivots = _pivots(c, c.count(), corpus_block)
    placed = materializar(_placed(c, pivots))
    blocks = materializar(placed.groupBy(*BLOCK).agg(
        F.count(F.lit(1)).alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high")))
    # at most pivots x rings rows, and one more for every vector length
    listed = blocks.collect()
    q = queries.select(F.col("query_id").cast("long").alias("query_id"),
                       F.col("q_embedding").cast("array<float>").alias("q_embedding"), "q_departamento",
                       F.col("q_anio").cast("int").alias("q_anio"))
    first = materializar(_visits(q.withColumn("floor", F.lit(None).cast("double")), listed, pivots, k, True))
    found = _scored(first, placed, blocks, k, query_block, corpus_block)
    rest = None
    if any(b.cell >= 0 for b in listed):
        found = materializar(_best(found, k))
        floors = (found.where(F.col("posicion") == k)
                  .select(F.col("query_id").alias("_id"), F.col("score").alias("floor")))
        rest = materializar(_visits(q.join(floors, F.col("query_id") == F.col("_id"), "left").drop("_id"),
                                    listed, pivots, k, False))
        found = found.drop("posicion").unionByName(_scored(rest, placed, blocks, k, query_block, corpus_block))
    if conteo is not None:
        visited = first.count() + (rest.count() if rest is not None else 0)
        conteo.update(pares=q.count() * len(listed), visitados=visited)
    return _best(found, k).withColumnRenamed("vec_id", id_col)


TOKEN = re.compile("[0-9a-zà-ÿ]+")


def hash_embed_texts(texts, dim: int) -> np.ndarray:
    """Deterministic hashing embedder (a stand-in for a real model: it
    carries no meaning). A token's MD5 gives its bucket (first seven hex
    digits) and its sign (the eighth); counts are L2-normed in double. A text
    without tokens, or a null, is the zero vector."""
    m = np.zeros((len(texts), dim), dtype=np.float64)
    for i, t in enumerate(texts):
        if t is None:
            continue
        for token, times in Counter(TOKEN.findall(t.lower())).items():
            h = hashlib.md5(token.encode("utf-8")).hexdigest()
            m[i, int(h[:7], 16) % dim] += times if h[7] < "8" else -times
        n = np.sqrt((m[i] * m[i]).sum())
        if n > 0:
            m[i] /= n
    return m.astype(np.float32)


def embed(df: DataFrame, text_col: str, dim: int, out_col: str = "embedding",
          batch_size: int = cfg.EMBED_BATCH, embedder=None) -> DataFrame:
    """V4: embed a text column batch-wise on the executors. ``embedder`` is
    ``f(list[str], dim) -> ndarray``; the default is the hashing stand-in.
    ``batch_size`` is the number of texts handed to the embedder at once."""
    fn = embedder or hash_embed_texts
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def run(batches):
        for pdf in batches:
            texts = pdf[text_col].tolist()
            vecs = []
            for i in range(0, len(texts), batch_size):
                vecs.extend(list(fn(texts[i:i + batch_size], dim)))
            pdf[out_col] = [np.asarray(v, dtype=np.float32) for v in vecs]
            yield pdf

    return df.mapInPandas(run, schema)
