"""Source divergence audit over run-length columns of a term x source matrix.

Each language keeps the terms that stand in at least ``min_docs`` of its
documents. Every source of a language gives each kept term, also those it
never uses, an integer share p = 1 + floor(10^9 (count + 5) / (N + 5 V)); two
sources differ by the sum of |p - q| over all kept terms.

Terms are counted per task on the bytes of the texts (in UTF-8 every byte of a
character beyond ASCII is a term byte), summed by source, then by language.
The kept part of the matrix is dealt into blocks of terms and, where a language
has many sources, into tiles of sources. In a block the vocabulary is reordered
so that equal counts stand together, each source's column is run-length
encoded, the run boundaries of a pair of sources are intersected, and |p - q|
is multiplied by the length of each common run. Blocks add up. All figures are
integers (shares by Decimal or Python integers), so no order changes a result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regstat.llm.common import written

MIN_DOCS, TOP_TERMS = 30, 50
SCALE, SMOOTH = 1_000_000_000, 5
#: terms in a block, sources in a tile, and distinct counts held by a task
BLOCK_TERMS, TILE_SOURCES, HELD = 16_384, 64, 300_000

#: bytes of terms as they are, A-Z lower-cased, everything else a space
FOLD = bytes((b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32) for b in range(256))


def _count(batches):
    """(lang, source, term, n, docs) of a task, given out whenever ``HELD``
    distinct counts are held."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                        ("n", pa.int64()), ("docs", pa.int64())])
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def given():
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 50_000):
                part = terms[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                    pa.array(part, pa.binary()).cast(pa.string()),
                    pa.array([n[t] for t in part], pa.int64()),
                    pa.array([docs[t] for t in part], pa.int64())], schema=schema)

    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        texts = batch.column("text")
        for i, key in enumerate(zip(langs, sources)):
            n, docs = held.setdefault(key, (Counter(), Counter()))
            terms = texts[i].as_buffer().to_pybytes().translate(FOLD).split()
            before = len(n)
            n.update(terms)
            docs.update(set(terms))
            size += len(n) - before
            if size > HELD:
                yield from given()
                held, size = {}, 0
    yield from given()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
                       F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("text"))
    return (rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(count: str, total: str):
    """The exact share of a count; ``total`` names N + 5 V. Decimals hold it."""
    return F.expr(f"1 + (cast({count} + {SMOOTH} as decimal(20,0)) * {SCALE}) "
                  f"div cast({total} as decimal(20,0))")


def _shares(counts: np.ndarray, total: int) -> np.ndarray:
    """The exact shares of an array of counts, by Python integers."""
    kinds, where = np.unique(counts, return_inverse=True)
    return np.array([1 + SCALE * (int(c) + SMOOTH) // total for c in kinds], np.int64)[where]


class Column:
    """A source's counts over a block's terms as runs of equal counts."""

    def __init__(self, counts: np.ndarray, total: int):
        self.starts = np.flatnonzero(np.r_[True, counts[1:] != counts[:-1]])
        self.shares = _shares(counts[self.starts], total)


def run_distance(a: Column, b: Column, length: int) -> int:
    """Sum of |p - q| over ``length`` terms: the run boundaries of both
    columns are intersected, each common run counts as often as it is long."""
    starts = np.union1d(a.starts, b.starts)
    lengths = np.diff(np.r_[starts, length])
    p = a.shares[np.searchsorted(a.starts, starts, side="right") - 1]
    q = b.shares[np.searchsorted(b.starts, starts, side="right") - 1]
    return sum((np.abs(p - q) * lengths).tolist())


def reordered(matrix: np.ndarray) -> np.ndarray:
    """Terms (columns) in an order that clusters equal counts: sorted by the
    sources' counts, the source with most occurrences first."""
    heavy = np.argsort(-matrix.sum(axis=1), kind="stable")
    return matrix[:, np.lexsort(matrix[heavy[::-1]])]


def _block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Partial distances of all pairs of two tiles of sources over one block
    of terms. Rows without a term name the sources and give N + 5 V as ``n``."""
    lang, _, a, b = (k.as_py() for k in key)
    named = table.filter(pc.is_null(table["term"]))
    sources = sorted(zip(named["source"].to_pylist(), named["tile"].to_pylist(), named["n"].to_pylist()))
    rows = table.filter(pc.is_valid(table["term"]))
    columns, length = [], 0
    if len(rows):
        terms = rows["term"].combine_chunks().dictionary_encode()
        length = len(terms.dictionary)
        place = {s: i for i, (s, _, _) in enumerate(sources)}
        at = np.fromiter((place[s] for s in rows["source"].to_pylist()), np.int64, len(rows))
        matrix = np.zeros((len(sources), length), np.int64)
        matrix[at, terms.indices.to_numpy()] = rows["n"].to_numpy()
        columns = [Column(counts, total) for (_, _, total), counts in zip(sources, reordered(matrix))]
    first, second, sums = [], [], []
    for i, (s, tile, _) in enumerate(sources):
        for j, (other, its, _) in enumerate(sources):
            if (tile, its) == (a, b) and (a != b or i < j):
                first.append(s)
                second.append(other)
                sums.append(run_distance(columns[i], columns[j], length) if length else 0)
    return pa.table({"lang": pa.array([lang] * len(sums), pa.string()), "source": pa.array(first, pa.string()),
                     "item": pa.array(second, pa.string()), "value": pa.array(sums, pa.int64())})


def _distances(kept: DataFrame, groups: DataFrame, block_terms: int, tile_sources: int) -> DataFrame:
    """(lang, source, item, value) of every pair of sources of a language, once."""
    per = groups.groupBy("lang").agg(
        F.ceil(F.count(F.lit(1)) / tile_sources).alias("tiles"),
        F.greatest(F.lit(1), F.ceil(F.max("n_terms") / block_terms)).alias("blocks"))
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile")
    cells = (kept.join(per, "lang")
             .select("lang", "source", "term", "n", tile, "tiles",
                     F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")))
    named = (groups.join(per, "lang")
             .select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("total").alias("n"),
                     tile, "tiles", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block")))
    met = (cells.unionByName(named)
           .withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col("tiles") - 1).cast("int"))))
           .select("lang", "block", F.least("tile", "_other").alias("a"), F.greatest("tile", "_other").alias("b"),
                   "source", "tile", "term", "n"))
    parts = (met.groupBy("lang", "block", "a", "b")
             .applyInArrow(_block, "lang string, source string, item string, value long"))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS,
                  block_terms: int = BLOCK_TERMS, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """How the sources of each language differ in their vocabulary: lang,
    source, part, item, value, rank.

    Part ``pair``: every other source of the language with the sum of the
    share differences, all ranks. Part ``term``: the kept terms that the source
    uses more than its language, with the difference, ranks to ``top_terms``.
    Ranks count from 1 by value descending, item ascending (UTF-8).

    Null text, lang and source are empty strings; a source without any term
    takes part with counts of zero, a language without kept terms has
    distances of zero; repeated rows are documents of their own; a source
    that stands alone has no ``pair`` rows; other columns are ignored; an
    empty table gives no rows. ``block_terms`` and ``tile_sources`` bound
    what one task holds and never change the result.
    """
    counts = written(term_counts(docs), "term-counts")
    vocabulary = written(counts.groupBy("lang", "term")
                         .agg(F.sum("docs").alias("_docs"), F.sum("n").alias("lang_n"))
                         .filter(F.col("_docs") >= min_docs).drop("_docs"), "vocabulary")
    kept = written(counts.drop("docs").join(vocabulary, ["lang", "term"]), "kept-terms")
    langs = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("lang_n").alias("_lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("_n"))
    five = F.lit(SMOOTH) * F.coalesce(F.col("n_terms"), F.lit(0))
    groups = written(
        docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
        .distinct().join(langs, "lang", "left").join(own, ["lang", "source"], "left")
        .select("lang", "source", F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
                (F.coalesce("_n", F.lit(0)) + five).alias("total"),
                (F.coalesce("_lang_n", F.lit(0)) + five).alias("lang_total")), "source-groups")

    pairs = (_distances(kept, groups, block_terms, tile_sources)
             .select("lang", F.explode(F.array(
                 F.struct("source", "item"),
                 F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("_p"), "value")
             .select("lang", "_p.source", F.lit("pair").alias("part"), "_p.item", "value"))
    ahead = (kept.join(groups, ["lang", "source"])
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                     (share("n", "total") - share("lang_n", "lang_total")).alias("value"))
             .filter("value > 0"))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = (pairs.withColumn("rank", F.row_number().over(place))
              .unionByName(ahead.withColumn("rank", F.row_number().over(place))
                           .filter(F.col("rank") <= top_terms)))
    return ranked.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
