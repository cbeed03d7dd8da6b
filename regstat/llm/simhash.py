"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: XXH64 (seed 42) of every word shingle, a bit is set if it is
set in over half of the hashes. Equal fingerprints are one class. Classes
that differ in at most ``radius`` bits agree in at least two of
``radius + 2`` stretches of the 64 bits (pigeonhole), so they meet in one of
the groups that share two stretches (32 bits with radius 2).

Within a group the fingerprints are stored vertically: word w of plane b
holds bit b of 64 fingerprints. A fingerprint is compared with all of them
at once: each plane is XORed with its own bit and added to bitwise counters
(ones, twos, more) with carry-save steps; a block is abandoned as soon as
every distance in it is over the radius. Groups larger than a block are cut
into blocks and every pair of blocks is compared, on its own row key, so no
task holds a whole group. A block returns only links that join its
fingerprints into components, not all pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regstat.llm.common import released, written
from regstat.llm.components import components

SHINGLE, RADIUS, SEED, BLOCK = 3, 2, 42, 4096
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    """Unsigned XXH64 of every shingle of the text's words, repeats included;
    of the whole word sequence if there are fewer words, none if there are none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return []
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [hash64(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return [hash64(joined[a:b - 1], SEED) for a, b in zip(starts, ends[size - 1:])]


def fingerprints(texts: list, size: int = SHINGLE) -> np.ndarray:
    """uint64 fingerprint of every text; no words: zero."""
    out = np.zeros(len(texts), np.uint64)
    for i, t in enumerate(texts):
        hashes = shingle_hashes(t, size) if t else []
        if not hashes:
            continue
        counts = np.zeros(64, np.int64)
        for a in range(0, len(hashes), 8192):
            part = np.array(hashes[a:a + 8192], dtype="<u8")
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        set_bits = (2 * counts > len(hashes)).astype(np.uint8)
        out[i] = np.packbits(set_bits, bitorder="little").view("<u8")[0]
    return out


def with_fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long)."""
    def run(batches):
        for batch in batches:
            fp = fingerprints(batch.column("text").to_pylist(), size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {kind}, fp long")


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: uint64 [64, words], 64 fingerprints a word."""
    pad = -len(values) % 64
    padded = np.concatenate([values, np.zeros(pad, np.uint64)]).astype("<u8")
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")


def within(planes: np.ndarray, query: int, radius: int) -> np.ndarray:
    """Mask (uint64 words) of the fingerprints at ``radius`` bits or fewer
    from ``query``. The counters hold distances up to 2**k - 1 in k planes;
    ``over`` marks those beyond."""
    n_counters = max(1, radius.bit_length())
    over = np.zeros(planes.shape[1], np.uint64)
    counters = [np.zeros_like(over) for _ in range(n_counters)]
    for b in range(64):
        carry = planes[b] ^ ONES if query >> b & 1 else planes[b]
        for k in range(n_counters):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over = over | carry
        if b % 8 == 7:
            gone = over | _above(counters, radius)
            if (gone == ONES).all():
                return np.zeros_like(over)
    return ~(over | _above(counters, radius))


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Mask of counters greater than ``radius``, bit by bit from the top."""
    more, same = np.zeros_like(counters[0]), np.full_like(counters[0], ONES)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same = same & counters[k]
        else:
            more, same = more | (same & counters[k]), same & ~counters[k]
    return more


def links(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that join the fingerprints of a block (or of two blocks) into
    the components that their distances give: a forest, not all pairs."""
    other = left if right is None else right
    root = {int(v): int(v) for v in itertools.chain(left.tolist(), other.tolist())}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out, planes, n = [], planes_of(other), len(other)
    for v in left.tolist():
        mask = within(planes, v, radius)
        if not mask.any():
            continue
        hit = np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little")[:n])
        for w in other[hit].tolist():
            a, b = find(v), find(w)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((v, w))
    return out


def _stretches(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 2 stretches of the 64 bits."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _small_groups(values: np.ndarray, group: np.ndarray, radius: int):
    """Links in many sorted groups at once: every fingerprint is compared with
    the next ones of its group, distances of 64 pairs a word."""
    left, right = [], []
    n = len(values)
    for shift in range(1, n):
        i = np.flatnonzero(group[:n - shift] == group[shift:])
        if not len(i):
            break
        x = values[i] ^ values[i + shift]
        mask = within(planes_of(x), 0, radius)
        hit = i[np.unpackbits(mask.view(np.uint8), bitorder="little")[:len(i)].astype(bool)]
        left.append(values[hit])
        right.append(values[hit + shift])
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def candidate_links(classes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(u, v): links between distinct fingerprints ``classes`` (fp) that give
    the components of "at most ``radius`` bits apart"."""
    keys = []
    for i, ((a, n), (b, m)) in enumerate(itertools.combinations(_stretches(radius), 2)):
        def part(at, bits):
            return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1))
        keys.append(F.struct(F.lit(i).alias("t"),
                             F.shiftleft(part(a, n), m).bitwiseOR(part(b, m)).alias("k")))
    banded = classes.select("fp", F.explode(F.array(*keys)).alias("g")).select("fp", "g.t", "g.k")
    sizes = banded.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = (banded.join(sizes, ["t", "k"])
              .withColumn("nb", F.ceil(F.col("n") / block).cast("int"))
              .withColumn("b", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
              # block pairs (i <= j) that hold block b: itself with every other
              .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
              .select("t", "k", "n", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"),
                      "b", "fp"))
    dealt = (shared.repartition("t", "k", "i", "j")
             .sortWithinPartitions("t", "k", "i", "j", "b", "fp"))

    def run(batches):
        """Rows come sorted: whole (t, k, i, j) groups are cut off the front
        as soon as they are complete; a group has two blocks at most."""
        held = None

        def solve(t: pa.Table):
            cols = {c: t.column(c).to_numpy() for c in ("t", "k", "n", "i", "j", "b", "fp")}
            fp = cols["fp"].view(np.uint64)
            new = np.ones(len(fp), bool)
            if len(fp) > 1:
                new[1:] = np.any([cols[c][1:] != cols[c][:-1] for c in ("t", "k", "i", "j")], axis=0)
            group = np.cumsum(new)
            small = cols["n"] <= 16
            us, vs = _small_groups(fp[small], group[small], radius)
            us, vs = [us], [vs]
            starts = np.flatnonzero(new)
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(fp)]):
                if cols["n"][a] <= 16:
                    continue
                first = cols["b"][a:z] == cols["i"][a]
                left, right = fp[a:z][first], fp[a:z][~first]
                if cols["i"][a] == cols["j"][a]:
                    found = links(left, None, radius)
                else:
                    found = links(left, right, radius) if len(left) and len(right) else []
                if found:
                    pair = np.array(found, np.uint64)
                    us.append(pair[:, 0])
                    vs.append(pair[:, 1])
            u, v = np.concatenate(us), np.concatenate(vs)
            return pa.RecordBatch.from_arrays(
                [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            got = pa.Table.from_batches([batch])
            held = got if held is None else pa.concat_tables([held, got])
            if held.num_rows < 20_000:
                continue
            last = [held.column(c)[-1].as_py() for c in ("t", "k", "i", "j")]
            same = np.all([held.column(c).to_numpy() == x for c, x in zip(("t", "k", "i", "j"), last)],
                          axis=0)
            at = int(np.flatnonzero(same)[0])
            if at:
                yield solve(held.slice(0, at).combine_chunks())
                held = held.slice(at)
        if held is not None and held.num_rows:
            yield solve(held.combine_chunks())

    return dealt.mapInArrow(run, "u long, v long")


def _classified(docs: DataFrame, size: int, radius: int) -> DataFrame:
    """doc_id, fp, root (the component's smallest fingerprint), component_id."""
    prints = written(with_fingerprints(docs, size), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(candidate_links(classes.select("fp"), radius))
    rooted = (classes.join(linked, F.col("fp") == F.col("node"), "left")
              .select("fp", "first", F.coalesce("component", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_class = (rooted.join(named, "root")
                .select(F.col("fp").alias("_fp"), "root", "component_id"))
    return (prints.join(by_class, F.col("fp") == F.col("_fp"))
            .select("doc_id", "fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (long), component_id: documents whose fingerprints link,
    directly or through others, share a component, named by its smallest
    doc_id; a document without links is its own.

    A null or blank text has fingerprint zero and links like any other.
    Repeated rows are equal texts; a null doc_id takes part, and its component
    is null only if it holds no other id. Other columns are ignored; an empty
    table gives an empty result.
    """
    return _classified(docs, size, radius).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component: the one with the smallest doc_id (if
    several rows have that id, or the ids are all null: the one with the
    smallest fingerprint). All columns are kept.

    Rows are told apart by their id; only those whose id is null or repeated
    are told apart by id and fingerprint, which is computed again for them.
    """
    found = written(_classified(docs.select("doc_id", "text"), size, radius), "classified")
    best = (found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy("root", F.col("doc_id").alias("_keep_id")).agg(F.min("fp").alias("_keep_fp")))
    odd = (found.groupBy(F.col("doc_id").alias("_odd_id")).agg(F.count(F.lit(1)).alias("n"))
           .filter("n > 1 or _odd_id is null").select("_odd_id"))
    plain = best.join(odd, F.col("_keep_id").eqNullSafe(F.col("_odd_id")), "left_anti")
    kept = docs.join(plain.select("_keep_id"), F.col("doc_id") == F.col("_keep_id"), "left_semi")
    if odd.isEmpty():
        return kept
    again = docs.join(odd, F.col("doc_id").eqNullSafe(F.col("_odd_id")), "left_semi")
    mark = "_simhash_of_row"
    schema = T.StructType([*again.schema.fields, T.StructField(mark, T.LongType())])

    def run(batches):
        for batch in batches:
            fp = fingerprints(batch.column("text").to_pylist(), size)
            yield batch.append_column(mark, pa.array(fp.view(np.int64)))

    chosen = (again.mapInArrow(run, schema)
              .join(best, F.col("doc_id").eqNullSafe(F.col("_keep_id"))
                    & (F.col(mark) == F.col("_keep_fp")), "left_semi")
              .dropDuplicates(["doc_id", mark]).drop(mark))
    return kept.unionByName(chosen)
