"""SimHash near-duplicates against plain loops."""

import re

import numpy as np
import pytest
import xxhash

from regstat.llm import simhash
from regstat.llm.common import table
from regstat.llm.components import components
from tests.conftest import SF_SMALL


def fingerprint(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=2):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None and (low.get(r) is None or d < low[r]):
            low[r] = d
    return sorted(((d, fps[i], low.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_near_duplicates_brute_force(spark, edge_docs):
    for docs in (edge_docs, table(spark, SF_SMALL, "documents")):
        got = simhash.near_duplicates(docs).collect()
        got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=str)
        assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_within_counts_bits():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2 ** 63, 1, dtype=np.uint64)[0]
    flips = [sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 9, 300)]
    values = np.array([int(base) ^ f for f in flips], np.uint64)
    for radius in range(6):
        mask = simhash.within(simhash.planes_of(values), int(base), radius)
        got = np.unpackbits(mask.view(np.uint8), bitorder="little")[:300].astype(bool)
        assert (got == (np.bitwise_count(values ^ base) <= radius)).all()


@pytest.mark.parametrize("block", [4096, 8])
def test_links_of_hot_group(spark, block):
    """Hundreds of fingerprints around one, cut into blocks of any size."""
    rng = np.random.default_rng(3)
    values = {0x0123456789ABCDEF}
    while len(values) < 300:
        v = int(rng.choice(np.array(sorted(values), dtype=object)))
        values.add(v ^ (1 << int(rng.integers(64))))
    far = {int(v) for v in rng.integers(0, 2 ** 62, 50)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values | far]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = components(simhash.candidate_links(df, 2, block))
    by = {}
    for r in got.collect():
        by.setdefault(r.component, set()).add(r.node)
    assert len(by) == 1 and len(next(iter(by.values()))) == 300


def test_components_of_a_path(spark):
    edges = spark.range(200).selectExpr("id as u", "id + 1 as v")
    got = components(edges).collect()
    assert len(got) == 201 and {r.component for r in got} == {0}


def test_keep_one(spark, edge_docs, empty_docs):
    kept = simhash.keep_one(edge_docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(
        [(False, 1), (False, 2), (False, 5), (False, 7), (False, 8), (True, 0)])
    assert simhash.keep_one(empty_docs).collect() == []
    assert simhash.near_duplicates(empty_docs).collect() == []
    more = table(spark, SF_SMALL, "documents").selectExpr("*", "1 as fp", "2 as root", "3 as _fp")
    kept = simhash.keep_one(more)
    assert kept.columns == more.columns
    found = simhash.near_duplicates(more)
    assert kept.count() == found.select("component_id").distinct().count()
