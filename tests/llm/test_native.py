"""Sharding and URL filter."""

import collections
import math
import zlib

import xxhash

from regstat.llm import sharding, url_filter
from regstat.llm.catalog import queries
from regstat.llm.common import table
from regstat.llm.oracle import ORACLES
from tests.conftest import SF_CHECK, SF_SMALL
from tests.oracle_compare import compare, duck


def draw(key, child, weight):
    h = xxhash.xxh64_intdigest(f"{key}|{child}".encode(), 42)
    return -math.log(((h >> 11) + 0.5) / 2 ** 53) / weight


def place(key, tree):
    for level in (lambda x: x.region, lambda x: x.rack, lambda x: f"s{x.shard}"):
        weights = collections.defaultdict(float)
        for leaf in tree:
            weights[level(leaf)] += leaf.weight
        child = min(weights, key=lambda c: (draw(key, c, weights[c]), c)) if len(weights) > 1 else next(iter(weights))
        tree = [leaf for leaf in tree if level(leaf) == child]
    return tree[0].shard


def test_sharding_brute_force(spark, edge_docs):
    tree = sharding.balanced_tree(24)
    for docs in (edge_docs, table(spark, SF_SMALL, "documents")):
        rows = sharding.shard_documents(docs).collect()
        want = collections.Counter()
        for r in docs.collect():
            raw = (r.text or "").encode()
            key = "" if r.doc_id is None else str(r.doc_id)
            want[(r.doc_id, len(raw) + 8, zlib.crc32(raw), place(key, tree),
                  place(key, sharding.grow(tree)))] += 1
        assert collections.Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard)
                                   for r in rows) == want
        slots = collections.defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
            assert r.grown_shard in (r.shard, 24)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_weights_confine_moves(spark):
    docs = spark.range(20000).selectExpr("cast(id as string) key")
    tree = sharding.balanced_tree(24)
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in tree]
    out = sharding.with_shard(sharding.with_shard(docs, docs.key, tree, "a"), docs.key, heavier, "b")
    region = {x.shard: x.region for x in tree}
    moved = out.filter("a <> b").select("a", "b").collect()
    assert moved and all(region[m.b] == region[5] for m in moved)
    counts = [r["count"] for r in out.groupBy("a").count().collect()]
    assert len(counts) == 24 and max(counts) < 1.25 * 20000 / 24


def test_sharding_many_buckets_and_empty(spark, empty_docs):
    from regstat.llm.common import gapless_rank

    df = spark.range(1000).selectExpr("id % 3 g", "id div 2 v")
    rows = gapless_rank(df, ["g"], ["v"], "r", 1000, per_bucket=40).collect()
    for g in range(3):
        own = sorted(r.r for r in rows if r.g == g)
        assert own == list(range(len(own)))
    assert len(rows) == 1000
    assert sharding.shard_documents(empty_docs).collect() == []


def test_url_filter_oracle(spark):
    fn = queries()["op8_url_filters"]
    ok, n, _, detail = compare(spark, duck(SF_CHECK), "op8", fn, ORACLES["op8_url_filters"], SF_CHECK)
    assert ok and n, detail


def test_url_filter_rules_and_edges(spark):
    urls = ["http://Example.ORG/es/1", "http://a.example.org/en/12?x#y", "https://x.org/", "http://x.org",
            "ftp://b.com/fr/", "http://b.com/de/x", "http://notcom/de/", None, "no scheme", "://", "a://h?x/fr/",
            "http://bad.net/x", "http://bad.net/x"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, "http://q.org/es/", "x")],
                                  "page_id long, url string, host string")
    labels = spark.createDataFrame([(11, 0, 0), (12, 0, 0), (None, 1, 0), (0, None, 0)]
                                   + [(11, 0, 0)] * 60 + [(2, 1, 0)] * 60, "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, labels).collect()}
    assert got[0] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("x.org", "/", "org/", "allow")
    assert got[3] == ("x.org", "", None, "allow")
    assert got[4] == ("b.com", "/fr/", "com/fr/", "allow")
    assert got[5] == ("b.com", "/de/x", "com/de/", "block")
    assert got[6] == ("notcom", "/de/", None, "allow")
    assert got[7] == got[8] == ("", "", None, "allow")
    assert got[9] == ("", "", None, "allow")
    assert got[10] == ("h", "", None, "allow")
    assert got[11] == got[12] == ("bad.net", "/x", None, "block")
    assert got[None] == ("q.org", "/es/", "org/", "allow")
    none = url_filter.filter_urls(pages.limit(0), labels.limit(0))
    assert none.collect() == []
