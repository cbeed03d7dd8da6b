"""Source divergence against plain loops and SQL."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from regstat.llm import divergence as dv
from regstat.llm.catalog import queries
from regstat.llm.common import table
from regstat.llm.oracle import ORACLES
from tests.conftest import SF_CHECK, SF_SMALL
from tests.oracle_compare import compare, duck

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, value int"


def brute(rows, min_docs=30, top=50):
    counts, df, groups = {}, {}, {}
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        terms = TERM.findall(low)
        groups.setdefault(lang, set()).add(source)
        counts.setdefault((lang, source), Counter()).update(terms)
        df.setdefault(lang, Counter()).update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        own = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        total = {s: sum(own[s].values()) + 5 * len(kept) for s in sources}
        share = {s: {t: 1 + 10 ** 9 * (own[s][t] + 5) // total[s] for t in kept} for s in sources}
        whole = {t: sum(own[s][t] for s in sources) for t in kept}
        n = sum(whole.values()) + 5 * len(kept)
        for s in sources:
            pair = [(-sum(abs(share[s][t] - share[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(-(share[s][t] - q), t.encode(), t) for t in kept if own[s][t]
                    if share[s][t] > (q := 1 + 10 ** 9 * (whole[t] + 5) // n)]
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item, -v, r) for r, (v, _, item) in enumerate(items, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_query_on_given_table(spark):
    rows = table(spark, SF_SMALL, "documents").select("text", "lang", "source").collect()
    assert found(queries()["op12_source_divergence"](spark, SF_SMALL)) == brute([tuple(r) for r in rows])


def test_oracle(spark):
    name = "op12_source_divergence"
    ok, n, _, detail = compare(spark, duck(SF_CHECK), name, queries()[name], ORACLES[name], SF_CHECK)
    assert ok and n, detail


@pytest.mark.parametrize("sizes", [{}, {"block_terms": 3, "tile_sources": 2}])
def test_edges_blocks_and_tiles(spark, sizes):
    rng = random.Random(4)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x1y", "日本", "k", "zz"]
    rows = [(" ".join(rng.choices(words, weights=range(1, 9), k=rng.randrange(40))) + "\x00 \t9 ",
             rng.choice(["en", "de"]), f"s{rng.randrange(7)}") for _ in range(400)]
    rows += [(None, None, None), ("", "en", ""), ("once only here", "fr", "a"), ("", "fr", "b"),
             ("the " * 60_000, "en", "s1"), ("beta", "en", None), ("beta", "en", None)]
    df = spark.createDataFrame([(i, *r, 1, "clash", 2) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    assert found(dv.audit_sources(df, **sizes)) == brute(rows)


def test_empty(spark, empty_docs):
    assert dv.audit_sources(empty_docs).collect() == []


def test_runs_are_exact_in_any_order():
    rng = np.random.default_rng(5)
    matrix = rng.integers(0, 3, (4, 500)) * rng.integers(0, 10 ** 12, (4, 1))
    clustered = dv.reordered(matrix)
    assert sorted(map(tuple, matrix.T)) == sorted(map(tuple, clustered.T))
    totals = [int(r.sum()) + 2500 for r in matrix]
    plain, packed = ([dv.Column(r, t) for r, t in zip(m, totals)] for m in (matrix, clustered))
    assert len(packed[0].starts) < len(plain[0].starts)
    for i in range(4):
        for j in range(i):
            want = sum(abs((1 + 10 ** 9 * (int(a) + 5) // totals[i]) - (1 + 10 ** 9 * (int(b) + 5) // totals[j]))
                       for a, b in zip(matrix[i], matrix[j]))
            assert dv.run_distance(plain[i], plain[j], 500) == want == dv.run_distance(packed[i], packed[j], 500)


def test_task_counts_are_given_out_in_parts(spark, monkeypatch):
    rows = [(i, "a b c a d" if i % 2 else "e f", "en", "s", 1) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long").coalesce(1)
    monkeypatch.setattr(dv, "HELD", 2)
    batches = [b for b in df.selectExpr("lang", "source", "cast(text as binary) as text").toArrow().to_batches(7)]
    parts = [r for b in dv._count(batches) for r in b.to_pylist()]
    total = Counter()
    for r in parts:
        total[r["term"]] += r["n"]
    assert len(parts) > 6 and total == Counter("a b c a d".split() * 25 + "e f".split() * 25)
