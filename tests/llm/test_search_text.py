"""Vector searches, HTML text, quality classifier and pipeline."""

import zlib

import numpy as np
import pytest

from regstat.llm import ann, htmltext, quality, topk
from regstat.llm.common import table
from tests.conftest import SF_CHECK, SF_SMALL


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.5, -1.0]), (2, [0.5, -1.0]), (3, None),
            (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [0.0, 0.0]), (None, [1.0, 1.0]),
            (8, [3.0]), (9, [])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as rank")


def brute(rows, step, k, weigh, zero_ok):
    ok = {i: np.array(weigh(v)) for i, v in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero_ok or any(v))}
    dim = max(map(len, ok.values()), default=0)
    full = {i: np.pad(v, (0, dim - len(v))) for i, v in ok.items()}
    out = []
    for q in sorted(full):
        if q % step == 0:
            best = sorted(((-sum(a * b for a, b in zip(full[q].tolist(), v.tolist())), i)
                           for i, v in full.items() if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def test_exact_topk(spark, odd_vectors):
    floor = lambda v: [int(np.floor(256 * x)) for x in v]
    for df in (odd_vectors, table(spark, SF_SMALL, "embeddings")):
        rows = [(r.vec_id, r.embedding) for r in df.collect()]
        want = brute(rows, 50, 5, floor, True)
        for blocks in ({}, {"row_block": 40, "query_block": 2}):
            got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search_embeddings(df, **blocks).collect())
            assert got == want
    assert topk.search_embeddings(odd_vectors.limit(0)).collect() == []


def test_sparse_postings():
    rng = np.random.default_rng(0)
    rows, queries = (rng.integers(-3, 4, (n, 40)) * (rng.random((n, 40)) < 0.2) for n in (300, 70))
    assert (topk.accumulate(queries, rows) == queries @ rows.T).all()


def test_ann_small_and_recall(spark, odd_vectors):
    rows = [(r.vec_id, r.embedding) for r in odd_vectors.collect()]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search_embeddings(odd_vectors).collect())
    assert got == brute(rows, 20, 20, list, False)
    assert ann.search_embeddings(odd_vectors.limit(0)).collect() == []
    df = table(spark, SF_CHECK, "embeddings")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 20, 20, list, False)
    got = [(r.query_id, r.vec_id) for r in ann.search_embeddings(df, block=100).collect()]
    true = {(q, i) for q, _, i, _ in want}
    assert len(got) == len(want) and len(true & set(got)) >= 0.9 * len(true)


def test_ann_recall_beside_copies(spark):
    """Groups of near copies do not end the other queries' search early."""
    rng = np.random.default_rng(4)
    for groups, size in ((1, 400), (6, 150)):
        x = rng.standard_normal((3000, 64))
        x[:groups * size] = np.repeat(x[:groups], size, 0) + 0.02 * rng.standard_normal((groups * size, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ids = rng.permutation(3000)
        df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
        cos = np.where(np.eye(3000, dtype=bool), -2, x @ x.T)
        true = {(int(ids[q]), int(ids[i])) for q in np.flatnonzero(ids % 100 == 0)
                for i in np.argsort(-cos[q])[:20]}
        got = [(r.query_id, r.vec_id) for r in ann.search_embeddings(df, step=100).collect()]
        assert len(got) == len(set(got)) == len(true) and len(true & set(got)) >= 0.9 * len(true)


def test_ann_small_table_is_hashed(spark):
    """Small tables go through the probing too; a query holds its k nearest or every row."""
    rng = np.random.default_rng(6)
    for n, share in ((15, 1.0), (150, 0.9)):
        rows = [(i, rng.standard_normal(16).tolist()) for i in range(n)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        want = {(q, i) for q, _, i, _ in brute(rows, 20, 20, list, False)}
        got = {(r.query_id, r.vec_id) for r in ann.search_embeddings(df).collect()}
        assert len(got) == len(want) and len(want & got) >= share * len(want)
    few = {(r.query_id, r.vec_id) for r in ann.search_embeddings(df, target=0.0).collect()}
    assert len(few) == len(want) and few != want


def test_main_text():
    page = ('<body><header><h1>Site</h1></header><div class="sidebar">x<p>y</div><div id="content"><h2>T&eacute;st</h2>'
            '<p>Hello <b>bold</b>\n world<p>two<ul><li><a href="/">menu</a></li><li>item</li></ul></div>'
            '<div class="cookie-notice">c</div><form><p>f</p></form><section class="comments"><p>c1</p></section>'
            '<script>if (a<b) "</p>"</script><footer>f</footer>')
    assert htmltext.main_text(page) == "Tést\n\nHello bold world\n\ntwo\n\nitem"
    assert htmltext.main_text('<div class="ad">x<article><p>a<br>b &amp; c') == "a b & c"
    assert htmltext.main_text("") == "" and htmltext.main_text("plain <") == "plain <"


@pytest.mark.parametrize("page, text", [
    ('<div class="content no-sidebar"><p>real text</p>', "real text"), ('<div class="has-header"><p>a</p></div>', "a"),
    ('<div class="body"><p>the long text of the page</p></div><article class="teaser">Read more</article>',
     "the long text of the page"),
    ('<article><div class="search-results"><p>body</p></div></article>', "body"),
    ('<article><p>one</p><div class="social-science"><p>two</p></div></article>', "one\n\ntwo"),
    ('<article><p>long enough text</p></article><div class="comments"><article class="comment"><p>no, not this one at all'
     '</p></article></div>', "long enough text"),
    ('<main><p>text of it</p><div class="share-buttons">Tell</div><ul class="left-menu"><li>x</li></ul></main>', "text of it"),
    ("<p>" + "very long " * 50_000, ("very long " * 50_000).strip()), ("<div>" * 3000 + "deep", "deep"),
])
def test_slots_by_what_they_hold(page, text):
    assert htmltext.main_text(page) == text


def test_extract_template(spark):
    rows = [(i, f"http://h.org/{i}", f"<div><p>Welcome to our site</p><p>text {i} of {i}</p><p>same end</p></div>")
            for i in range(20)]
    rows += [(20, None, None), (None, "http://x.org", "<p>solo"), (20, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as template")
    got = {(r.page_id, r.text, r.n_chars) for r in htmltext.extract(pages).collect()}
    assert (3, "Welcome to our site\n\ntext 3 of 3\n\nsame end", 42) in got
    assert (20, "", 0) in got and (None, "solo", 4) in got
    assert htmltext.extract(pages).count() == 23
    assert htmltext.extract(pages.limit(0)).collect() == []


def test_a_host_of_any_size_keeps_its_articles(spark):
    """The number of a host's pages changes nothing; a shared sentence stays in the article."""
    rows = []
    for n in (1, 2, 7, 8, 30):
        rows += [(1000 * n + i, f"http://h{n}.org/{i}",
                  "<body><div class='x1'>Every page says this long sentence of the site, again and again and again.</div>"
                  f"<div class='x2'><p>Shared sentence of the site.</p><p>text number {i} which is the page's own {i * i}</p></div>"
                  f"<div class='x3'><a href='/'>a link {i}</a></div></body>") for i in range(n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for lists in (True, False):
        for r in htmltext.extract(pages, lists=lists).collect():
            i = r.page_id % 1000
            own = f"Shared sentence of the site.\n\ntext number {i} which is the page's own {i * i}"
            if r.page_id >= 7000:
                assert r.text == own, r
            assert own in r.text


def test_template_alone_finds_the_article(spark):
    """Without the lists of names most of the given pages have the same text; on the
    others a menu or advert without links is longer than the article."""
    pages = table(spark, SF_SMALL, "pages")
    both = [{r.page_id: r.text for r in htmltext.extract(pages, lists=x).collect()} for x in (True, False)]
    same = sum(both[0][p] == both[1][p] for p in both[0])
    assert same >= 0.85 * len(both[0]), (same, len(both[0]))


def test_classes_are_those_of_equal_vectors(spark):
    """Occurrence vectors by additive hashes against whole vectors, and nesting against its definition."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        tags = [f"<{t}>x</{t}>" * int(rng.integers(1, 3) if t == "p" else 1)
                for t in ("nav", "div", "p", "b", "i") if t in ("nav", "div", "p") or rng.random() < 0.95]
        rows.append((i, f"http://h{i % 3}.org/{i}", "".join(tags)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    own = pages.select("page_id", "url", "html", htmltext.F.xxhash64(htmltext.host_of(htmltext.F.col("url"))).alias("_host"),
                       htmltext.F.xxhash64("page_id", "url").alias("_page"))
    vectors = {}
    for r in own.collect():
        for t in htmltext.tokens(r.html):
            k = htmltext.token_key(*t)
            own_vector = vectors.setdefault((r["_host"], k), {})
            own_vector[r.page_id] = own_vector.get(r.page_id, 0) + 1
    want = {}
    for (h, k), v in vectors.items():
        if len(v) > 1:
            want.setdefault((h, tuple(sorted(v.items()))), set()).add(k)
    got = {}
    for r in htmltext.occurrences(own).collect():
        got.setdefault((r["_host"], r.n, r.s1, r.s2), set()).add(r.token)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    # nested: whole in a gap or around it; straddling: left out
    outer, inner, across = [(0.0, 1), (10.0, 2)], [(3.0, 3), (4.0, 4)], [(5.0, 5), (12.0, 6)]
    ranked = [(-9, -2, outer), (-9, -2, inner), (-8, -2, across)]
    assert htmltext.nested(ranked) == {1, 2, 3, 4}
    assert htmltext.nested([(-9, -2, outer), (-9, -1, [(11.0, 7)])]) == {1, 2, 7}


def test_quality_held_out(spark, edge_docs, empty_docs):
    docs, labels = table(spark, SF_CHECK, "documents"), table(spark, SF_CHECK, "labels")
    rows = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items())
    test = [(rows[x.doc_id].predicted, x.quality) for x in labels.collect() if rows[x.doc_id].held_out]
    assert sum(a == b for a, b in test) >= 0.93 * len(test)
    none = quality.classify(edge_docs, labels.limit(0))
    assert {r.score for r in none.collect()} == {0.5} and none.count() == edge_docs.count()
    assert quality.classify(empty_docs, labels).collect() == []
    assert set(quality.keep_good(edge_docs, labels).columns) == set(edge_docs.columns)


def test_pipeline_stages(spark):
    import corpus_pipeline
    from tests.llm.test_linededup import brute as removed_lines
    from tests.llm.test_simhash import brute as near
    from tests.llm.test_tokens import check_packing

    docs = table(spark, SF_SMALL, "documents")
    kept = corpus_pipeline.quality_filter(spark, docs, SF_SMALL)
    scores = {r.doc_id: r.predicted for r in quality.classify(docs, table(spark, SF_SMALL, "labels")).collect()}
    kept = kept.persist()
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, p in scores.items() if p}
    lines = corpus_pipeline.line_dedup(spark, kept, SF_SMALL).persist()
    gone, want = removed_lines([(r.doc_id, r.text) for r in kept.collect()]), {}
    for r in kept.collect():
        left = [x for k, x in enumerate(r.text.split("\n")) if not gone.get((r.doc_id, k))]
        if any(x.split() for x in left) or not r.text.split():
            want[r.doc_id] = "\n".join(left)
    assert {r.doc_id: r.text for r in lines.collect()} == want
    single = corpus_pipeline.near_dedup(spark, lines, SF_SMALL).persist()
    assert {r.doc_id for r in single.collect()} == {c for _, _, c in near(list(want.items()))}
    check_packing(corpus_pipeline.pack(spark, single, SF_SMALL).collect(), single.collect())
