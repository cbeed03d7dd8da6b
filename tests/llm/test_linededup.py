"""Line dedup against comparing every line with every earlier one."""

import sys
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from regstat.llm import linededup
from regstat.llm.common import table
from tests.conftest import SF_SMALL


def brute(rows):
    """{(doc_id, line_no): removed}; rows (doc_id, text)."""
    lines = []
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if line.split():
                lines.append(((linededup.LAST if d is None else d), k, frozenset(line.split()), d))
    lines.sort(key=lambda x: (x[0], x[1]))
    by_word, out, sets, first = {}, {}, [], {}
    for d, k, words, doc in lines:
        if words in first:
            i = first[words]
            out[(doc, k)] = out[sets[i][1]] or (d, k) > sets[i][2]
            continue
        near = {j for w in words for j in by_word.get(w, ())}
        removed = any(9 * len(words & sets[j][0]) >= 4 * (len(words) + len(sets[j][0])) for j in near)
        first[words] = len(sets)
        for w in words:
            by_word.setdefault(w, []).append(len(sets))
        sets.append((words, (doc, k), (d, k)))
        out[(doc, k)] = removed
    return out


def test_words_are_those_of_split(monkeypatch):
    """All white space of Unicode, nulls, empty texts, and texts cut between lines."""
    spaces = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    rng = np.random.default_rng(3)
    texts = ["".join(f"w{int(rng.integers(9))}é日{c}" for c in rng.permutation(spaces)) for _ in range(40)]
    texts += [None, "", "\n\n", "end", "x" * 500, "\u2003", "a\u200bb a\u200bb", "\U0001f600 z z", "long " * 400]
    want = {(i, k): frozenset(x.split()) for i, t in enumerate(texts)
            for k, x in enumerate((t or "").split("\n")) if x.split()}
    for size in (2_000_000, 300, 10):
        monkeypatch.setattr(linededup, "BLOCK", size)
        got = {}
        for a, b, off, before in linededup.pieces(pa.array(texts)):
            for i, k, n, c in zip(*linededup.line_sets(b, off)[:4]):
                assert (a + i, before + k) not in got
                got[a + i, before + k] = int(n), int(c)
        assert {p: len(w) for p, w in want.items()} == {p: n for p, (n, _) in got.items()}
        classes = {}
        for p, w in want.items():
            assert classes.setdefault(w, got[p][1]) == got[p][1]
        assert len(set(classes.values())) == len(classes)


def test_line_dedup_brute_force(spark, edge_docs):
    for docs in (edge_docs, table(spark, SF_SMALL, "documents")):
        rows = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
        got = {(r.doc_id, r.line_no): r.removed for r in linededup.matched_lines(docs).collect()}
        assert got == brute(rows)


def test_near_copies_and_hot_words(spark, monkeypatch):
    """Clusters of variants, and words whose classes are cut into blocks."""
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        base = vocab[(i % 4) * 12:(i % 4) * 12 + 14]
        line = list(base)
        for _ in range(int(rng.integers(0, 4))):
            line[int(rng.integers(len(line)))] = vocab[int(rng.integers(60))]
        rows.append((i, " ".join(line) + "\nx y " + vocab[i % 60]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    whole = linededup.matched_lines(docs).collect()
    assert {(r.doc_id, r.line_no): r.removed for r in whole} == want and any(want.values())
    asked, sizes = linededup._asked, []
    for hot, step in ((7, 10), (60, 100_000)):
        monkeypatch.setattr(linededup, "PAIRS", step)
        out = []
        for part in linededup_parts(docs):
            monkeypatch.setattr(linededup, "HOT", hot)
            out.append(asked(part))
        sizes.append(sum(map(len, out)))
        got = links_of(docs, np.concatenate(out))
        assert got == {r.class_id: (r.n_links, r.n_earlier, r.match_id) for r in whole if r.n_links}
    assert sizes[0] > sizes[1]


def prepared(docs):
    """(lines of distinct classes, word hashes by class, rarity) without Spark."""
    rows = docs.select("doc_id", "text").collect()
    texts = pa.array([r.text for r in rows])
    counts = np.zeros(linededup.BUCKETS, np.int64)
    for _, b, off, _ in linededup.pieces(texts):
        counts += np.bincount((linededup.words_in(b, off)[1] >> np.uint64(47)).astype(np.int64), minlength=linededup.BUCKETS)
    rare, lines, words = linededup.rarities(counts), [], {}
    for a, b, off, before in linededup.pieces(texts):
        row, line, n, cls, numbers = linededup.line_sets(b, off, rare)
        lines.append((np.array([rows[i + a].doc_id for i in row]), line + before, n, cls, numbers))
    for r in rows:
        for x in r.text.split("\n"):
            (_, b, off, _), = linededup.pieces(pa.array([x]))
            words[int(linededup.line_sets(b, off)[3][0])] = np.unique(linededup.words_in(b, off)[1]).tobytes()
    return [np.concatenate(c) for c in zip(*lines)], words, rare


def linededup_parts(docs):
    (doc, line, n, cls, numbers), _, _ = prepared(docs)
    order = np.lexsort((line, doc, cls))
    one = np.zeros(len(cls), bool)
    one[order[np.r_[True, cls[order][1:] != cls[order][:-1]]]] = True
    _, data = linededup._by_part(linededup._postings(cls[one], doc[one], line[one], n[one], numbers[np.repeat(one, n)]), 3)
    return [linededup._ordered(np.frombuffer(d, linededup.PACKED)) for d in data]


def links_of(docs, asked):
    """Links summed over three groups of words, as the tasks do."""
    _, words, rare = prepared(docs)
    out = {}
    for k in range(3):
        own = {}
        for r in asked[(asked["g"] + asked["pair"]) % 3 == k]:
            own.setdefault(int(r["cls"]), (int(r["doc"]), int(r["line"]), []))[2].append(
                {c: int(r[c]) for c in ("g", "pair", "side")})
        table = pa.table({"cls": pa.array(list(own)), "doc": pa.array([v[0] for v in own.values()]),
                          "line": pa.array([v[1] for v in own.values()]), "at": pa.array([v[2] for v in own.values()]),
                          "words": pa.array([words[c] for c in own], pa.binary())})
        for r in linededup.count_links(table, rare).to_pylist():
            n, e, near = out.get(r["y"], (0, 0, (1 << 50, None)))
            mine = (1 << 50, None) if r["near_x"] is None else (r["near_d"], r["near_x"])
            out[r["y"]] = n + r["n_links"], e + r["n_earlier"], min(near, mine)
    return {y: (n, e, near[1]) for y, (n, e, near) in out.items()}


def test_a_hot_word_takes_bounded_time():
    """One word, the rarest of its lines, under 50,000 classes: no class meets all others in a task."""
    (_, b, off, _), = linededup.pieces(pa.array(["hot"]))
    rare = np.full(linededup.BUCKETS, 1 << 53, np.uint64)
    rare[int(linededup.words_in(b, off)[1][0] >> np.uint64(47))] = 0
    text, found = "\n".join(f"hot a{i} b{i}" for i in range(50_000)), []
    for _, b, off, before in linededup.pieces(pa.array([text])):
        _, ln, k, c, num = linededup.line_sets(b, off, rare)
        found.append((c, np.zeros(len(ln), np.int64), ln + before, k, num))
    rows = linededup._postings(*(np.concatenate(c) for c in zip(*found)))
    begun = time.time()
    out = linededup._asked(linededup._ordered(rows))
    assert time.time() - begun < 20
    m = -(-50_000 // linededup.HOT)
    assert len(np.unique(out["cls"])) == 50_000 and len(out) == 50_000 * m
    sizes = np.unique(out["pair"], return_counts=True)[1]
    assert len(sizes) == m * (m + 1) // 2 and sizes.max() < 2.3 * linededup.HOT


def test_every_link_is_counted(spark):
    """Families of near copies: all pairs of classes that match, not one per class."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(150):
        line = [f"w{i % 3}_{j}" for j in range(14)]
        for _ in range(int(rng.integers(0, 3))):
            line[int(rng.integers(14))] = f"v{int(rng.integers(20))}"
        rows.append((i, " ".join(line) + f"\nalone {i}"))
    first = {}
    for i, t in rows:
        for k, x in enumerate(t.split("\n")):
            first.setdefault(frozenset(x.split()), (i, k))
    links = {s: {o for o in first if o != s and 5 * len(s & o) >= 4 * len(s | o)} for s in first}
    assert max(map(len, links.values())) > 8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = {(r.doc_id, k): frozenset(x.split()) for r in docs.collect() for k, x in enumerate(r.text.split("\n"))}
    got = linededup.matched_lines(docs.repartition(3)).collect()
    cls = {text[r.doc_id, r.line_no]: r.class_id for r in got}
    for r in got:
        s = text[r.doc_id, r.line_no]
        earlier = {o for o in links[s] if first[o] < first[s]}
        assert (r.n_links, r.n_earlier) == (len(links[s]), len(earlier))
        assert r.match_id in {cls[o] for o in earlier} if earlier else r.match_id is None
        assert r.removed == (bool(earlier) or (r.doc_id, r.line_no) > first[s])
    assert sum({r.class_id: r.n_earlier for r in got}.values()) == sum(map(len, links.values())) // 2


def test_long_lines_go_to_a_part_once(spark, monkeypatch):
    """Near copies of a long line share many rare words; their words are not shipped for each."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.permutation(6000)]
    rows = [(i, " ".join(base + [f"own{i}"])) for i in range(3)] + [(9, "short line here")]
    seen, count = [], linededup.count_links

    def counted(t, rarity):
        seen.append((t.num_rows, pc.sum(pc.list_value_length(t["at"])).as_py()))
        return count(t, rarity)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_links, r.n_earlier, r.removed) for r in linededup.matched_lines(docs).collect()}
    assert got == {0: (2, 0, False), 1: (2, 1, True), 2: (2, 2, True), 9: (0, 0, False)}
    counts, words = linededup.word_counts(docs)
    asked = linededup.asked_classes(docs, counts, words).toArrow()
    own = {}
    for r in asked.to_pylist():
        own.setdefault(r["cls"], (r["doc"], r["line"], []))[2].append({c: r[c] for c in ("g", "pair", "side")})
    text = {}
    for _, x in rows[:3]:
        (_, b, off, _), = linededup.pieces(pa.array([x]))
        text[int(linededup.line_sets(b, off)[3][0])] = np.unique(linededup.words_in(b, off)[1]).tobytes()
    table = pa.table({"cls": pa.array(list(own)), "doc": pa.array([v[0] for v in own.values()]),
                      "line": pa.array([v[1] for v in own.values()]), "at": pa.array([v[2] for v in own.values()]),
                      "words": pa.array([text[c] for c in own], pa.binary())})
    out = counted(table, linededup.rarities(counts))
    assert seen[0][0] == 3 and seen[0][1] > 1500 and sorted(out["n_links"].to_pylist()) == [2, 2, 2]


def test_rows_do_not_grow_with_the_pairs(spark, monkeypatch):
    """A family of near copies: what leaves a task is per class and word."""
    seen, kept = {}, linededup.written

    def counted(df, name):
        out = kept(df, name)
        seen[name] = out.count()
        return out
    monkeypatch.setattr(linededup, "written", counted)
    sizes = []
    for family in (100, 400):
        rows = [(i, " ".join([f"w{j}" for j in range(30)] + [f"own{i}"])) for i in range(family)]
        got = linededup.matched_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.n_links for r in got} == {family - 1} and sum(not r.removed for r in got) == 1
        sizes.append(dict(seen))
    assert all(sizes[1][k] <= 4 * sizes[0][k] for k in ("asked", "places", "links"))


def test_line_records_do_not_go_to_the_parts(spark, monkeypatch):
    """A line that stands in every document is a record per line of the
    table, and at most one posting per batch for the part of its words."""
    docs = spark.createDataFrame([(i, "the same words in every one\n" * 40 + f"own {i}") for i in range(50)],
                                 "doc_id long, text string").coalesce(1)
    sent, kept = [], linededup.written

    def seen(df, name):
        out = kept(df, name)
        sent.append((name, out.count(), out.columns))
        return out

    monkeypatch.setattr(linededup, "written", seen)
    assert linededup.matched_lines(docs).filter("removed").count() == 50 * 40 - 1
    tables = {name: (n, columns) for name, n, columns in sent}
    assert tables["lines"][0] == 50 * 41 and tables["asked"][0] < 50


def test_drop_lines(spark, edge_docs, empty_docs):
    assert linededup.matched_lines(empty_docs).collect() == []
    assert linededup.drop_lines(empty_docs).collect() == []
    docs = spark.createDataFrame(
        [(1, "a b c d e f\nkeep me\n\n", 20, "x"), (2, "f e d c b a\nnew line here", 30, "y"),
         (3, "a b c d e f", 11, "z"), (4, "", 0, "z"), (None, "keep me\nelse", 12, "z"), (5, None, None, None)],
        "doc_id long, text string, n_chars long, cls string")
    got = {r.doc_id: (r.text, r.n_chars, r.cls) for r in linededup.drop_lines(docs).collect()}
    assert got == {1: ("a b c d e f\nkeep me\n\n", 20, "x"), 2: ("new line here", 13, "y"), 4: ("", 0, "z"),
                   None: ("else", 4, "z"), 5: (None, None, None)}
