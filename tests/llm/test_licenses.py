"""License scan against plain loops and SQL."""

import math
import re
from collections import Counter

from regstat.llm import licenses as ls
from regstat.llm.catalog import queries
from regstat.llm.common import table
from regstat.llm.oracle import ORACLES
from tests.conftest import SF_CHECK, SF_SMALL
from tests.oracle_compare import compare, duck

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows):
    split = [(d, WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))) for d, t in rows]
    df = Counter(w for _, words in split for w in set(words))
    idf = {w: round((1 + math.log((len(rows) + 1) / (df[w] + 1))) * 1_000_000)
           for t in ls.TEMPLATES for w in t.text.split()}
    out = []
    for doc, words in split:
        base, labels, kinds, score = [], set(), set(), 0.0
        for t in ls.TEMPLATES:
            tpl, need = t.text.split(), ls.mandatory(t)
            for at in range(len(words)):
                same = [i for i, w in enumerate(tpl) if at + i < len(words) and words[at + i] == w]
                if not set(need) <= set(same):
                    continue
                got, whole = sum(idf[tpl[i]] for i in same), sum(idf[w] for w in tpl)
                if got * 10 >= whole * 8:
                    labels.add(t.label)
                    score = max(score, got / whole)
                    if t.base:
                        base.append(at)
                        kinds.add(t.label)
        out.append((doc, len(words), len(base), min(base, default=None), max(base, default=None),
                    ",".join(sorted(kinds)), ",".join(sorted(labels)), score))
    return sorted(out, key=str)


def found(df):
    names = "doc_id n_words n_base first_word last_word base_labels labels score".split()
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_query_on_given_table(spark):
    rows = [tuple(r) for r in table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()]
    got = found(queries()["op11_license_scan"](spark, SF_SMALL))
    assert got == brute(rows) and any(r[6] for r in got)


def test_oracle(spark):
    name = "op11_license_scan"
    ok, n, _, detail = compare(spark, duck(SF_CHECK), name, queries()[name], ORACLES[name], SF_CHECK)
    assert ok and n, detail


def test_edges(spark, edge_docs, empty_docs):
    mit = "Under\tthe--MIT  (License)"
    texts = [mit, f"{mit} x {mit}", "under the mit licensé", "under the MİT license", "cc by nc cc by nc-cc by nc",
             "ccby nc", "Apache License, Version 2.0", "apache license version 2x", "cc by", "by nc", "under the mit",
             "under the gnu general public license version 3", "as licensed under a gnu general public license version 3",
             "gnu general public license version 3", "general public license version 3 gnu", "This worK cc by nc",
             "redistribution and use in source and binary forms, with or without modification, are allowed",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of the software",
             "mit " * 5000 + mit, "\x00cc\x7fby{nc}\x00", "_the_mit_license_", None, "", "   ", "license " * 300]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, mit), (None, mit), (0, mit)]
    schema = "doc_id long, text string, word string, pos int, last string, label string, rid int"
    df = spark.createDataFrame([(*r, "clash", 1, "x", "y", 7) for r in rows], schema).repartition(3)
    assert found(ls.scan_documents(df)) == brute(rows)
    assert found(ls.scan_documents(edge_docs)) == brute([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert ls.scan_documents(empty_docs).collect() == []


def test_rare_words_are_the_anchors(spark):
    """Where "mit" is an everyday word, "license" leads to the phrase."""
    rows = [(i, "geh mit mir") for i in range(50)] + [(99, "under the mit license")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hits = ls.written(ls.licence_words(df), "t")
    weight = ls.word_weights(hits)
    assert weight["mit"] < weight["license"] == weight["under"]
    assert [tuple(r)[:3] for r in ls.places(hits).collect()] == [(hits.filter("doc_id = 99").first().rid, 0, 0)]


def test_no_python_on_the_path(spark):
    from regstat.llm.catalog import op11_license_scan

    plan = op11_license_scan(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "RDD" not in plan
