"""License scan by a positional index of rare licence words.

Templates are licence sentences as word lists with a label; some of their
words form mandatory key phrases. Every licence word of a file is kept with
its position. The corpus gives each licence word its IDF (document counts over
all files); of a template's mandatory words the ``ANCHORS`` with the highest
IDF are its index postings (word -> template, position in it). A file's rare
words are looked up there, a posting at position t met at word p proposes that
the template starts at p - t, and only starts that all anchors agree on stay.
There the whole template is compared: all mandatory words must stand in their
places, and the words that do must carry ``LEAST_SHARE`` of the template's IDF.

The base phrases are templates whose words are all mandatory, so every place
of theirs holds their anchors and is found. One pass splits the texts into
words; everything after it works on the rows of licence words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regstat.llm.common import written
from regstat.llm.url_filter import LOWER, UPPER


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    required: str
    base: bool = False


def _phrase(label: str, text: str) -> Template:
    return Template(label, text, text, base=True)


# Base phrases with their labels, then sentences of well-known
# licences with their mandatory key phrases, lower case, words only.
TEMPLATES = (
    _phrase("mit", "under the mit license"),
    _phrase("apache-2", "apache license version 2"),
    _phrase("cc-by-nc", "cc by nc"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission is hereby granted free of charge"),
    Template("apache-2", "you may not use this file except in compliance with the license",
             "use this file except in compliance with the license"),
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl-3", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose",
             "permission to use copy modify and or distribute this software"),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             "free and unencumbered software"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license",
             "creative commons attribution 4 0 international"),
    Template("cc-by-nc", "creative commons attribution noncommercial", "creative commons attribution noncommercial"),
    Template("cc-by-sa", "creative commons attribution sharealike", "creative commons attribution sharealike"),
    Template("cc0", "cc0 1 0 universal", "cc0 1 0 universal"),
)
#: words of the text before A-Z are lower-cased (afterwards no A-Z is left)
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ANCHORS, LEAST_SHARE, UNIT = 2, (8, 10), 1_000_000


def _small(spark, rows: list[tuple], names: str) -> DataFrame:
    """A table of literals, broadcast: its size is that of the templates."""
    cells = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names.split(), r)]) for r in rows])
    return F.broadcast(spark.range(1).select(F.inline(cells)))


def mandatory(template: Template) -> list[int]:
    """Positions of the template's key phrase (its first place in the text)."""
    words, key = template.text.split(), template.required.split()
    at = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
    return list(range(at, at + len(key)))


def licence_words(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Rows (rid, doc_id, n_words, pos, word, last) of the licence words of
    every text and of each text's end (``last``; a row without a word for a
    text without words). ``rid`` tells repeated rows apart."""
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    words = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                        F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0)).alias("_w"))
    rows = (words.select("rid", "doc_id", F.size("_w").cast("long").alias("n_words"), "_w")
            .select("rid", "doc_id", "n_words", F.posexplode_outer("_w").alias("pos", "_word")))
    last = F.col("pos").isNull() | (F.col("pos") == F.col("n_words") - 1)
    # lower() also changes letters beyond ASCII: it selects, translate() decides
    exact = F.translate("_word", UPPER, LOWER)
    return (rows.filter(last | F.lower("_word").isin(vocabulary))
            .select("rid", "doc_id", "n_words", F.col("pos").cast("long").alias("pos"),
                    F.when(exact.isin(vocabulary), exact).alias("word"), last.alias("last")))


def word_weights(hits: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """IDF of every template word in millionths, 1 + ln((files + 1) / (files
    with it + 1)); as many numbers as the templates have words."""
    files = hits.filter("last").count()
    found = {r.word: r["count"] for r in hits.filter("word is not null").select("rid", "word").distinct()
             .groupBy("word").count().collect()}
    return {w: round((1 + math.log((files + 1) / (found.get(w, 0) + 1))) * UNIT)
            for t in templates for w in t.text.split()}


def places(hits: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(rid, template, start, share): every place where a template stands."""
    spark = hits.sparkSession
    weight = word_weights(hits, templates)
    postings, cells, needs = [], [], []
    for tid, t in enumerate(templates):
        words, need = t.text.split(), mandatory(t)
        rare = sorted(need, key=lambda i: (-weight[words[i]], i))[:ANCHORS]
        postings += [(words[i], tid, i, len(rare)) for i in rare]
        cells += [(tid, i, w, weight[w], int(i in need)) for i, w in enumerate(words)]
        needs.append((tid, sum(weight[w] for w in words), len(need)))
    index = _small(spark, postings, "word template at anchors")
    cells = _small(spark, cells, "template at word weight need")
    needs = _small(spark, needs, "template whole needed")
    starts = (hits.filter("word is not null").join(index, "word")
              .select("rid", "template", (F.col("pos") - F.col("at")).alias("start"), "anchors")
              .filter("start >= 0")
              .groupBy("rid", "template", "start", "anchors").count()
              .filter(F.col("count") == F.col("anchors")))
    asked = (starts.join(cells, "template")
             .select("rid", "template", "start", (F.col("start") + F.col("at")).alias("pos"), "word", "weight", "need"))
    met = (hits.filter("word is not null").select("rid", "pos", "word").join(asked, ["rid", "pos", "word"])
           .groupBy("rid", "template", "start").agg(F.sum("weight").alias("weight"), F.sum("need").alias("met")))
    least, of = LEAST_SHARE
    return (met.join(needs, "template")
            .filter((F.col("met") == F.col("needed")) & (F.col("weight") * of >= F.col("whole") * least))
            .select("rid", "template", "start", (F.col("weight") / F.col("whole")).alias("share")))


def scan_documents(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base
    (places of base phrases), first_word and last_word (smallest and largest
    start of them, else null), base_labels, labels (distinct, sorted,
    comma-joined; none: empty) and score (the largest share of a place, else 0).

    A null text is empty; a null doc_id stays null; repeated rows each get a
    row; several phrases at one place all count; other columns are ignored; an
    empty table gives no rows.
    """
    hits = written(licence_words(docs, templates), "licence-words")
    kinds = _small(docs.sparkSession, [(i, t.label, t.base) for i, t in enumerate(templates)], "template label base")
    at_base = F.when(F.col("base"), F.col("start"))
    found = (places(hits, templates).join(kinds, "template").groupBy(F.col("rid").alias("_rid")).agg(
        F.count(at_base).alias("n_base"), F.min(at_base).alias("first_word"), F.max(at_base).alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("_base"),
        F.collect_set("label").alias("_all"), F.max("share").alias("score")))
    return (hits.filter("last").join(found, F.col("rid") == F.col("_rid"), "left")
            .select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
                    "first_word", "last_word",
                    *[F.coalesce(F.array_join(F.array_sort(c), ","), F.lit("")).alias(n)
                      for c, n in (("_base", "base_labels"), ("_all", "labels"))],
                    F.coalesce("score", F.lit(0.0)).alias("score")))
