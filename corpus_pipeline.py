"""Corpus pipeline: quality filter, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers

from regstat.deploy import ship_package
from regstat.llm import linededup, packing, quality, simhash
from regstat.llm.common import WRITTEN, shared_dir, table


def quality_filter(spark, docs, sf_dir):
    """Documents whose quality score is below the threshold go."""
    ship_package(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark, docs, sf_dir):
    """Lines with an earlier match go, and documents that lose all their lines."""
    ship_package(spark)
    return linededup.drop_lines(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate component stays."""
    ship_package(spark)
    return simhash.keep_one(docs)


def pack(spark, docs, sf_dir):
    """Every kept document's pieces with their sequence and offset."""
    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("best_fit_packing", pack),
]

#: Compression, set similarity, fingerprints and tokenisers are not SQL; the
#: stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply all stages to ``documents``; the last one's rows.

    Null and empty texts are scored, stay if they reach the threshold, lose no
    lines and are packed as their end mark; repeated rows are documents each
    until near-dedup keeps one; an empty table gives an empty result; extra
    columns go along until packing, which returns its own."""
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{WRITTEN}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, out, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
    return STAGES[-1][1](spark, out, sf_dir)
