"""Queries of the subpackage: key -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from regstat.deploy import ship_package
from regstat.llm import (ann, bpe, convrepair, divergence, htmltext, licenses, linededup, packing, quality, sharding,
                         simhash, topk, url_filter)
from regstat.llm.common import table


def op1_exact_topk(spark, sf_dir):
    return topk.search_embeddings(table(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark, sf_dir):
    return linededup.matched_lines(table(spark, sf_dir, "documents"))


def op3_html_text(spark, sf_dir):
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op4_ann(spark, sf_dir):
    return ann.search_embeddings(table(spark, sf_dir, "embeddings"))


def op5_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("byte_bpe_50k.json"))


def op6_byte_bpe(spark, sf_dir):
    return bpe.encode_documents(table(spark, sf_dir, "documents"),
                                public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                public_tokenizers.PATTERN)


def op7_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_url_filters(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op9_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def op11_license_scan(spark, sf_dir):
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark, sf_dir):
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark, sf_dir):
    return convrepair.audit_conversations(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_exact_topk, op2_line_dedup, op3_html_text, op4_ann, op5_best_fit_packing, op6_byte_bpe, op7_sharding, op8_url_filters,
    op9_quality, op10_simhash, op11_license_scan, op12_source_divergence, op13_conversation_repair)}


def _shipped(fn):
    """The query with this package registered for the executors' Python."""
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    return run


def queries():
    return {name: _shipped(fn) for name, fn in QUERIES.items()}


def oracle_sql():
    from regstat.llm.oracle import ORACLES
    return dict(ORACLES)
