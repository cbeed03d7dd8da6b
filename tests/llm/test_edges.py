"""Extra columns with clashing names, a brute-force quality score, long texts, leftovers."""

import os
import zlib

import public_tokenizers
import pytest
import xxhash

from regstat.llm import bpe, common, packing, quality, sharding
from regstat.llm.common import table
from tests.conftest import SF_SMALL

CLASH = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", "n_tokens", "ids_sha256", "shard", "slot",
         "size", "score", "predicted", "held_out", "_id", "_q", "_h", "_size", "_b", "_n", "rank"]


@pytest.mark.parametrize("name", ["packing", "bpe", "sharding", "quality"])
def test_clashing_columns_change_nothing(spark, edge_docs, name):
    labels = table(spark, SF_SMALL, "labels")
    run = {"packing": lambda d: packing.pack_documents(d, public_tokenizers.path("byte_bpe_50k.json"))
           .drop("sequence_id", "offset"),
           "bpe": lambda d: bpe.encode_documents(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                                 public_tokenizers.PATTERN),
           "sharding": sharding.shard_documents, "quality": lambda d: quality.classify(d, labels)}[name]
    docs = edge_docs.select("doc_id", "text")
    odd = docs.selectExpr("*", *[f"'x{i}' as {c}" for i, c in enumerate(CLASH)])
    want, got = (sorted((str(r) for r in run(d).collect())) for d in (docs, odd))
    assert got == want and len(got) >= docs.count()


def test_quality_brute_force(spark):
    """The scores of a classifier fitted without Spark on the same rows."""
    docs = [(r.doc_id, r.text) for r in table(spark, SF_SMALL, "documents").collect()]
    known = [(r.doc_id, r.quality) for r in table(spark, SF_SMALL, "labels").collect()
             if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    share = sum(q for _, q in known) / len(known)
    label = dict(known)
    distinct = {}
    for d, t in docs:
        if d in label and t:
            h = xxhash.xxh64_intdigest(t.encode(), 42)
            h -= (h >> 63) << 64
            distinct[label[d], h] = t
    texts = [[distinct[k] for k in sorted(distinct) if k[0] == q] for q in (1, 0)]
    model = quality.fit(*texts, share)
    got = {r.doc_id: r.score for r in quality.classify(table(spark, SF_SMALL, "documents"),
                                                       table(spark, SF_SMALL, "labels")).collect()}
    assert got == {d: pytest.approx(model.score(t), abs=1e-9) for d, t in docs}
    long = model.score("good text " * 200_000)
    assert 0.0 <= long <= 1.0


def test_whole_texts_are_chosen_by_size():
    rows = [{"_size": n} for n in (5, 40, 3, 9, 1)]
    assert [r["_size"] for r in quality.chosen(rows, 15)] == [5, 3, 1]


def test_old_leftovers_are_removed(spark, scratch_dir):
    old, new = (os.path.join(scratch_dir, common.WRITTEN, n) for n in ("a-1", "b-2"))
    for p in (old, new):
        os.makedirs(p)
    os.utime(old, (1, 1))
    assert common.expire(spark, scratch_dir) == 1
    assert os.path.exists(new) and not os.path.exists(old)
    assert common.expire(spark, os.path.join(scratch_dir, "none")) == 0
