"""Byte-level BPE and packing against the public tokenizer libraries."""

import base64
import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from regstat.llm import bpe, packing
from regstat.llm.common import table
from tests.conftest import SF_SMALL

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expect_bpe(reference, doc_id, text):
    ids = reference.encode_ordinary(text or "")
    return (doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


def test_bpe_equals_tiktoken(spark, edge_docs, reference):
    for docs in (edge_docs, table(spark, SF_SMALL, "documents")):
        got = sorted(map(tuple, bpe.encode_documents(docs, RANKS, P.PATTERN).collect()), key=str)
        want = sorted((expect_bpe(reference, r.doc_id, r.text) for r in docs.collect()), key=str)
        assert got == want


def test_bpe_codec_odd_strings(reference):
    codec = bpe.codec_for(open(RANKS, "rb").read(), P.PATTERN)
    for text in ("", " ", "a", " leading", "trailing ", "x\n\ny  z", "<unk> <s> ▁ \x00\x01", "😀😀 é\u0301",
                 "don't WE'LL 12345 !!!???", "\u2028 \u3000 a b"):
        assert codec.encode(text) == reference.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()
        assert codec.digests(text)[0] == len(reference.encode_ordinary(text))


def test_bpe_empty_table(empty_docs):
    assert bpe.encode_documents(empty_docs, RANKS, P.PATTERN).collect() == []


def check_packing(rows, docs):
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    want = collections.Counter()
    for r in docs:
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        for k, (s, n) in enumerate(packing.cut_pieces(len(ids), 1024)):
            want[(r.doc_id, k, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()))] += 1
    got = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return by


def test_packing_whole_and_tight(spark, edge_docs):
    for docs in (edge_docs, table(spark, SF_SMALL, "documents")):
        rows = packing.pack_documents(docs, JSON).collect()
        by = check_packing(rows, docs.collect())
        total = sum(r.length for r in rows)
        assert len(by) <= max(-(-total // 1024) * 1.1 + 1, 2)


def test_packing_is_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(1, 101, 500).tolist()
        runs = packing.best_fit_runs(collections.Counter(sizes), 100)
        assert sum(n for _, _, n, _, _ in runs) == 500
        used = collections.defaultdict(int)
        for length, _, n, first, offset in sorted(runs, key=lambda r: r[4]):
            for s in range(first, first + n):
                assert used[s] == offset
                used[s] += length
        gaps = []
        for size in sorted(sizes, reverse=True):
            fits = [i for i, g in enumerate(gaps) if g >= size]
            if fits:
                i = min(fits, key=lambda i: gaps[i])
                gaps[i] -= size
            else:
                gaps.append(100 - size)
        assert max(used.values()) <= 100
        assert len(used) <= len(gaps) * 1.02 + 1


def test_packing_empty_table(empty_docs):
    assert packing.pack_documents(empty_docs, JSON).collect() == []


def test_added_tokens_as_tokenizers_does(spark):
    """The default call of tokenizers gives an added token's string its id."""
    t, encoder, end = Tokenizer.from_file(JSON), packing.encoder_for(open(JSON, encoding="utf-8").read()), "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f" {end}x", f"two  {end}  words, {end}\n\n{end} é", f"<|{end}|>", "<|endoftext", "a b"]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), JSON).collect()
    for r in rows:
        ids = np.array(t.encode(texts[r.doc_id], add_special_tokens=False).ids + [2], "<u4")
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
