"""Best-fit packing of tokenised documents into sequences.

1. Tokenise (one pass, no shuffle) and cut only documents longer than a
   sequence, into full pieces; the shorter remainder is the first piece.
2. Range-sort: the pieces of each length get gapless ranks (hash buckets
   sorted separately, bucket counts give the offsets). Lengths are integers
   up to the capacity, so the sorted list of all pieces, and that of all
   gaps, is a list of runs: (length, first rank, count).
3. Bulk-synchronous supersteps, longest pieces first: all pieces of the step
   look for their successor, the smallest gap that holds them. Pieces and
   gaps of the match are paired by rank, so each gap takes one piece and no
   two pieces want one gap; pieces without a gap go on to the next larger
   gap size, then open new sequences; taken gaps are updated and the next
   step begins. This is best fit in decreasing order.
   A superstep works on runs, of which there are as many as sizes and steps
   (bounded by the capacity, not by the documents).
4. Every piece finds its place by its length and rank in the runs.
"""

from __future__ import annotations

import bisect
import itertools
import json

import os
import re
import zlib
from array import array

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regstat.llm.common import gapless_rank, released, written
from regstat.llm.wordcache import WordCache, blocks, words_of

CAPACITY, END_ID = 1024, 2
_ENCODERS: dict[int, "Encoder"] = {}


def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes -> id of a tokenizers model, if it is plain byte-level BPE
    whose merges come in the order of the ids they make and whose added tokens
    stand for their own strings only; else None."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    if (pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space")
            or spec.get("normalizer") or model.get("type") != "BPE" or model.get("dropout")
            or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
            or any(t.get(f) for t in spec.get("added_tokens") or [] for f in ("single_word", "lstrip", "rstrip"))):
        return None
    # ByteLevel writes printable bytes as themselves, the others as 256, 257, ...
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab[a + b] for a, b in pairs]
    if made != sorted(made):
        return None
    special = {t["content"] for t in spec.get("added_tokens") or []}
    return {bytes([byte_of[c] for c in t]): i for t, i in vocab.items() if t not in special}


class Encoder:
    """Ids of whole texts as little-endian 32-bit numbers: those that
    tokenizers gives for the model file without adding any; the string of an
    added token gets its id. Plain byte-level BPE is encoded by ranks (the same ids,
    faster), each distinct word once; any other model by tokenizers."""

    def __init__(self, model: str):
        spec = json.loads(model)
        ranks = merge_ranks(spec)
        if ranks is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(model)
            self._ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        else:
            import tiktoken

            bpe = tiktoken.Encoding("model", pat_str=public_tokenizers.PATTERN,
                                    mergeable_ranks=ranks, special_tokens={})
            self._ids, self._piece = bpe.encode_ordinary, bpe._encode_single_piece
            self.marks = {c: array("I", self._ids(c)).tobytes() for c in ".,;:!?"}
        self.words = WordCache(self._word, 150_000) if ranks is not None else None
        self.added, self.splitter = {}, None    # tokenizers splits by itself
        if ranks is not None:
            self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in spec.get("added_tokens") or []}
        if self.added:                          # of several at a place the longest
            self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    def _word(self, text: str) -> bytes:
        """" " and a word: letters are one pre-token, a mark behind them another."""
        if text[1:].isalpha():
            return array("I", self._piece(text)).tobytes()
        if text[-1] in self.marks and text[1:-1].isalpha():
            return self.words[text[1:-1]] + self.marks[text[-1]]
        return self._encode(text)

    def _encode(self, text: str) -> bytes:
        return array("I", self._ids(text)).tobytes() if text else b""

    def encode(self, text: str) -> bytes:
        if self.splitter is None or self.splitter.search(text) is None:
            return self._plain(text)
        return b"".join(self.added[t] if i % 2 else self._plain(t) for i, t in enumerate(self.splitter.split(text)))

    def _plain(self, text: str) -> bytes:
        words = words_of(text) if text and self.words is not None else None
        if words is None:
            return self._encode(text)
        return self._encode(words[0]) + b"".join(
            map(self.words.__getitem__, itertools.islice(words, 1, None)))


def encoder_for(model: str) -> Encoder:
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def cut_pieces(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first may be shorter."""
    first = n_ids % capacity or min(n_ids, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n_ids, capacity)]


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
                     end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    with open(tokenizer_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encoder = encoder_for(model.value)
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b in blocks(batch.column("text")):
                texts = batch.column("text").slice(a, b - a).to_pylist()
                row, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(texts, a):
                    data = encoder.encode(text or "") + end
                    view = memoryview(data)
                    for k, (s, n) in enumerate(cut_pieces(len(data) // 4, capacity)):
                        row.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(view[4 * s:4 * (s + n)]))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        released(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Supersteps over runs: (length, first rank, count, first sequence, offset)
    for every run of equal pieces that goes into consecutive sequences."""
    gaps: dict[int, list[tuple[int, int]]] = {}   # gap -> runs (first sequence, count)
    sizes: list[int] = []                         # the gaps that exist, ascending
    opened, out = 0, []

    def add(gap: int, first: int, n: int) -> None:
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(sizes, gap)
        gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                per = capacity // length          # what fits behind the first goes in next steps
                n = -(-left // per)
                n = min(n, left)
                out.append((length, rank, n, opened, 0))
                if capacity > length:
                    add(capacity - length, opened, n)
                opened, rank, left = opened + n, rank + n, left - n
                continue
            gap = sizes[at]
            first, n = gaps[gap].pop()
            take = min(n, left)
            if take < n:
                gaps[gap].append((first + take, n - take))
            elif not gaps[gap]:
                del gaps[gap]
                sizes.pop(at)
            out.append((length, rank, take, first, capacity - gap))
            if gap > length:
                add(gap - length, first, take)
            rank, left = rank + take, left - take
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows (doc_id, piece, start, length,
    ids_crc32); offsets within a sequence are gapless from 0."""
    spark = pieces.sparkSession
    pieces = written(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in
              pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = best_fit_runs(counts, capacity)  # at most a few runs per size: bounded by the capacity
    plan = spark.createDataFrame(
        runs or [(0, 0, 0, 0, 0)], "_length long, _rank long, _count long, _sequence long, offset long")
    ranked = gapless_rank(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "_r",
                          sum(counts.values()))
    placed = ranked.join(
        F.broadcast(plan),
        (F.col("length") == F.col("_length")) & (F.col("_r") >= F.col("_rank"))
        & (F.col("_r") < F.col("_rank") + F.col("_count")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + F.col("_r") - F.col("_rank")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
                   end_id: int = END_ID) -> DataFrame:
    """Pack every document (its ids, then ``end_id``) into sequences of at
    most ``capacity`` ids: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    A null text counts as empty (only the end id); repeated rows are packed
    each; a null doc_id is kept; other columns are ignored; an empty table
    gives an empty result.
    """
    return pack(tokenised_pieces(docs, tokenizer_path, capacity, end_id), capacity)
