"""Byte-level BPE by a sentencepiece model built from a rank file.

The vocabulary (token bytes -> rank) becomes a sentencepiece BPE model
directly, nothing is trained: every token is a piece whose bytes are written
as characters (byte b is the character 256 + b) and whose score is the
negative rank, so sentencepiece merges the pair with the lowest rank first;
the normalisation is the identity. Pre-tokens are found by the pattern and
encoded one by one; ids are decoded by the inverse mapping of the pieces.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from regstat.llm.wordcache import WordCache, words_of

TO_CHARS = {b: 256 + b for b in range(256)}
_CODECS: dict[bytes, "Codec"] = {}


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> rank from the lines "base64 rank"."""
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def to_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(TO_CHARS)


def to_bytes(piece: str) -> bytes:
    return bytes(ord(c) - 256 for c in piece)


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while True:
        n, low = n >> 7, n & 127
        if not n:
            out.append(low)
            return bytes(out)
        out.append(low | 128)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model; piece i has rank i, the unknown
    piece comes last (it never occurs: every byte is a piece)."""
    normal, unknown, bpe = 1, 2, 2
    by_rank = sorted(ranks.items(), key=lambda kv: kv[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    out = []
    for token, rank in by_rank:
        piece = (_block(1, to_piece(token).encode("utf-8")) + _varint(2 << 3 | 5)
                 + struct.pack("<f", -float(rank)) + _number(3, normal))
        out.append(_block(1, piece))
    out.append(_block(1, _block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0)
                      + _number(3, unknown)))
    trainer = (_number(3, bpe) + _number(4, len(by_rank) + 1) + _number(40, len(by_rank))
               + b"".join(_number(f, -1) for f in (41, 42, 43)))
    normalizer = _block(1, b"identity") + b"".join(_number(f, 0) for f in (3, 4, 5))
    out += [_block(2, trainer), _block(3, normalizer)]
    return b"".join(out)


class Codec:
    """Encoder and decoder of one vocabulary, in one process."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(rank_file)
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.ranks))
        self.token_bytes = [to_bytes(self.model.id_to_piece(i)) for i in range(len(self.ranks))]
        self.words = WordCache(self._entry)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text: each match of the pattern separately; one
        that is itself a token is that token."""
        out: list[int] = []
        for token in self.pattern.findall(text):
            raw = token.encode("utf-8")
            rank = self.ranks.get(raw)
            if rank is not None:
                out.append(rank)
            else:
                out.extend(self.model.encode(to_piece(raw)))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.token_bytes[i] for i in ids])

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the decoded bytes."""
        words = words_of(text) if text else None
        if words is None:
            parts = [self._entry(text)] if text else []
        else:
            parts = [self._entry(words[0])]
            parts += map(self.words.__getitem__, itertools.islice(words, 1, None))
        ids = hashlib.sha256(",".join([p[1] for p in parts]).encode("ascii")).hexdigest()
        raw = hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest()
        return sum([p[0] for p in parts]), ids, raw

    def _entry(self, text: str) -> tuple[int, str, bytes]:
        ids = self.encode(text)
        return len(ids), ",".join(map(str, ids)), self.decode(ids)


def codec_for(rank_file: bytes, pattern: str) -> Codec:
    """The process's codec of a vocabulary (workers are reused by tasks)."""
    key = hashlib.sha256(rank_file + pattern.encode("utf-8")).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def encode_documents(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256 (of the
    decimal ids joined by commas), decoded_sha256 (of the decoded bytes).

    The vocabulary file (about 1 MB, a fixed size) is read on the driver and
    broadcast. One pass, no shuffle. A null text counts as empty (no ids);
    repeated rows and null ids are rows like any other; other columns are
    ignored; an empty table gives an empty result.
    """
    with open(rank_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        codec = codec_for(data.value, pattern)
        for batch in batches:
            texts = batch.column("text")
            n, ids, raw = [], [], []
            for t in texts:
                x, y, z = codec.digests(t.as_py() or "")
                n.append(x)
                ids.append(y)
                raw.append(z)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                 pa.array(raw, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
