"""Line dedup by an exact set-similarity join.

A line is the set of its words. Two lines match if the Jaccard similarity of
their sets is at least ``NUM / DEN`` (0.8); a line with an earlier match (by
document id, then line number) is removed. Lines of equal sets are one class.

1. Rarity: word counts over all documents, in a fixed number of hash buckets
   (any total order of the words is exact; this one puts rare words first).
2. Prefix filter: a class posts only its n - ceil(0.8 n) + 1 rarest words;
   matching lines share one of them. Postings are packed into parts of
   bounded size by word.
3. In a part, the classes under a word are compared pair by pair with the
   length filter, the positional filter and two parity bitmaps of 128 and 64
   bits (every differing bit is a differing word, so they reject safely). No
   pair leaves the task: what does is each class that has a candidate, once
   per word. A word with more than ``HOT`` classes is not compared there; its
   classes go to all pairs of their blocks of that size.
4. The words of these classes are gathered in one pass and meet again by word
   (or pair of blocks). There each pair is verified on the words' 64-bit
   hashes, under the first word that both prefixes share and nowhere else, and
   only sums leave the task: per class its links, those to earlier lines, and
   the nearest of these. Rows grow with classes and words, not with pairs.
5. Line records go straight from the documents to a table; a class's first
   place is a minimum with partial sums, and a line looks it up in a join
   that can be split. Every line is removed that is a later line of its class
   or whose class has an earlier match.

Words and classes are told apart by hashes: words by 53 bits in the order and
64 in verification, classes by the sum of their words' 64-bit mixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regstat.llm.common import give_back, released, written
from regstat.llm.wordcache import blocks

NUM, DEN = 4, 5
BUCKETS = 1 << 17          # of the word counts
SLICE = 1 << 13            # of them summed together
BLOOM_WORDS = 1 << 14, 1 << 22  # least and most 64-bit words of the filter of wanted lines (32 MB)
PART_POSTINGS = 150_000    # postings of a part, about
HOT = 16_384               # classes of a word compared in one group
PAIRS = 100_000            # pairs verified at once
LAST = (1 << 63) - 1       # place of a null doc_id in the order


BLOCK = 250_000            # bytes of text whose words are taken apart at once
HELD = 2_500_000           # bytes of text whose postings are sent together
WORD = 64                  # bytes of a word hashed in steps of eight; longer ones by XXH64
MASK = np.uint64((1 << 53) - 1)

#: White space as str.split() knows it: single bytes, and UTF-8 sequences by lead byte.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
WIDE_SPACE = {0xC2: [0x85, 0xA0], 0xE1: [0x9A80], 0xE3: [0x8080],
              0xE2: [*range(0x8080, 0x808B), 0x80A8, 0x80A9, 0x80AF, 0x819F]}
#: The lowest 0 to 8 bytes of a 64-bit number.
LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = h ^ h >> np.uint64(33)
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


def _wide(b: np.ndarray) -> np.ndarray:
    """Places of the bytes of white space beyond ASCII."""
    out = []
    for lead, tails in WIDE_SPACE.items():
        at = np.flatnonzero(b == lead)
        if lead == 0xC2:
            at = at[np.isin(b[at + 1], tails)]
            out += [at, at + 1]
        elif len(at):
            at = at[np.isin(b[at + 1].astype(np.int64) << 8 | b[at + 2], tails)]
            out += [at, at + 1, at + 2]
    return np.concatenate(out)


def words_in(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of the UTF-8 bytes ``b``; words end
    at white space and at the texts' ends ``off``."""
    gap = SPACE[b]
    wide = _wide(b)
    gap[wide] = True
    start = ~gap
    begins = np.zeros(len(b) + 1, bool)
    begins[off] = True
    start[1:] &= gap[:-1] | begins[1:-1]
    s = np.flatnonzero(start)
    end = ~gap
    end[:-1] &= gap[1:] | begins[1:-1]
    size = np.flatnonzero(end) + 1 - s
    eight = np.ndarray(len(b) + 1, "<u8", np.concatenate([b, np.zeros(8, np.uint8)]), 0, (1,))
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = slice(None)                   # words that have bytes from ``k`` on
    for k in range(0, WORD, 8):
        x = (h[at] ^ (eight[s[at] + k] & LOW[np.minimum(size[at] - k, 8)])) * np.uint64(0xC2B2AE3D27D4EB4F)
        h[at] = x ^ x >> np.uint64(29)
        at = np.flatnonzero(size > k + 8)
        if not len(at):
            break
    for i in np.flatnonzero(size > WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(b[s[i]:s[i] + size[i]])
    return s, _mix(h)


def pieces(texts: pa.Array):
    """(first row, bytes, ends of the rows' texts, lines before) of an Arrow
    string column in pieces of about BLOCK bytes; a longer text is cut between
    its lines. A null counts as empty."""
    for a, z in blocks(texts, BLOCK):
        part = pc.fill_null(texts.slice(a, z - a).cast(pa.large_string()), "")
        _, ends, data = part.buffers()
        off = np.frombuffer(ends, np.int64)[part.offset:part.offset + len(part) + 1]
        if off[-1] == off[0]:
            continue
        b = np.frombuffer(data, np.uint8)[off[0]:off[-1]]
        off = off - off[0]
        if z - a > 1 or len(b) <= BLOCK:
            yield a, b, off, 0
            continue
        ends, at, lines = np.flatnonzero(b == 10) + 1, 0, 0
        while at < len(b):
            k = max(lines, int(np.searchsorted(ends, at + BLOCK, "right")) - 1)
            to = int(ends[k]) if k < len(ends) and len(b) - at > BLOCK else len(b)
            yield a, b[at:to], np.array([0, to - at]), lines
            at, lines = to, k + 1


def line_sets(b: np.ndarray, off: np.ndarray, rarity: np.ndarray | None = None):
    """The lines that have words: text (row), line number in it, number of
    distinct words, class, and all lines' word numbers, sorted within a line.
    A number's order is rarity (if given), then 53 hash bits."""
    s, h = words_in(b, off)
    number = h & MASK
    if rarity is not None:
        number |= rarity[(h >> np.uint64(47)).astype(np.int64)]
    feeds = np.flatnonzero(b == 10)
    row, before = np.searchsorted(off, s, "right") - 1, np.searchsorted(feeds, s)
    new = np.ones(len(s), bool)
    new[1:] = (row[1:] != row[:-1]) | (before[1:] != before[:-1])
    row, before = row[new], before[new]
    known, at = np.unique(number, return_inverse=True)
    bits = len(known).bit_length()
    key = (np.cumsum(new) - 1) << bits | at
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    numbers = known[key & ((1 << bits) - 1)]
    n = np.bincount(key >> bits, minlength=len(row))
    cls = np.add.reduceat(_mix(numbers & MASK), np.cumsum(n) - n) if len(n) else numbers
    return row, before - np.searchsorted(feeds, off[row]), n, cls.view(np.int64), numbers.view(np.int64)


def rarities(counts: np.ndarray) -> np.ndarray:
    """Per hash bucket the upper bits of its words' numbers."""
    return (np.log2(counts + 1.0) * 16).astype(np.uint64) << np.uint64(53)


def word_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Words per hash bucket over all documents (a fixed number of rows for
    the driver) and words in all."""
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, b, off, _ in pieces(batch.column("text")):
                total += np.bincount((words_in(b, off)[1] >> np.uint64(47)).astype(np.int64), minlength=BUCKETS)
        yield packed(total.reshape(-1, SLICE), range(BUCKETS // SLICE))

    def packed(counts, slices):
        return pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary())],
                                          ["slice", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_buffer(), np.int64) for c in t.column("counts"))
        return pa.Table.from_batches([packed([total], [t.column("slice")[0].as_py()])])

    kind = "slice int, counts binary"   # a task's counts are a few rows, summed slice by slice
    out = np.zeros(BUCKETS, np.int64)
    for r in docs.select("text").mapInArrow(released(run), kind).groupBy("slice").applyInArrow(add, kind).collect():
        out[r["slice"] * SLICE:(r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.int64)
    return out, int(out.sum())


PACKED = np.dtype([("g", "<i8"), ("cls", "<i8"), ("doc", "<i8"), ("b0", "<u8"), ("b1", "<u8"), ("b2", "<u8"),
                   ("line", "<i4"), ("n", "<i4"), ("pos", "<i4")])


def bitmaps(flat: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity bitmaps of 64, 64 and 64 bits of word sets given as runs of ``flat``."""
    one = np.uint64(1) << (flat & 63).astype(np.uint64)
    second = (flat & 64).astype(bool)
    return (np.bitwise_xor.reduceat(np.where(second, np.uint64(0), one), start),
            np.bitwise_xor.reduceat(np.where(second, one, np.uint64(0)), start),
            np.bitwise_xor.reduceat(np.uint64(1) << (flat >> 7 & 63).astype(np.uint64), start))


def _part_of(g: np.ndarray, parts: int) -> np.ndarray:
    h = np.ascontiguousarray(g).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
    return (h % np.uint64(parts)).astype(np.int64)


def _postings(cls: np.ndarray, doc: np.ndarray, line: np.ndarray, n: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Packed postings of lines of distinct classes (``flat``: their word numbers)."""
    start = np.cumsum(n) - n
    b0, b1, b2 = bitmaps(flat, start)
    prefix = n - -(-NUM * n // DEN) + 1
    row = np.repeat(np.arange(len(n)), prefix)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
    out = np.empty(len(row), PACKED)
    out["g"], out["cls"], out["doc"], out["line"] = flat[start[row] + pos], cls[row], doc[row], line[row]
    out["n"], out["pos"] = n[row], pos
    out["b0"], out["b1"], out["b2"] = b0[row], b1[row], b2[row]
    return out


def _by_part(rows: np.ndarray, parts: int) -> tuple[np.ndarray, list[bytes]]:
    """The parts that have rows, and their rows."""
    part = _part_of(rows["g"], parts)
    rows = rows[np.argsort(part, kind="stable")]
    known, size = np.unique(part, return_counts=True)
    edges = np.concatenate([[0], np.cumsum(size)])
    return known, [rows[edges[i]:edges[i + 1]].tobytes() for i in range(len(known))]


def _order(g: np.ndarray, cls: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The rows by word, place and class; of a class's copies under a word
    only the earliest."""
    words, of_word = np.unique(g, return_inverse=True)
    docs, of_doc = np.unique(doc, return_inverse=True)
    classes, of_class = np.unique(cls, return_inverse=True)
    line_bits, class_bits = int(line.max(initial=0)).bit_length(), len(classes).bit_length()
    place = of_doc << line_bits | line
    if len(words) * (len(docs) << line_bits) < 1 << 62:
        key = of_word * (len(docs) << line_bits) + place
        at = np.argsort(key)
        same = key[at][1:] == key[at][:-1]
        if same.any():                 # several rows at a place: by class
            at = np.lexsort((of_class, key))
    else:
        at = np.lexsort((of_class, place, of_word))
    key = (of_word << class_bits | of_class)[at]
    again = np.argsort(key, kind="stable")
    first = np.ones(len(at), bool)
    first[again[1:]] = key[again][1:] != key[again][:-1]
    return at[first]


def _ordered(rows: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of the distinct rows of a part, by word and size of the set."""
    rows = rows[_order(*(np.ascontiguousarray(rows[c]) for c in ("g", "cls", "doc", "line")))]
    rows = rows[np.lexsort((rows["n"], rows["g"]))]
    return {c: np.ascontiguousarray(rows[c]) for c in PACKED.names}


def _shifts(col: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The candidates among rows ordered by word and size, as two arrays of row
    numbers. Row by row the partners stand behind it until one is too large
    (or of another word), so a step only goes on with the rows that have one.
    With ``side`` (blocks 0 and 1, or 2 for both) only pairs of different
    blocks."""
    g, b0, b1, b2 = (col[c] for c in ("g", "b0", "b1", "b2"))
    side = col.get("side")
    n = col["n"].astype(np.int64)
    left = n - col["pos"]              # words from the shared one on
    size = len(g)
    x, shift = np.arange(size - 1), 1
    while len(x):
        x = x[x + shift < size]
        x = x[(g[x] == g[x + shift]) & (NUM * n[x + shift] <= DEN * n[x])]
        y = x + shift
        both = n[x] + n[y]
        need = -(-NUM * both // (NUM + DEN))
        ok = np.minimum(left[x], left[y]) >= need
        if side is not None:
            ok &= (side[x] == 2) | (side[x] != side[y])
        at = np.flatnonzero(ok)
        xs, ys, differ = x[at], y[at], (both - 2 * need)[at]
        fine = np.bitwise_count(b0[xs] ^ b0[ys]).astype(np.int32) + np.bitwise_count(b1[xs] ^ b1[ys]) <= differ
        xs, ys, differ = xs[fine], ys[fine], differ[fine]
        fine = np.bitwise_count(b2[xs] ^ b2[ys]) <= differ
        yield ys[fine], xs[fine]
        shift += 1


def line_records(docs: DataFrame) -> DataFrame:
    """Every line that has words: y (class), doc, line, n, no_id; written."""
    def run(batches):
        for batch in batches:
            doc_ids = batch.column("doc_id")
            nulls = doc_ids.is_null().to_numpy(zero_copy_only=False)
            doc_ids = pc.fill_null(doc_ids.cast(pa.int64()), LAST).to_numpy()
            for a, b, off, before in pieces(batch.column("text")):
                row, line, n, cls, _ = line_sets(b, off)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls), pa.array(doc_ids[row + a]), pa.array((line + before).astype(np.int64)),
                     pa.array(n.astype(np.int32)), pa.array(nulls[row + a])], ["y", "doc", "line", "n", "no_id"])

    return written(docs.mapInArrow(released(run), "y long, doc long, line long, n int, no_id boolean"), "lines")


ASKED = np.dtype([("cls", "<i8"), ("doc", "<i8"), ("line", "<i8"), ("g", "<i8"), ("pair", "<i8"), ("side", "<i8")])


def _asked(col: dict[str, np.ndarray]) -> np.ndarray:
    """Of a part's rows in order, the classes with a candidate, per word; all
    classes of a hot word, per pair of blocks that holds theirs."""
    g, cls = col["g"], col["cls"]
    size = np.diff(np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])) if len(g) else np.zeros(0, np.int64)
    size = np.repeat(size, size)
    few = np.flatnonzero(size <= HOT)
    cool = {c: v[few] for c, v in col.items()}
    paired = np.zeros(len(few), bool)
    for y, x in _shifts(cool):
        paired[y] = paired[x] = True
    at, pair, side = [few[paired]], [np.full(paired.sum(), -1)], [np.full(paired.sum(), 2)]
    hot = np.flatnonzero(size > HOT)
    if len(hot):
        m = -(-size[hot] // HOT)
        row = np.repeat(hot, m)
        other = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
        many = np.repeat(m, m)
        own = (np.ascontiguousarray(cls[row]).view(np.uint64) % many.astype(np.uint64)).astype(np.int64)
        at.append(row)
        pair.append(np.minimum(own, other) * many + np.maximum(own, other))
        side.append(np.where(own == other, 2, own > other))
    at = np.concatenate(at)
    out = np.empty(len(at), ASKED)
    for c in ("cls", "doc", "line", "g"):
        out[c] = col[c][at]
    out["pair"], out["side"] = np.concatenate(pair), np.concatenate(side)
    return out


def asked_classes(docs: DataFrame, counts: np.ndarray, words: int) -> DataFrame:
    """cls, doc, line (a class and its first place), g, pair, side (a word, or
    a pair of blocks of it, under which it is to be compared); written."""
    parts = max(1, words // 4 // PART_POSTINGS + 1)
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def post(batches):
        rare = rarities(shared.value)
        held, size = [], 0
        for batch in batches:
            doc_ids = pc.fill_null(batch.column("doc_id").cast(pa.int64()), LAST).to_numpy()
            for a, b, off, before in pieces(batch.column("text")):
                row, line, n, cls, numbers = line_sets(b, off, rare)
                if len(row):
                    held.append((doc_ids[row + a], line + before, n, cls, numbers))
                    size += len(b)
                if size >= HELD:
                    yield send(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            yield send(*map(np.concatenate, zip(*held)))

    def send(doc, line, n, cls, numbers):
        order = np.lexsort((line, doc, cls))    # the earliest line of every class
        first = np.concatenate([[True], cls[order][1:] != cls[order][:-1]])
        chosen = np.zeros(len(cls), bool)
        chosen[order[first]] = True
        part, data = _by_part(_postings(cls[chosen], doc[chosen], line[chosen], n[chosen],
                                        numbers[np.repeat(chosen, n)]), parts)
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(data, pa.binary())],
                                          ["part", "data"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.concatenate([np.frombuffer(d.as_buffer(), PACKED) for b in batches for d in b.column("data")])
        col = _ordered(data)
        del data
        out = _asked(col)
        del col
        give_back()
        for a in range(0, len(out), PART_POSTINGS):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(out[c][a:a + PART_POSTINGS])) for c in ASKED.names], list(ASKED.names))

    return written(docs.mapInArrow(released(post), "part int, data binary").groupBy("part").applyInArrow(
        compare, ", ".join(f"{c} long" for c in ASKED.names)), "asked")


def _place(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A hash of a line's place, for the filter of wanted lines."""
    h = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(20)


def _filter(places: DataFrame) -> np.ndarray:
    """A filter with a bit for every place (doc, line): about 32 bits for each,
    as far as its greatest size allows."""
    least, most = BLOOM_WORDS
    size = min(most, max(least, 1 << (places.count() // 2).bit_length()))

    def fill(batches):
        bits = np.zeros(size, np.uint64)
        for batch in batches:
            h = _place(batch.column("doc").to_numpy(), batch.column("line").to_numpy()) % np.uint64(64 * size)
            np.bitwise_or.at(bits, (h >> np.uint64(6)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], ["w", "bits"])

    out = np.zeros(size, np.uint64)
    rows = places.mapInArrow(fill, "w long, bits long").groupBy("w").agg(F.expr("bit_or(bits)").alias("bits"))
    for part in rows.toArrow().to_batches():       # at most ``size`` rows of 16 bytes
        out[part.column("w").to_numpy()] = part.column("bits").to_numpy().view(np.uint64)
    return out


def words_of_classes(docs: DataFrame, places: DataFrame) -> DataFrame:
    """cls, words (the sorted 64-bit hashes of its words, packed) of the lines
    at ``places`` (doc, line): a broadcast filter with a bit per place picks
    the lines; what it lets through besides is looked up by its class."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(places))

    def run(batches):
        bits = shared.value
        size = np.uint64(64 * len(bits))
        for batch in batches:
            said = []
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                lines = (t.as_py() or "").split("\n")
                h = _place(np.array([LAST if d is None else d], np.int64), np.arange(len(lines))) % size
                hit = bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)
                said += [lines[k] for k in np.flatnonzero(hit).tolist()]
            for _, b, off, _ in pieces(pa.array(said, pa.string())):
                cls = line_sets(b, off)[3]          # lines with words, in order
                start, h = words_in(b, off)
                row = np.searchsorted(off, start, "right") - 1
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
                row, h = row[new], h[new]
                edges = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True]) if len(row) else [0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls), pa.array([h[i:j].tobytes() for i, j in zip(edges, edges[1:])], pa.binary())],
                    ["cls", "words"])

    return docs.mapInArrow(released(run), "cls long, words binary").dropDuplicates(["cls"])


class Sets:
    """Sets of values (``row``: the set of each), sorted within one array, for
    look-ups of many at once."""

    def __init__(self, row: np.ndarray, values: np.ndarray, sets: int):
        self.known, flat = np.unique(values, return_inverse=True)
        self.bits = len(self.known).bit_length()
        key = np.sort(row << self.bits | flat)
        self.key = key[np.r_[True, key[1:] != key[:-1]]]
        self.n = np.bincount(self.key >> self.bits, minlength=sets)
        self.start = np.cumsum(self.n) - self.n

    def held(self, of: np.ndarray, into: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair (of, into): which of the first ``most`` members of
        ``of`` are members of ``into`` (flat, with the pair's number)."""
        pair = np.repeat(np.arange(len(of)), most)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(most) - most, most) + self.start[of][pair]
        want = into[pair] << self.bits | self.key[at] & ((1 << self.bits) - 1)
        found = np.searchsorted(self.key, want)
        found[found == len(self.key)] = 0
        return self.key[found] == want, pair

    def place(self, row: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Position of a value within its row's sorted members."""
        want = row << self.bits | np.searchsorted(self.known, value)
        return np.searchsorted(self.key, want) - self.start[row]


def count_links(table: pa.Table, rarity: np.ndarray) -> pa.Table:
    """The verified links among the classes of ``table`` (cls, doc, line,
    words, and ``at``: the g, pair and side under which each is compared),
    summed per class: y, n_links, n_earlier, near_d, near_x."""
    classes = table["cls"].to_numpy()
    where = table["at"].combine_chunks()
    row = np.repeat(np.arange(len(classes)), pc.list_value_length(where).to_numpy())
    data = {c: pc.struct_field(where.flatten(), c).to_numpy() for c in ("g", "pair", "side")}
    data |= {c: table[c].to_numpy()[row] for c in ("doc", "line")} | {"cls": classes[row]}
    words = table["words"].combine_chunks()
    hashes = np.concatenate([np.frombuffer(w.as_buffer(), np.uint64) for w in words])
    of = np.repeat(np.arange(len(classes)), pc.binary_length(words).to_numpy() // 8)
    exact = Sets(of, hashes, len(classes))
    numbers = Sets(of, hashes & MASK | rarity[(hashes >> np.uint64(47)).astype(np.int64)], len(classes))
    place = np.empty(len(row), np.int64)
    place[np.lexsort((data["cls"], data["line"], data["doc"]))] = np.arange(len(row))
    order = np.lexsort((numbers.n[row], data["pair"], data["g"]))
    row, g, pair, place = row[order], data["g"][order], data["pair"][order], place[order]
    group = np.zeros(len(row), np.int64)
    group[1:] = np.cumsum((g[1:] != g[:-1]) | (pair[1:] != pair[:-1]))
    b0, b1, b2 = bitmaps(numbers.known[numbers.key & ((1 << numbers.bits) - 1)], numbers.start)
    pos = numbers.place(row, g.view(np.uint64))
    col = {"g": group, "n": numbers.n[row], "pos": pos, "b0": b0[row], "b1": b1[row], "b2": b2[row],
           "side": data["side"][order]}
    links, earlier = np.zeros(len(classes), np.int64), np.zeros(len(classes), np.int64)
    near_d, near_x = np.full(len(classes), 1 << 40, np.int64), np.zeros(len(classes), np.int64)

    def verify(y, x):
        y, x = np.where(place[y] > place[x], y, x), np.where(place[y] > place[x], x, y)
        # only under the first word that both share: no word before it is in the other set
        before, of = numbers.held(row[x], row[y], pos[x])
        alone = np.ones(len(x), bool)
        alone[of[before]] = False
        y, x = row[y[alone]], row[x[alone]]
        hit, of = exact.held(x, y, exact.n[x])
        common = np.bincount(of[hit], minlength=len(x))
        both = exact.n[x] + exact.n[y]
        ok = (NUM + DEN) * common >= NUM * both
        y, x, d = y[ok], x[ok], (both - 2 * common)[ok]
        np.add.at(links, y, 1)
        np.add.at(links, x, 1)
        np.add.at(earlier, y, 1)
        by = np.lexsort((classes[x], d, y))
        y, x, d = y[by], x[by], d[by]
        best = np.ones(len(y), bool)
        best[1:] = y[1:] != y[:-1]
        y, x, d = y[best], classes[x[best]], d[best]
        better = (d < near_d[y]) | ((d == near_d[y]) & (x < near_x[y]))
        near_d[y[better]], near_x[y[better]] = d[better], x[better]

    held, many = [], 0
    for y, x in _shifts(col):
        held.append((y, x))
        many += len(y)
        if many >= PAIRS:
            verify(*map(np.concatenate, zip(*held)))
            held, many = [], 0
    if many:
        verify(*map(np.concatenate, zip(*held)))
    some = np.flatnonzero(links)
    none = earlier[some] == 0
    return pa.table({"y": pa.array(classes[some]), "n_links": pa.array(links[some]), "n_earlier": pa.array(earlier[some]),
                     "near_d": pa.array(near_d[some], mask=none), "near_x": pa.array(near_x[some], mask=none)})


def linked_classes(docs: DataFrame) -> DataFrame:
    """y, n_links, n_earlier, match_id of every class with a verified link."""
    counts, words = word_counts(docs)
    asked = asked_classes(docs, counts, words)
    places = written(asked.groupBy("cls").agg(F.first("doc").alias("doc"), F.first("line").alias("line")), "places")
    parts = max(1, asked.count() // 20_000)
    # a class and its words go to a part once, however many words of it meet there
    of_part = (asked.withColumn("_part", F.pmod(F.xxhash64("g", "pair"), F.lit(parts)).cast("int"))
               .groupBy("_part", "cls").agg(F.first("doc").alias("doc"), F.first("line").alias("line"),
                                            F.collect_list(F.struct("g", "pair", "side")).alias("at")))
    joined = of_part.join(words_of_classes(docs, places), "cls")
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def count(t: pa.Table) -> pa.Table:
        out = count_links(t, rarities(shared.value))
        give_back()
        return out

    sums = (joined.groupBy("_part").applyInArrow(count, "y long, n_links long, n_earlier long, near_d long, near_x long"))
    near = F.min(F.when(F.col("near_d").isNotNull(), F.struct("near_d", "near_x")))
    return written(sums.groupBy("y").agg(F.sum("n_links").alias("n_links"), F.sum("n_earlier").alias("n_earlier"),
                                         near["near_x"].alias("match_id")), "links")


def removal(lines: DataFrame, linked: DataFrame) -> DataFrame:
    """The lines with what is known of their class (``linked``; null if
    nothing) and whether they are a later line of it."""
    first = lines.groupBy("y").agg(F.min(F.struct("doc", "line")).alias("first"), F.count(F.lit(1)).alias("_n"))
    of_class = written(first.join(linked, "y", "left").filter(
        (F.col("_n") > 1) | F.col("n_links").isNotNull()).drop("_n"), "classes")
    later = F.coalesce(F.struct("doc", "line") > F.col("first"), F.lit(False))
    return (lines.join(of_class, "y", "left").withColumn("later", later).drop("first"))


def matched_lines(docs: DataFrame) -> DataFrame:
    """One row per line that has words: doc_id, line_no, n_words, class_id,
    match_id (of the matching classes with an earlier line the one with the
    fewest differing words, or null), n_earlier (matching classes with an
    earlier line), n_links (all matching classes), removed. A pair of classes
    is one link, however many lines they have.

    A null text has no lines; blank lines are no rows and are never removed.
    Rows with the same doc_id are one document's, so of two equal rows the
    lines stand at the same place and neither removes the other; a null doc_id
    comes last in the order. Other columns are ignored; an empty table gives
    an empty result.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    n_earlier, n_links = (F.coalesce(c, F.lit(0)) for c in ("n_earlier", "n_links"))
    return (removal(line_records(docs), linked_classes(docs))
            .select(F.when(~F.col("no_id"), F.col("doc")).cast(kind).alias("doc_id"),
                    F.col("line").cast("int").alias("line_no"), F.col("n").alias("n_words"),
                    F.col("y").alias("class_id"), "match_id", n_earlier.alias("n_earlier"),
                    n_links.alias("n_links"), (F.col("later") | (n_earlier > 0)).alias("removed")))


def drop_lines(docs: DataFrame) -> DataFrame:
    """The documents without their removed lines, all columns kept; n_chars
    (if there) follows the text. Documents that lose every line with words
    go; documents that had none (null, empty, blank) stay as they are. Rows
    that share a doc_id, or have none, lose the lines found removed under that
    id; an empty table gives an empty result."""
    gone = (matched_lines(docs).filter("removed").groupBy(F.col("doc_id").alias("_of"))
            .agg(F.collect_set(F.struct("line_no", "class_id")).alias("_gone")))
    names = docs.columns
    schema = T.StructType(list(docs.schema.fields))

    def run(batches):
        for batch in batches:
            texts, gone = batch.column("text").to_pylist(), batch.column("_gone").to_pylist()
            stays = [True] * len(texts)
            some = [i for i, g in enumerate(gone) if g]
            classes = {i: {} for i in some}
            for a, b, off, before in pieces(batch.column("text").take(pa.array(some, pa.int64()))):
                row, line, _, cls, _ = line_sets(b, off)
                for i, k, c in zip((row + a).tolist(), (line + before).tolist(), cls.tolist()):
                    classes[some[i]][k] = c
            for i, own in classes.items():
                wanted = {(x["line_no"], x["class_id"]) for x in gone[i]}
                out = {k for k, c in own.items() if (k, c) in wanted}
                stays[i] = len(out) < len(own)
                if out:
                    texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in out)
            columns = {c: batch.column(c) for c in names}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                changed = pa.array([g is not None for g in gone])
                columns["n_chars"] = pc.if_else(
                    changed, pc.utf8_length(columns["text"]).cast(columns["n_chars"].type),
                    columns["n_chars"])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names).filter(pa.array(stays))

    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_of")), "left").drop("_of")
    return joined.mapInArrow(released(run), schema)
