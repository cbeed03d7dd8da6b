"""Quality by compression: which dictionary makes a text smaller?

Two zstandard dictionaries are trained, from good and from bad labelled
texts. A text is compressed with either, in frames of ``FRAME`` bytes, so
that the dictionaries count along the whole text; the normalised difference
(bad - good) / (bad + good) of the compressed sizes, together with the text's
plain compression ratio, goes through a logistic calibration fitted on other
labelled texts: a score from 0 to 1, higher if label 1 is likelier.

The classifier is fitted on a bounded sample of labelled rows: whole texts in
the order of their hashes, equal texts once, of either label at most ``SAMPLE``
rows and ``SAMPLE_BYTES`` bytes together. Every text is then scored whole.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regstat.llm.common import released, written

SAMPLE, SAMPLE_BYTES = 3000, 24_000_000
DICT_BYTES, FRAME, LEVEL = 64 * 1024, 2048, 3
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Classifier:
    """Dictionaries and calibration; picklable, about 130 KB."""

    def __init__(self, good: bytes, bad: bytes, weights: list[float]):
        self.good, self.bad, self.weights = good, bad, weights
        self._tools = None

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "weights": self.weights, "_tools": None}

    def _compressors(self):
        if self._tools is None:
            def tool(data):
                d = zstandard.ZstdCompressionDict(data) if data else None
                if d is not None:
                    d.precompute_compress(level=LEVEL)
                return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False,
                                                write_content_size=False, write_dict_id=False)
            self._tools = tool(self.good), tool(self.bad), tool(b"")
        return self._tools

    def features(self, text: str | None) -> tuple[float, float]:
        """Normalised size difference, and plain size per byte."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0, 1.0
        good, bad, plain = (
            sum(len(tool.compress(raw[i:i + FRAME])) for i in range(0, len(raw), FRAME))
            for tool in self._compressors())
        return (bad - good) / (bad + good), min(1.5, plain / len(raw))

    def vector(self, text: str | None) -> list[float]:
        d, r = self.features(text)
        return [1.0, 10 * d, r, r * r, 10 * d * r]

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.weights, self.vector(text)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton's method; a small ridge keeps separable samples finite."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary, or the raw texts if there are too few to train."""
    parts = [raw[i:i + FRAME] for raw in (t.encode("utf-8", "surrogatepass") for t in texts)
             for i in range(0, len(raw), FRAME)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:DICT_BYTES]


def fit(good: list[str], bad: list[str], good_share: float) -> Classifier:
    """Dictionaries from the even samples, calibration from the odd ones,
    weighted to the share of label 1 among the labelled rows."""
    out = Classifier(_dictionary(good[::2]), _dictionary(bad[::2]), [0.0] * 5)
    rows = [(out.vector(t), 1.0) for t in good[1::2]] + [(out.vector(t), 0.0) for t in bad[1::2]]
    if not rows:
        out.weights = [math.log((good_share + 1e-6) / (1 - good_share + 1e-6)), 0, 0, 0, 0]
        return out
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    w = _logistic(x, y)
    n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    share = min(max(good_share, 1e-6), 1 - 1e-6)
    w[0] += math.log(share / (1 - share)) - math.log(n1 / n0)
    out.weights = w.tolist()
    return out


def chosen(rows: list, most: int) -> list:
    """The rows, in their order, that fit into ``most`` bytes together; one
    that does not fit is passed over."""
    out, held = [], 0
    for r in rows:
        if held + r["_size"] <= most:
            out.append(r)
            held += r["_size"]
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> Classifier:
    """Fit on labelled rows that are not held out. The sample on the driver is
    at most 2 * ``most`` bytes of whole texts, whatever the tables hold."""
    known = (labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_q"))
             .filter("_id is not null and _q in (0, 1)").filter(~held_out(F.col("_id"))))
    share = known.agg(F.avg(F.col("_q").cast("double"))).first()[0]
    texts = docs.filter("text is not null and text <> ''").select(
        F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"), "text")
    # equal texts once; the sample's (hash, id) rows first, then only its texts
    distinct = written(texts.select("_id", "_h", F.octet_length("text").alias("_size")).join(known, "_id")
                       .groupBy("_q", "_h").agg(F.min(F.struct("_id", "_size")).alias("_r"))
                       .select("_q", "_h", "_r._id", "_r._size"), "labelled")
    rows = [r for label in (1, 0)
            for r in chosen(distinct.filter(f"_q = {label}").orderBy("_h").limit(sample).collect(), most)]
    picked = docs.sparkSession.createDataFrame(
        [tuple(r) for r in rows], T.StructType(distinct.schema.fields)).select("_q", "_h", "_id")
    got = (texts.join(F.broadcast(picked), ["_id", "_h"])
           .groupBy("_q", "_h").agg(F.min("text").alias("_text")).orderBy("_q", "_h").collect())
    texts = [[r["_text"] for r in got if r["_q"] == label] for label in (1, 0)]
    return fit(*texts, 0.5 if share is None else share)


def score_documents(docs: DataFrame, model: Classifier, out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``: the score of every whole text. One pass,
    no shuffle; an existing column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    docs = docs.drop(out)

    def run(batches):
        own = pickle.loads(shared.value)
        for batch in batches:
            scores = [own.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())],
                                             [*batch.schema.names, out])

    return docs.mapInArrow(released(run), T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts get the score of an empty text; repeated rows are
    scored each; a null doc_id is not held out and has no label; without
    labels every score is 0.5; other columns are ignored.
    """
    model = train(docs, labels)
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents (all columns) whose score reaches ``threshold``."""
    model = train(docs.select("doc_id", "text"), labels)
    mark = "_quality_of_row"
    return score_documents(docs, model, mark).filter(F.col(mark) >= threshold).drop(mark)
