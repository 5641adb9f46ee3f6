"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its hashed words and character
3-, 4- and 5-grams (UTF-8 bytes, case kept); a word like the one before it
counts as one shared word, "repeat".  A softmax over two classes gives the score.  Vectors and output weights are trained together by numpy stochastic
gradient descent.

Training uses at most ``SAMPLE`` labelled documents, those with the smallest
hashes of their ids (of several rows of one id the least text), so the bound is
fixed and the choice is the same at every run.  It runs in one task; the sample is bounded, so its memory is too.  For
scoring, each hash bucket's vector is folded with the output weights into one
number (the average is linear), 1 MB in all, which is broadcast.

Defined results: null or empty text has no features and gets the score of the
bias; documents without a label are scored only; with no usable label (or only
one class) the score is the smoothed share of label 1; repeated rows get equal
rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, ship
from .textvec import SPACE, U, chunks, prefix_sums, span_hash, string_bytes, word_spans

BITS, DIM, EPOCHS, RATE = 18, 16, 6, 0.4
GRAMS = (3, 4, 5)
SAMPLE = 3000
#: The bucket of a word that repeats the one before it.
REPEAT = 1
_ODD = {3: U(0x9E3779B97F4A7C15), 4: U(0xC2B2AE3D27D4EB4F), 5: U(0x165667B19E3779F9)}


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words and each n: buckets, and of each document the first and the end."""
    s, e, first = word_spans(data, offsets, SPACE)
    h = span_hash(prefix_sums(data), s, e)
    buckets = (h >> U(64 - BITS)).astype(np.int32)
    again = np.flatnonzero(h[1:] == h[:-1]) + 1
    buckets[again[~np.isin(again, first)]] = REPEAT
    yield buckets, first[:-1], first[1:]
    wide = data.astype(U)
    for n in GRAMS:
        m = max(0, len(wide) - n + 1)
        x = np.zeros(m, U)
        for k in range(n):
            x |= wide[k : k + m] << U(8 * k)
        x *= _ODD[n]
        x >>= U(64 - BITS)
        starts = np.minimum(offsets[:-1], m)
        yield x.astype(np.int32), starts, np.maximum(starts, np.minimum(offsets[1:] - n + 1, m))


def train(texts: pa.Array, labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """One number a bucket, and the bias: the score is sigmoid(bias + their mean)."""
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    data, offsets = string_bytes(texts)
    for _, _, part, offs in chunks(data, offsets):
        found = list(_features(part, offs))
        for i in range(len(offs) - 1):
            ids, n = np.unique(np.concatenate([b[s[i] : e[i]] for b, s, e in found]), return_counts=True)
            docs.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    y = labels.astype(np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return np.zeros(1 << BITS, np.float32), bias
    r = np.random.default_rng(seed)
    vectors = r.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    b = np.array([0.0, bias], np.float32)
    step, steps = 0, EPOCHS * len(docs)
    for _ in range(EPOCHS):
        for i in r.permutation(len(docs)):
            descend(vectors, out, b, *docs[i], int(y[i]), RATE * (1 - step / steps))
            step += 1
    return fold(vectors, out, b)


def softmax(vectors: np.ndarray, out: np.ndarray, b: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of both labels of a document, and its averaged vector."""
    mean = weight @ vectors[ids]
    z = out @ mean + b
    p = np.exp(z - z.max())
    return p / p.sum(), mean


def descend(vectors: np.ndarray, out: np.ndarray, b: np.ndarray, ids: np.ndarray, weight: np.ndarray, label: int, rate: float) -> None:
    """One step down the gradient of -log(probability of the label); the bias goes slower, the vectors of many shared features faster."""
    p, mean = softmax(vectors, out, b, ids, weight)
    p[label] -= 1
    back = p @ out
    out -= rate * np.outer(p, mean)
    b -= 0.1 * rate * p
    vectors[ids] -= (rate * min(64.0, 1 / max(1e-6, float((weight * weight).sum())))) * np.outer(weight, back)


def fold(vectors: np.ndarray, out: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """One number a bucket and a bias whose sigmoid is the softmax of label 1, for the average is linear."""
    return vectors @ (out[1] - out[0]), float(b[1] - b[0])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Trains on the documents whose ids are in ``labels`` (doc_id, label 0 or 1)."""
    ship(docs.sparkSession)
    chosen = labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.where("doc_id is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("label", pa.int64())]))
        t = t.sort_by([("doc_id", "ascending"), ("label", "ascending")])
        weights, bias = train(t.column("text").cast(pa.large_string()), t.column("label").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()]), pa.array([bias])], ["weights", "bias"])

    rows = rows.select("doc_id", "text", F.col("label").cast("long").alias("label"))
    model = rows.repartition(1).mapInArrow(run, "weights binary, bias double").first()
    if model is None:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(model["weights"], "<f4"), model["bias"]


def scores(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The score of each text."""
    data, offsets = string_bytes(texts)
    out = [np.zeros(0)]
    for _, _, part, offs in chunks(data, offsets):
        total, n = np.zeros(len(offs) - 1), np.zeros(len(offs) - 1)
        for buckets, s, e in _features(part, offs):
            sums = np.concatenate([[0.0], np.cumsum(weights[buckets], dtype=np.float64)])
            total += sums[e] - sums[s]
            n += e - s
        out.append(1 / (1 + np.exp(-(bias + total / np.maximum(n, 1)))))
    return np.concatenate(out)


def score(df: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", into: str = "score") -> DataFrame:
    """``df`` without its text column, with the score of each row."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c not in (text_col, into)]
    text = fresh_name(kept, "text_")
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), f"`{into}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores(batch.columns[-1], weights, bias))], [*kept, into])

    return df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").cast("string").alias(text)).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows that training never sees: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
