"""Document quality by supervised subword embeddings (operator 1).

A document is the average of learned vectors of its hashed words and character n-grams; a softmax over that average
gives the class. The vectors and the softmax are trained on the driver by numpy stochastic gradient descent over a
bounded sample of labelled documents; every document is then scored in its own task, over its whole text. Since
average and softmax weights are linear, scoring looks up one number per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import text as T
from .common import Scratch, small_batches, trim, trimmed

#: Labelled documents that one fit uses at most, chosen by a hash of doc_id, and their bytes of text.
TRAIN_DOCUMENTS, TRAIN_BYTES, LONGEST_TEXT = 4000, 64 << 20, 1 << 20
BUCKETS, DIMENSIONS, NGRAMS = 1 << 16, 8, (1, 2, 3, 4)
EPOCHS, RATE, SEED = 8, 0.5, 7


def _grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For words, word pairs, the same pairs by their form alone, and each length of character n-gram inside words: the
    buckets, and where each text's begin. The form of a pair is whether it is one word twice; it has two buckets of its
    own, since no hash of the words tells that of words that were never seen."""
    mask = np.uint64(BUCKETS - 1)
    w = T.words(pa.array([t or "" for t in texts], pa.string()))
    yield (T.mix(w.hash, 1) & mask).astype(np.int64), w.first
    pairs = w.windows(2)
    first = np.searchsorted(pairs, w.first)
    yield (T.mix(T.Prefix(w.hash).of(pairs, pairs + 2), 2) & mask).astype(np.int64), first
    yield BUCKETS + (w.hash[pairs] == w.hash[pairs + 1]).astype(np.int64), first
    points = np.frombuffer("\n".join([*(t or "" for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t or "") + 1 for t in texts])])
    gap = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    gaps = np.concatenate([[0], np.cumsum(gap, dtype=np.int32)])
    sums, n = T.Prefix(points.astype(np.uint64) + np.uint64(1)), len(points)
    for k in NGRAMS:
        at = np.flatnonzero(gaps[k:] == gaps[: max(0, n - k + 1)])
        yield (T.mix(sums.of(at, at + k), 100 + k) & mask).astype(np.int64), np.searchsorted(at, starts)


@dataclass
class Model:
    """One weight a bucket (embedding times the difference of the two softmax rows) and the bias difference."""

    weight: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of class 1; texts without characters get the bias alone."""
        total, many = np.zeros(len(texts)), np.zeros(len(texts))
        for bucket, first in _grams(texts):
            sums = np.concatenate([[0.0], np.cumsum(self.weight[bucket], dtype=np.float64)])
            total += sums[first[1:]] - sums[first[:-1]]
            many += np.diff(first)
        z = total / np.maximum(many, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(texts: list[str | None], labels: list[int]) -> Model:
    """Stochastic gradient descent on the cross-entropy of the softmax, one document a step, rate falling to zero.

    A vector's step is that of the average's gradient times the number of different n-grams of the document, four times
    the mean share at most: scaled so, a long document's many n-grams learn as fast as a short one's few.

    Without both classes in ``labels`` the model scores every text by its bias."""
    y = np.array(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(BUCKETS + 2, np.float32), 0.0 if len(y) == 0 else 4.0 * (2 * y[0] - 1))
    rng = np.random.default_rng(SEED)
    # two arrays for all documents, which the driver gives back whole
    many, all_ids, all_shares = [0], [], []
    for at in range(0, len(texts), 64):
        grams, found_ids, found_shares = list(_grams(texts[at : at + 64])), [], []
        for i in range(len(texts[at : at + 64])):
            bucket = np.concatenate([found[first[i] : first[i + 1]] for found, first in grams])
            ids, counts = np.unique(bucket, return_counts=True)
            found_ids.append(ids.astype(np.int32))
            found_shares.append((counts / max(1, len(bucket))).astype(np.float32))
            many.append(len(ids))
        all_ids.append(np.concatenate(found_ids))
        all_shares.append(np.concatenate(found_shares))
    all_ids, all_shares, begin = np.concatenate(all_ids), np.concatenate(all_shares), np.cumsum(many)
    embedding = (rng.random((BUCKETS + 2, DIMENSIONS), np.float32) - 0.5) / DIMENSIONS
    softmax, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    step, steps = 0, EPOCHS * len(y)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            rate = RATE * (1 - step / steps)
            step += 1
            ids, share = all_ids[begin[i] : begin[i + 1]], all_shares[begin[i] : begin[i + 1]]
            rows = embedding[ids]
            hidden = share @ rows
            z = hidden @ softmax + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = softmax @ p
            softmax -= rate * np.outer(hidden, p)
            bias -= rate * p
            # every n-gram of the document moves alike, however long the document is
            embedding[ids] = rows - rate * back * np.minimum(share * len(ids), 4.0)[:, None]
    return Model((embedding @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fold(doc_id: Column) -> Column:
    """The remainder that tells held-out rows (1) from the others."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """A model from at most TRAIN_DOCUMENTS labelled documents outside the held-out fold, whose texts have TRAIN_BYTES at
    most together; the texts are whole, and one longer than LONGEST_TEXT is no example. Texts are taken in the order of
    the ids' hashes, and one that no longer fits is passed over.

    Null labels and ids are left out; of several labels of one doc_id the largest counts, of several texts the one with
    the smallest hash; a null text is an empty one. Without labels every text scores one half; labels whose texts are all
    too long are an error."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCUMENTS)
    pairs = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # TRAIN_DOCUMENTS rows at most
    one_text = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    rows = pairs.groupBy(F.xxhash64("doc_id").alias("h"), "doc_id").agg(one_text, F.first("y").alias("y"))
    rows = Scratch(docs.sparkSession, "op1").table("labelled", rows)
    sizes = sorted((r.h, r.doc_id, r.n or 0) for r in rows.select("h", "doc_id", F.octet_length("text").alias("n")).collect())
    within, total = [], 0
    for h, _, n in sizes:
        if n <= LONGEST_TEXT and total + n <= TRAIN_BYTES:
            within.append((h,))
            total += n
    if sizes and not within:
        raise ValueError("every labelled text is longer than LONGEST_TEXT")
    some = docs.sparkSession.createDataFrame(within, "h long")  # TRAIN_DOCUMENTS rows at most
    known = sorted(rows.join(F.broadcast(some), "h", "left_semi").collect(), key=lambda r: (r.h, r.doc_id))
    texts, ys = [r.text for r in known], [r.y for r in known]
    del known, sizes, within
    model = train(texts, ys)
    del texts
    trim()  # the driver's Python, for the rest of the session
    return model


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``score`` (0 to 1, higher: class 1 likelier), replacing any column of that name.

    Null text scores as empty text. Nothing but the text enters the score, so repeated rows score alike; texts of any
    length are scored whole; an empty table gives no rows."""
    docs = small_batches(docs.drop("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one float a bucket
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", 1 << 18):
                score = shared.value.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*names, "score"])

    return docs.mapInArrow(trimmed(run), StructType([*docs.schema.fields, StructField("score", DoubleType())]))
