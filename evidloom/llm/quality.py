"""Document quality by supervised subword embeddings: hashed word and character n-gram vectors, averaged, softmax.

The model is trained by numpy stochastic gradient descent on a bounded sample of labelled documents. As the mean of
vectors times the output matrix is the mean of their products, scoring needs one number for each hashed n-gram; every
whole text is scored, in slices, without a shuffle.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidloom.llm.columns import carried
from evidloom.llm.textarrays import Words, buffers, mix, separators
from evidloom.llm.workers import give_back, in_arrow, slices
from evidloom.shipping import ship_by_value

WORD_SEPARATOR = separators((0x00, 0x20))
#: labelled documents of each class that the classifier is fitted on at most, and bytes of text of the sample; a labelled
#: text of more than a hundredth of these bytes (240,000) is not fitted on, so that no single one fills the sample
SAMPLE_ROWS, SAMPLE_BYTES = 1_500, 24_000_000
BUCKETS, DIM, EPOCHS, RATE, SHARED = 1 << 17, 12, 4, 0.2, 20.0
#: gradient steps at least; a small sample is gone through more often
STEPS = 12_000
_MUL = np.uint64(0x9E3779B97F4A7C15)


def features(column: pa.Array, n_buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each feature of a slice and its document: words, pairs of words, words said twice,
    runs of three and four bytes."""
    data, offsets = buffers(column)
    n = len(offsets) - 1
    words = Words(data, offsets, WORD_SEPARATOR)
    found, owner = [words.hash], [words.doc]
    with np.errstate(over="ignore"):
        if len(words.hash) > 1:
            pair = mix(words.hash[:-1] * _MUL + words.hash[1:])
            same = words.doc[:-1] == words.doc[1:]
            found.append(pair[same])
            owner.append(words.doc[1:][same])
            again = words.doc[1:][same & (words.hash[:-1] == words.hash[1:])]
            found.append(np.ones(len(again), np.uint64))
            owner.append(again)
        byte_doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
        wide = data.astype(np.uint32)
        for size in (3, 4):
            if len(data) < size:
                continue
            value = np.zeros(len(data) - size + 1, np.uint32)
            for k in range(size):
                value = (value << np.uint32(8)) | wide[k:len(data) - size + 1 + k]
            value = value * np.uint32(0x9E3779B1)
            value = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA77)
            same = byte_doc[:len(value)] == byte_doc[size - 1:]
            found.append((value ^ (value >> np.uint32(13)))[same].astype(np.uint64) + np.uint64(size))
            owner.append(byte_doc[:len(value)][same])
    return ((np.concatenate(found) & np.uint64(n_buckets - 1)).astype(np.int64), np.concatenate(owner))


class Model:
    """One vector for each bucket, the output matrix and its bias; ``logit`` is what scoring needs."""

    def __init__(self, n_buckets: int = BUCKETS, dim: int = DIM, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / dim, 1 / dim, (n_buckets, dim))
        self.output = np.zeros((dim, 2))
        self.bias = np.zeros(2)

    def fit(self, texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 2) -> Model:
        """Gradient descent document by document; both classes weigh the same in all."""
        docs = []
        for t in texts:
            found, _ = features(pa.array([t], pa.string()), len(self.vectors))
            u, c = np.unique(found, return_counts=True)
            docs.append((u.astype(np.int32), (c / max(1, c.sum())).astype(np.float32)))
        labels = np.asarray(labels, np.int64)
        share = np.bincount(labels, minlength=2)
        weight = len(labels) / 2 / np.maximum(share, 1)
        epochs = max(epochs, -(-STEPS // len(docs)))
        rng, total, done = np.random.default_rng(seed), epochs * len(docs), 0
        for _ in range(epochs):
            for at in rng.permutation(len(docs)):
                u, w = docs[at]
                step = rate * (1 - done / total) * weight[labels[at]]
                done += 1
                own = self.vectors[u]
                mean = w @ own
                z = mean @ self.output + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[at]] -= 1
                back = self.output @ p
                self.output -= step * np.outer(mean, p)
                self.bias -= step * p
                # the mean's gradient, scaled up as it is shared by all features of the text
                self.vectors[u] = own - SHARED * step * np.outer(w, back)
        return self

    def logits(self) -> tuple[np.ndarray, float]:
        """Difference of both classes' outputs: one number for each bucket, and the bias."""
        change = self.output[:, 1] - self.output[:, 0]
        return (self.vectors @ change).astype(np.float32), float(self.bias[1] - self.bias[0])


def labelled_sample(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> list:
    """At most ``rows`` (text, label) of each class and ``size`` bytes, chosen by a hash of the id.

    Only ids whose crc32, as text, leaves a remainder other than 1 by 3 are taken; the others are held out.
    """
    known = (labels.select(F.col("doc_id").alias("k"), F.col("quality").cast("int").alias("y"))
             .where("k is not null and y in (0, 1)").where(~held_out("k")).distinct())
    some = None
    for y in (0, 1):
        one = known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(rows)
        some = one if some is None else some.union(one)
    texts = documents.select(F.col("doc_id").alias("k"), F.col("text").cast("string").alias("t"))
    found = (texts.join(F.broadcast(some), "k").select("t", "y", F.xxhash64("k").alias("o"))
             .withColumn("size", F.coalesce(F.octet_length("t"), F.lit(0))).where(F.col("size") <= size // 100))
    got, left = [], size
    for r in found.orderBy("o").toLocalIterator():
        left -= r["size"]
        if left < 0:
            break
        got.append((r["t"] or "", r["y"]))
    return got


def held_out(key: str):
    return F.crc32(F.col(key).cast("string")) % 3 == 1


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fitted on the bounded sample; without labels the model scores every text 0.5."""
    sample = labelled_sample(documents, labels)
    model = Model()
    if sample:
        model.fit([t for t, _ in sample], [y for _, y in sample])
    del sample
    give_back()
    return model


def with_quality(df: DataFrame, text: str, model: Model, score: str = "score") -> DataFrame:
    """``df`` with the chance of label 1 for every whole text, as a double.

    A null or empty text has no features and the score of the bias alone; a column named like ``score`` is replaced.
    """
    logit, bias = model.logits()
    sent = df.sparkSession.sparkContext.broadcast((logit, bias))
    source = carried(df, [score], F.col(f"`{text}`").cast("string").alias("text"))
    schema = StructType([source.schema["row"]]).add("score", "double")

    def run(batches):
        import pyarrow.compute  # noqa: F401
        weights, base = sent.value
        for batch in batches:
            for part in slices(batch, "text", 500_000):
                found, owner = features(part.column(1), len(weights))
                total = np.bincount(owner, weights[found], part.num_rows)
                count = np.bincount(owner, minlength=part.num_rows)
                z = total / np.maximum(count, 1) + base
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))],
                                                 schema.fieldNames())

    return in_arrow(source, run, schema).select("row.*", F.col("score").alias(score))


ship_by_value(__name__)
