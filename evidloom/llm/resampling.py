"""Target-distribution importance resampling over hashed words and pairs of words.

Head-tail vocabulary: the most frequent words are broadcast with the CRC states of the word and of the word with a space
after it, and the most frequent pairs with their buckets. Other words take their CRC directly, and a pair with a word of
the tail goes on from the state of its first word. Both ways give the same bucket, so that the totals of all buckets are
exact whatever the head holds; the head only saves work. No text is shuffled.
"""
from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidloom.llm.storage import stored
from evidloom.llm.textarrays import LOWER, buffers, separators
from evidloom.llm.workers import in_arrow, slices
from evidloom.shipping import ship_by_value

SEPARATOR = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
BUCKETS = 10_000
#: words and pairs of the broadcast head; a task counts at most SKETCH of each before it drops the rarest
HEAD_WORDS, HEAD_PAIRS, SKETCH = 4_096, 8_192, 65_536
#: fewest words of a document that can be drawn, and the share drawn in hundredths
MIN_WORDS, SHARE = 20, 25


class SliceWords:
    """Distinct words of a slice (bytes), the code of each word in order, and the number of words of each text."""

    def __init__(self, column: pa.Array):
        data, offsets = buffers(column)
        low = LOWER[data]
        inside = ~SEPARATOR[low]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        first = inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1] | edge[1:-1]
        start = np.flatnonzero(first)
        packed = low[inside]
        place = np.cumsum(inside) - 1
        at = np.append(place[start], len(packed)).astype(np.int32) if len(start) else np.zeros(1, np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(packed)])
        encoded = words.dictionary_encode()
        self.words = encoded.dictionary.to_pylist()
        self.code = np.asarray(encoded.indices).astype(np.int64)
        edges = np.searchsorted(start, offsets)
        self.count = np.diff(edges)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes of both words, as one number, for each pair of neighbours, and its text."""
        same = self.doc[1:] == self.doc[:-1]
        return (self.code[:-1] * max(1, len(self.words)) + self.code[1:])[same], self.doc[1:][same]


class Head:
    """CRC states of frequent words and buckets of frequent pairs."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]], n_buckets: int):
        self.n_buckets = n_buckets
        self.place = {w: k for k, w in enumerate(words)}
        self.state = [(zlib.crc32(w), zlib.crc32(w + b" ")) for w in words]
        known = sorted((self.place[a] * len(words) + self.place[b], zlib.crc32(b, self.state[self.place[a]][1]) % n_buckets)
                       for a, b in pairs if a in self.place and b in self.place)
        self.pair = np.array([k for k, _ in known], np.int64)
        self.bucket = np.array([b for _, b in known], np.int64)

    def buckets(self, found: SliceWords) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each feature of a slice, and its text."""
        n, place, state, words = len(found.words), self.place, self.state, found.words
        where = np.fromiter((place.get(w, -1) for w in words), np.int64, n)
        alone = np.empty(n, np.int64)
        spaced = [0] * n
        for k, at in enumerate(where.tolist()):
            whole, spaced[k] = state[at] if at >= 0 else (zlib.crc32(words[k]), zlib.crc32(words[k] + b" "))
            alone[k] = whole
        code, owner = found.pairs()
        some, back = np.unique(code, return_inverse=True)
        a, b = some // max(1, n), some % max(1, n)
        out = np.full(len(some), -1, np.int64)
        if len(self.pair) and len(some):
            key = np.where((where[a] >= 0) & (where[b] >= 0), where[a] * len(state) + where[b], -1)
            slot = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            out = np.where(self.pair[slot] == key, self.bucket[slot], -1)
        rest = np.flatnonzero(out < 0)
        crc = zlib.crc32
        out[rest] = np.fromiter((crc(words[y], spaced[x]) for x, y in zip(a[rest].tolist(), b[rest].tolist())),
                                np.int64, len(rest)) % self.n_buckets
        return np.concatenate([(alone % self.n_buckets)[found.code], out[back]]), np.concatenate([found.doc, owner])


def _texts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.col(f"`{text}`").cast("string").alias("text"))


def frequent(df: DataFrame, text: str, n_buckets: int = BUCKETS) -> Head:
    """The head of a table of texts. Each task keeps a bounded count; which words are in the head changes no result."""
    def run(batches):
        import pyarrow.compute  # noqa: F401
        words, pairs = Counter(), Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                found = SliceWords(part.column(0))
                names = found.words
                times = np.bincount(found.code, minlength=len(names))
                top = np.argsort(-times, kind="stable")[:HEAD_WORDS]
                words.update({names[k]: int(times[k]) for k in top.tolist()})
                code, n = np.unique(found.pairs()[0], return_counts=True)
                top = np.flatnonzero(n > 1)
                top = top[np.argsort(-n[top], kind="stable")[:HEAD_PAIRS]]
                pairs.update({(names[c // len(names)], names[c % len(names)]): k
                              for c, k in zip(code[top].tolist(), n[top].tolist())})
                for counter, limit in ((words, HEAD_WORDS), (pairs, HEAD_PAIRS)):
                    if len(counter) > SKETCH:
                        kept = counter.most_common(4 * limit)
                        counter.clear()
                        counter.update(dict(kept))
        top = words.most_common(HEAD_WORDS)
        two = pairs.most_common(HEAD_PAIRS)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top] + [a for (a, _), _ in two], pa.binary()),
             pa.array([None] * len(top) + [b for (_, b), _ in two], pa.binary()),
             pa.array([n for _, n in top] + [n for _, n in two], pa.int64())], ["a", "b", "n"])

    rows = in_arrow(_texts(df, text), run, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    rows = stored(rows, "frequent")
    best = lambda some, k: some.orderBy(F.desc("n"), "a", "b").limit(k).collect()
    return Head([bytes(r["a"]) for r in best(rows.where("b is null"), HEAD_WORDS)],
                [(bytes(r["a"]), bytes(r["b"])) for r in best(rows.where("b is not null"), HEAD_PAIRS)], n_buckets)


def bucket_totals(df: DataFrame, text: str, head: Head) -> np.ndarray:
    """Exact number of features in each bucket, over whole texts of all rows."""
    sent = df.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        import pyarrow.compute  # noqa: F401
        total = np.zeros(sent.value.n_buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                found, _ = sent.value.buckets(SliceWords(part.column(0)))
                total += np.bincount(found, minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int64)), pa.array(total[there])], ["bucket", "n"])

    out = np.zeros(head.n_buckets, np.int64)
    for r in in_arrow(_texts(df, text), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandfold log ratio of both smoothed distributions, rounded down, for each bucket."""
    n, big_s, big_t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (big_s + n) / ((s + 1) * (big_t + n))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def with_weights(df: DataFrame, text: str, head: Head, gains: np.ndarray) -> DataFrame:
    """The columns of ``df`` other than the text, with ``n_words``, ``n_features`` and ``weight``."""
    sent = df.sparkSession.sparkContext.broadcast((head, gains))
    added = ["n_words", "n_features", "weight"]
    kept = [c for c in df.columns if c != text and c not in added]
    inner = [f"c{k}" for k in range(len(kept))]
    source = df.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(kept, inner)], F.col(f"`{text}`").cast("string").alias("text"))
    schema = StructType([source.schema[i] for i in inner])
    for name in added:
        schema = schema.add(name, "long")

    def run(batches):
        import pyarrow.compute  # noqa: F401
        table, gain = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                found = SliceWords(part.column(len(inner)))
                bucket, owner = table.buckets(found)
                order = np.argsort(owner, kind="stable")
                total = np.append(0, np.cumsum(gain[bucket][order]))
                n = np.bincount(owner, minlength=part.num_rows)
                end = np.cumsum(n)
                weight = (total[end] - total[end - n]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(inner)], pa.array(found.count.astype(np.int64)), pa.array(n.astype(np.int64)),
                     pa.array(weight.astype(np.int64))], schema.fieldNames())

    out = in_arrow(source, run, schema)
    return out.select(*[F.col(i).alias(c) for c, i in zip(kept, inner)], *added)


def gumbel(key: str, seed: int) -> Column:
    """Thousandfold Gumbel noise of a seeded hash of the key, rounded down. A null key counts as empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(scored: DataFrame, key: str, share: int = SHARE, least: int = MIN_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... of the best scores, ties to the smaller key; null for rows that aren't drawn.

    The scores are whole numbers in a range that their formula bounds (weights within 1000 ln 2^63 of zero, noise from
    -3,200 to 23,000, so fewer than 120,000 values), so one histogram gives the cut and the first rank of every score.
    Only rows of one score are sorted together. A null key comes last among equal scores.
    """
    can = F.col("n_words") >= least
    counts = sorted(((r["score"], r["n"]) for r in
                     scored.where(can).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    take, before, starts = sum(n for _, n in counts) * share // 100, 0, []
    for score, n in counts:
        if before >= take:
            break
        starts.append((score, before))
        before += n
    if not starts:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    cut = starts[-1][0]
    from pyspark.sql import Window
    at = scored.sparkSession.createDataFrame(starts, "score long, __before long")
    within = Window.partitionBy("score").orderBy(F.col(f"`{key}`").asc_nulls_last(), "n_features", "weight")
    chosen = (scored.where(can & (F.col("score") >= cut)).withColumn("__row", F.row_number().over(within))
              .join(F.broadcast(at), "score").withColumn("rank", F.col("__before") + F.col("__row"))
              .withColumn("rank", F.when(F.col("rank") <= take, F.col("rank"))))
    others = scored.where(~(can & (F.col("score") >= cut))).withColumn("rank", F.lit(None).cast("long"))
    return chosen.select(*scored.columns, "rank").unionByName(others)


def importance_resample(documents: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text",
                        target_text: str = "text", seed: int = 7, n_buckets: int = BUCKETS, share: int = SHARE,
                        least: int = MIN_WORDS) -> DataFrame:
    """The columns of ``documents`` other than the text, with n_words, n_features, weight, score and rank.

    Null and empty texts have no features, weight 0 and are never drawn. Repeated rows are rows of their own: they have
    the same score and ranks one after the other. Added columns replace columns of the same name; an empty table
    gives no rows, and an empty target the gains of a target without features.
    """
    head = frequent(documents, text, n_buckets)
    gains = bucket_gains(bucket_totals(documents, text, head), bucket_totals(target, target_text, head))
    rows = documents.drop(*[c for c in ("score", "rank") if c not in (key, text)])
    weighted = with_weights(rows, text, head, gains)
    scored = stored(weighted.withColumn("score", F.col("weight") + gumbel(key, seed)), "scored")
    return drawn(scored, key, share, least)


ship_by_value(__name__)
