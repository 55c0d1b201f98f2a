"""Packing of token pieces into sequences of fixed length: exact complements first, best fit for what is left.

Which lengths go together depends only on how many pieces there are of each length. Spark counts them (at most
``capacity`` counts reach the driver), the plan says for each length which range of its pieces fills which place of which
sequences, and tasks then place every piece from its number within its length. No piece passes the driver, and a length
with most of the pieces is spread over all tasks.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from evidloom.llm.bpe import default_tokenizer, encoder
from evidloom.llm.storage import stored
from evidloom.llm.workers import in_arrow, key_and_text, slices
from evidloom.shipping import ship_by_value

CAPACITY, END_ID = 1024, 2


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole if it fits, else full pieces after a first one that may be shorter."""
    if total <= capacity:
        return [total]
    first = total % capacity
    return [first] * (first > 0) + [capacity] * (total // capacity)


def token_pieces(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 path: str | None = None) -> DataFrame:
    """(key, piece, start, length, ids_crc32, part, local) of every whole text's ids followed by ``end_id``.

    A null or empty text has the end id alone. ``local`` numbers the pieces of one length within their task's ``part``.
    """
    path = path or default_tokenizer()
    rows = key_and_text(df, key, text)
    schema = StructType([StructField("key", rows.schema["key"].dataType), StructField("piece", IntegerType()),
                         StructField("start", LongType()), StructField("length", LongType()),
                         StructField("ids_crc32", LongType()), StructField("part", IntegerType()),
                         StructField("local", LongType())])

    def run(batches):
        import pyarrow.compute  # noqa: F401
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for some in slices(batch, "text"):
                ids, offsets = encoder(path).encode(some.column(1))
                row, piece, start, length, crc, local = [], [], [], [], [], []
                for i, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    data = np.append(ids[low:high], end_id).astype("<u4")
                    at = 0
                    for k, size in enumerate(cut_lengths(len(data), capacity)):
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(data[at:at + size]))
                        local.append(int(seen[size]))
                        seen[size] += 1
                        at += size
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                     pa.array([part] * len(row), pa.int32()), pa.array(local, pa.int64())], schema.fieldNames())

    return in_arrow(rows, run, schema)


class Plan:
    """Groups of like sequences: how many, and the lengths in each; at most ``capacity`` counts go in."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = [counts.get(n, 0) for n in range(capacity + 1)]
        self.groups: list[tuple[int, list[int]]] = []
        self._exact()
        self._best_fit()

    def _take(self, lengths: list[int]) -> None:
        """Form as many sequences of these lengths as the counts allow."""
        times = min(self.left[n] // lengths.count(n) for n in lengths)
        if times > 0:
            for n in lengths:
                self.left[n] -= times
            self.groups.append((times, lengths))

    def _exact(self) -> None:
        """Single, pair and triple sums that fill a sequence exactly, longest piece first."""
        top, left = self.capacity, self.left
        self._take([top])
        for a in range(top - 1, (top - 1) // 2, -1):
            if left[a] and left[top - a]:
                self._take([a, top - a])
        for a in range(top - 2, 0, -1):
            for b in range(min(a, top - a - 1), (top - a - 1) // 2, -1):
                if not left[a]:
                    break
                if left[b] and left[top - a - b]:
                    self._take([a, b, top - a - b])

    def _best_fit(self) -> None:
        """What is left, longest first: into the smallest gap that holds it, else into new sequences."""
        gaps: dict[int, list[tuple[int, list[int]]]] = {}
        for n in range(self.capacity, 0, -1):
            while self.left[n]:
                gap = min((g for g in gaps if g >= n), default=None)
                if gap is None:
                    each = min(self.capacity // n, self.left[n])
                    times, filled, gap = self.left[n] // each, [n] * each, self.capacity - n * each
                    self.left[n] -= times * each
                    gaps.setdefault(gap, []).append((times, filled))
                    continue
                times, filled = gaps[gap].pop()
                used = min(times, self.left[n])
                if times > used:
                    gaps[gap].append((times - used, filled))
                elif not gaps[gap]:
                    del gaps[gap]
                self.left[n] -= used
                gaps.setdefault(gap - n, []).append((used, filled + [n]))
        self.groups += [g for groups in gaps.values() for g in groups]

    def places(self) -> dict[int, np.ndarray]:
        """By length: rows of (first piece number, first sequence, place); pieces of a row go to successive sequences."""
        out, next_piece, base = {}, [0] * (self.capacity + 1), 0
        for times, lengths in self.groups:
            at = 0
            for n in lengths:
                out.setdefault(n, []).append((next_piece[n], base, at))
                next_piece[n] += times
                at += n
            base += times
        return {n: np.array(rows, np.int64) for n, rows in out.items()}


def pack(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, end_id: int = END_ID,
         path: str | None = None) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Every text gives at least one piece, null and empty ones too; rows with null or repeated keys are packed like any
    other; an empty table gives an empty result; further columns are not read.
    """
    pieces = stored(token_pieces(df, key, text, capacity, end_id, path), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Plan(counts, capacity).places()
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = pieces.join(before, ["length", "part"]).select(
        "key", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("number"))
    out = StructType([f for f in numbered.schema if f.name != "number"]
                     + [StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(batches):
        for batch in batches:
            length, number = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                table = places[int(n)]
                row = table[np.searchsorted(table[:, 0], number[own], "right") - 1]
                sequence[own] = row[:, 1] + number[own] - row[:, 0]
                offset[own] = row[:, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], out.fieldNames())

    return in_arrow(numbered, place, out).withColumnRenamed("key", key)


ship_by_value(__name__)
