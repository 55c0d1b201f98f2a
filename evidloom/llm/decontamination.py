"""Benchmark passages inside documents, by multi-pattern search over words with block shift tables.

Patterns are the windows of ten words of the benchmark's items. A block is two successive words. For each block the shift
table says how far the search may move on without passing an occurrence; where the shift is nought, the bucket of the
block names the patterns that end with it, and these are compared word by word. All texts of a slice are searched in
lanes that move on together.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidloom.llm.columns import carried
from evidloom.llm.textarrays import LOWER, Words, buffers, mix, separators
from evidloom.llm.workers import in_arrow, slices
from evidloom.shipping import ship_by_value

#: everything but digits, letters a-z and bytes of other scripts separates words (A-Z are lower-cased before)
SEPARATOR = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
WINDOW = 10
#: words that one search lane covers
LANE = 256
#: windows of one set of tables; a larger benchmark is searched set by set
WINDOWS_PER_SET = 1_000_000
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _pairs(word: np.ndarray) -> np.ndarray:
    """Hash of the block of each word with the one before it; the first has none."""
    out = np.zeros(len(word), np.uint64)
    with np.errstate(over="ignore"):
        out[1:] = mix(word[:-1] * _MUL + word[1:])
    return out


class PatternTables:
    """Shift table, buckets and patterns of one length (in words)."""

    def __init__(self, words: np.ndarray, items: np.ndarray):
        """``words``: one row of word hashes for each pattern; ``items``: index of its item."""
        self.length = words.shape[1]
        order = np.lexsort(words.T[::-1])
        words, items = words[order], items[order]
        new = np.ones(len(words), bool)
        new[1:] = (words[1:] != words[:-1]).any(axis=1)
        self.items = np.split(items, np.flatnonzero(new)[1:])
        self.words = words[new]
        size = self.length
        if size == 1:
            block, shift = mix(self.words[:, 0]), np.zeros(len(self.words), np.int64)
        else:
            ends = np.arange(1, size)
            with np.errstate(over="ignore"):
                block = mix(self.words[:, :-1] * _MUL + self.words[:, 1:]).ravel()
            shift = np.tile(size - 1 - ends, len(self.words))
        self.most = max(1, size - 1)
        order = np.lexsort((shift, block))
        block, shift = block[order], shift[order]
        least = np.ones(len(block), bool)
        least[1:] = block[1:] != block[:-1]
        self.block, self.shift = block[least], shift[least]
        last = mix(self.words[:, -1]) if size == 1 else self._last_blocks()
        self.bucket_order = np.argsort(last, kind="stable")
        self.bucket_block = last[self.bucket_order]

    def _last_blocks(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(self.words[:, -2] * _MUL + self.words[:, -1])

    def search(self, word: np.ndarray, block: np.ndarray, low: np.ndarray, high: np.ndarray):
        """(position, pattern) of all occurrences; position is the last word. Texts are the word ranges [low, high)."""
        size = self.length
        begin, end = low + size - 1, high
        lanes = np.maximum(0, -(-(end - begin) // LANE))
        which = np.repeat(np.arange(len(low)), lanes)
        step = np.arange(len(which)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = begin[which] + step * LANE
        stop = np.minimum(at + LANE, end[which])
        found_at, found = [], []
        while len(at):
            here = block[at]
            k = np.minimum(np.searchsorted(self.block, here), len(self.block) - 1)
            known = self.block[k] == here
            shift = np.where(known, self.shift[k], self.most)
            hit = at[shift == 0]
            if len(hit):
                a, b = self._compare(word, block, hit)
                found_at.append(a)
                found.append(b)
            at = at + np.maximum(shift, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_at), np.concatenate(found)

    def _compare(self, word, block, at):
        """Patterns in the bucket of the block at each position that agree in every word."""
        left = np.searchsorted(self.bucket_block, block[at], "left")
        count = np.searchsorted(self.bucket_block, block[at], "right") - left
        where = np.repeat(at, count)
        slot = np.repeat(left, count) + np.arange(len(where)) - np.repeat(np.cumsum(count) - count, count)
        pattern = self.bucket_order[slot]
        for k in range(self.length - 1, -1, -1):
            same = word[where - (self.length - 1 - k)] == self.words[pattern, k]
            where, pattern = where[same], pattern[same]
        return where, pattern


class Benchmark:
    """Tables for every pattern length of a set of items."""

    def __init__(self, ids: list[str], texts: pa.Array, size: int):
        self.ids, self.size = ids, size
        data, offsets = buffers(texts)
        words = Words(data, offsets, SEPARATOR)
        rows: dict[int, list] = {}
        for item, (x, y) in enumerate(zip(words.first[:-1], words.first[1:])):
            n = min(size, y - x)
            for k in range(x, y - n + 1 if n else x):
                rows.setdefault(n, []).append((words.hash[k:k + n], item))
        self.tables = [PatternTables(np.array([r[0] for r in some], np.uint64), np.array([r[1] for r in some]))
                       for some in rows.values()]

    def hits(self, words: Words):
        """Word flags of the slice, and the item indexes found in each text."""
        hit = np.zeros(len(words.hash) + 1, np.int64)
        pairs = []
        low, high = words.first[:-1], words.first[1:]
        for table in self.tables:
            block = mix(words.hash) if table.length == 1 else _pairs(words.hash)
            at, pattern = table.search(words.hash, block, low, high)
            if len(at):
                np.add.at(hit, at - table.length + 1, 1)
                np.add.at(hit, at + 1, -1)
                text = words.doc[at]
                key = np.unique(text * len(table.words) + pattern)
                for t, p in zip((key // len(table.words)).tolist(), (key % len(table.words)).tolist()):
                    pairs += [(t, i) for i in table.items[p].tolist()]
        return np.cumsum(hit)[:-1] > 0, set(pairs)


def benchmark_sets(benchmark: DataFrame, item: str, text: str, size: int) -> list[bytes]:
    """The benchmark as compressed tables of bounded size; the driver holds one set at a time while it builds them."""
    import pickle
    import zlib
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{text}`").cast("string").alias("t"))
    out, ids, texts, n = [], [], [], 0

    def close():
        if ids:
            out.append(zlib.compress(pickle.dumps((list(ids), pa.array(texts, pa.string()), size)), 1))
            ids.clear()
            texts.clear()

    for r in rows.where("i is not null and t is not null").toLocalIterator(prefetchPartitions=False):
        ids.append(r["i"])
        texts.append(r["t"])
        n += r["t"].count(" ") + 1
        if n >= WINDOWS_PER_SET:
            close()
            n = 0
    close()
    return out


def with_benchmark_hits(df: DataFrame, text: str, benchmark: DataFrame, item: str = "item_id",
                        item_text: str = "text", size: int = WINDOW, prefix: str = "") -> DataFrame:
    """``df`` with n_words, n_hit, n_items, items_sha256 and contaminated (names after ``prefix``); nothing is shuffled.

    A null or empty text has no words and no hits; an empty benchmark hits nothing; items without words or without id are ignored;
    items of one id count once; added columns replace columns of the same name. A benchmark beyond WINDOWS_PER_SET
    windows is searched in several sets, one after another for each slice of texts, so that one set's tables are in memory.
    """
    import pickle
    import zlib
    sets = [df.sparkSession.sparkContext.broadcast(s) for s in benchmark_sets(benchmark, item, item_text, size)]
    names = [f"{prefix}{n}" for n in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]
    types = ["long", "long", "long", "string", "boolean"]
    source = carried(df, names, F.col(f"`{text}`").cast("string").alias("text"))
    schema = StructType([source.schema["row"]])
    for k, t in enumerate(types):
        schema = schema.add(f"v{k}", t)

    def run(batches):
        import pyarrow.compute  # noqa: F401
        tables = []

        def load(one):
            return Benchmark(*pickle.loads(zlib.decompress(one.value)))

        for batch in batches:
            if len(sets) == 1 and not tables:
                tables = [load(sets[0])]
            for part in slices(batch, "text"):
                words = Words(*buffers(part.column(1)), SEPARATOR)
                hit, found = np.zeros(len(words.hash), bool), [set() for _ in range(part.num_rows)]
                for table in tables or map(load, sets):
                    flags, pairs = table.hits(words)
                    hit |= flags
                    for t, i in pairs:
                        found[t].add(table.ids[i])
                total = np.append(0, np.cumsum(hit))
                n_hit = total[words.first[1:]] - total[words.first[:-1]]
                digests = [hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for s in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words.count.astype(np.int64)), pa.array(n_hit.astype(np.int64)),
                     pa.array([len(s) for s in found], pa.int64()), pa.array(digests, pa.string()),
                     pa.array(n_hit > 0)], schema.fieldNames())

    return in_arrow(source, run, schema).select("row.*", *[F.col(f"v{k}").alias(n) for k, n in enumerate(names)])


ship_by_value(__name__)
