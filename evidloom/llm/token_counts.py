"""Token counts at every prefix of a text, by dynamic programming over the vocabulary.

For a word, the last token of each byte prefix is the only token that ends there and that merges would keep apart from
the last token before it; its count is one more than that of the prefix before. A text's counts are running sums of those
of its words, put right where a prefix splits into other words than the whole text does: inside a contraction, after a
run of blanks, inside the text of a special token. Truncation and budget questions read the stored counts only.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from evidloom.llm.bpe import SPACE, Encoder, Pieces, WordStore, default_tokenizer, encoder, gather
from evidloom.llm.storage import stored
from evidloom.llm.textarrays import buffers
from evidloom.llm.workers import key_and_text, map_slices, worker_state
from evidloom.shipping import ship_by_value

#: pairs of tokens whose compatibility one worker keeps
PAIRS_KEPT = 500_000
#: tokens of a contraction's prefixes where they differ from those of its letters taken as one word
CONTRACTIONS = {"'re": [1, 2, 1], "'ve": [1, 2, 1], "'ll": [1, 2, 1]}


class PrefixCounter:
    """Counts at every code point of texts, by the tokenizer file of ``enc``."""

    def __init__(self, enc: Encoder):
        self.enc, self.ranks = enc, enc.ranks
        self.longest = max(map(len, self.ranks))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.store = WordStore(self.words, np.uint32)

    def _merged(self, data: bytes) -> list[bytes]:
        parts, rank = [data[i:i + 1] for i in range(len(data))], self.ranks.get
        while len(parts) > 1:
            ranks = [rank(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least == 1 << 60:
                break
            at = ranks.index(least)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, before: bytes, token: bytes) -> bool:
        """Whether merging both tokens' bytes gives just these two tokens (or the one token, at the start of a word)."""
        key = before, token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[key] = self._merged(before + token) == ([before, token] if before else [token])
        return known

    def words(self, words: list[str]) -> list[list[int]]:
        """Tokens of each prefix of each word, by code point. In sorted order a word goes on from what it shares."""
        out: list = [None] * len(words)
        coded = [w.encode("utf-8") for w in words]
        before, last, count = b"", [b""], [0]
        ranks, pairs, follows = self.ranks, self.pairs, self._follows
        for at in sorted(range(len(words)), key=coded.__getitem__):
            data = coded[at]
            same, most = 0, min(len(before), len(data))
            while same < most and before[same] == data[same]:
                same += 1
            del last[same + 1:], count[same + 1:]
            for i in range(same + 1, len(data) + 1):
                for j in range(i - 1, max(0, i - self.longest) - 1, -1):
                    token = data[j:i]
                    if token in ranks:
                        known = pairs.get((last[j], token))
                        if known or known is None and follows(last[j], token):
                            last.append(token)
                            count.append(count[j] + 1)
                            break
            before = data
            if words[at] in CONTRACTIONS:
                out[at] = CONTRACTIONS[words[at]]
            elif len(data) == len(words[at]):
                out[at] = count[1:]
            else:
                out[at] = [count[i] for i in range(1, len(data) + 1) if i == len(data) or data[i] & 0xC0 != 0x80]
        return out

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Counts of all prefixes of all texts one after another, and n + 1 offsets (in code points)."""
        pieces = Pieces(column)
        odd = self.enc._special_texts(pieces)
        result = self._plain(pieces)
        for i in odd:
            low, high = pieces.offsets[i], pieces.offsets[i + 1]
            result[low:high] = self._with_special(pieces.text[low:high])
        return result, pieces.offsets

    def _plain(self, pieces: Pieces) -> np.ndarray:
        slot = self.store.slots(pieces)
        begin = self.store.at[slot]
        size = self.store.at[slot + 1] - begin
        inner = gather(self.store.flat, begin, size).astype(np.int64)
        whole = self.store.flat[begin + size - 1].astype(np.int64)
        before = np.cumsum(whole) - whole
        text_base = np.append(before, whole.sum())[pieces.first]
        per_text = np.repeat(text_base[:-1], np.diff(pieces.first))
        inner += np.repeat(before - per_text, size)
        self._blank_runs(pieces, inner)
        return inner

    def _blank_runs(self, pieces: Pieces, counts: np.ndarray) -> None:
        """A prefix that ends with a whole run of blanks has that run as one word."""
        points = np.frombuffer(pieces.text.encode("utf-32-le"), np.uint32)
        blank = worker_state()["classes"][points] == SPACE
        if not blank.any():
            return
        first = np.zeros(len(points) + 1, bool)
        first[pieces.offsets] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], blank.view(np.int8), [0]])))
        for low, high in zip(*(x.tolist() for x in _cut(edge[::2], edge[1::2], np.flatnonzero(first)))):
            if high - low >= 2 and high < len(points) and not first[high]:
                base = 0 if first[low] else counts[low - 1]
                counts[high - 1] = base + self.words([pieces.text[low:high]])[0][-1]

    def _with_special(self, text: str) -> np.ndarray:
        out, done, at, segment = [], 0, 0, 0
        while at <= len(text):
            hit = next((s for s in self.enc.special if text.startswith(s, at)), None)
            if hit is None and at < len(text):
                at += 1
                continue
            part = Pieces(pa.array([text[segment:at]]))
            counts = self._plain(part) + done
            out.append(counts)
            if hit is None:
                break
            cut = int(part.start[-1]) if len(part.start) else 0
            while cut and part.text[cut - 1].isspace():
                cut -= 1
            base = int(counts[cut - 1]) if cut else done
            for k in range(1, len(hit)):
                tail = self._plain(Pieces(pa.array([part.text[cut:] + hit[:k]])))
                out.append(np.array([base + tail[-1]]))
            done = (int(counts[-1]) if len(counts) else done) + 1
            out.append(np.array([done]))
            at = segment = at + len(hit)
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _cut(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges, cut where a text begins inside one."""
    inside = np.searchsorted(at, low, "right") != np.searchsorted(at, high, "left")
    if not inside.any():
        return low, high
    more = at[np.searchsorted(low, at, "right") - 1 >= 0]
    k = np.searchsorted(low, more, "right") - 1
    more = more[(more > low[k]) & (more < high[k])]
    return np.sort(np.append(low, more)), np.sort(np.append(high, more))


def prefix_counter(path: str) -> PrefixCounter:
    state = worker_state()
    if ("prefixes", path) not in state:
        state["prefixes", path] = PrefixCounter(encoder(path))
    return state["prefixes", path]


def packed(counts: np.ndarray) -> bytes:
    """Steps from each count to the next, in one byte each, or in four behind a first byte of 4 where one is too large."""
    steps = np.diff(counts, prepend=0)
    if not len(steps):
        return b""
    small = steps.min() >= -128 and steps.max() <= 127
    return b"\x01" + steps.astype("i1").tobytes() if small else b"\x04" + steps.astype("<i4").tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    """The counts of ``packed``."""
    return np.cumsum(np.frombuffer(blob, "i1" if blob[:1] == b"\x01" else "<i4", offset=min(1, len(blob))), dtype=np.int64)


def prefix_counts(df: DataFrame, key: str, text: str, path: str | None = None, store: bool = True) -> DataFrame:
    """(key, n_bytes, n_tokens, prefix) of every whole text.

    ``prefix`` holds the counts at all code points, as ``packed``; it is left out with ``store=False``. A null or
    empty text has no bytes, no tokens and an empty ``prefix``; rows with null or repeated keys give a row each; further
    columns are not read. ``path`` names the tokenizer file, present on every executor.
    """
    path = path or default_tokenizer()
    rows = key_and_text(df, key, text)

    def step(batch):
        column = batch.column(1)
        counts, offsets = prefix_counter(path).counts(column)
        _, byte_offsets = buffers(column)
        totals = np.append(counts, 0)[offsets[1:] - 1] * (np.diff(offsets) > 0)
        out = {"key": batch.column(0), "n_bytes": np.diff(byte_offsets), "n_tokens": totals.astype(np.int64)}
        if store:
            out["prefix"] = pa.array([packed(counts[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
        return out

    fields = [StructField("key", rows.schema["key"].dataType), StructField("n_bytes", LongType()),
              StructField("n_tokens", LongType())] + [StructField("prefix", BinaryType())] * store
    return map_slices(rows, "text", step, StructType(fields)).withColumnRenamed("key", key)


def stored_counts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, n_bytes, n_tokens, prefix) read back from a table in the shared folder; n_tokens is the last stored count."""
    @F.pandas_udf("long")
    def total(prefix):
        return prefix.map(lambda blob: int(unpacked(blob)[-1]) if blob else 0).astype("int64")

    table = stored(prefix_counts(df, key, text, path).drop("n_tokens"), "prefixes")
    return table.select(key, "n_bytes", total("prefix").alias("n_tokens"), "prefix")


def truncation_points(counted: DataFrame, budget: int) -> DataFrame:
    """Adds ``keep_chars``: code points of the longest prefix of at most ``budget`` tokens, from the stored counts."""
    @F.pandas_udf("long")
    def longest(prefix):
        def one(blob):
            fits = np.flatnonzero(unpacked(blob) <= budget)
            return int(fits[-1]) + 1 if len(fits) else 0
        return prefix.map(one)

    return counted.withColumn("keep_chars", longest("prefix"))


ship_by_value(__name__)
