"""Token ids of text slices with the byte-level tokenizer file, shared by the token operators.

Words are found on the code points of a whole slice at once, and each distinct word is merged once and kept by the worker;
a document's ids are those of its words in order, since merges never cross a word. A word is merged by ``tiktoken`` over
the vocabulary of the tokenizer file, which is several times quicker for single words than ``tokenizers``; documents that
hold the text of a special token go through ``tokenizers`` whole. Tests hold the ids to those of ``tokenizers``.
"""
from __future__ import annotations

import itertools
import json
import os

import numpy as np
import pyarrow as pa

from evidloom.llm.textarrays import _powers, buffers, mix
from evidloom.llm.workers import worker_state
from evidloom.shipping import ship_by_value

#: words whose ids one worker keeps; beyond it the store starts anew
WORDS_KEPT = 200_000
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _classes() -> np.ndarray:
    """Class of each code point, from the regex library's Unicode tables."""
    import regex
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4").tobytes().decode("utf-32-le")
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, points):
            low, high = ord(points[m.start()]), ord(points[m.end() - 1])
            table[low:high + 1] = value
    table[0xD800:0xE000] = OTHER
    return table


class Pieces:
    """Words of the byte-level pattern in a slice: start of each in code points, hash, and the first word of each text."""

    def __init__(self, column: pa.Array):
        state = worker_state()
        if "classes" not in state:
            state["classes"] = _classes()
            with np.errstate(over="ignore"):
                state["point_value"] = mix(np.arange(1, 0x110001, dtype=np.uint64) * _MUL)
        data, offsets = buffers(column)
        self.text = data.tobytes().decode("utf-8")
        points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        n = len(points)
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        self.offsets = lead[offsets]
        kind = state["classes"][points]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        edge[n] = True
        change = edge[:-1].copy()
        change[1:] |= kind[1:] != kind[:-1]
        blank = points == 32
        joined = np.zeros(n, bool)  # a blank before it belongs to it
        joined[1:] = change[1:] & ~edge[1:-1] & (kind[1:] != SPACE) & blank[:-1]
        start = change & ~joined
        last_space = np.zeros(n, bool)
        last_space[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:-1]
        start |= last_space
        self._contractions(points, kind, edge, change, joined, start)
        self.start = np.flatnonzero(start)
        self.end = np.append(self.start[1:], n)
        self.first = np.searchsorted(self.start, self.offsets)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(state["point_value"][points] * _powers(n, _MUL), out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * _powers(n + 1, _INV)[self.start]
                            + (self.end - self.start).astype(np.uint64))

    @staticmethod
    def _contractions(points, kind, edge, change, joined, start) -> None:
        """An apostrophe alone between words takes s, t, m, d, re, ve or ll after it."""
        n = len(points)
        at = np.flatnonzero((points == 39) & change & ~joined)
        at = at[at + 1 < n]
        at = at[(kind[at + 1] == LETTER) & ~edge[at + 1]]
        if not len(at):
            return
        one, two = points[at + 1], points[np.minimum(at + 2, n - 1)]
        has_two = (at + 2 < n) & ~edge[np.minimum(at + 2, n)]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = has_two & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e")))
                            | ((one == ord("l")) & (two == ord("l"))))
        hit = single | double
        start[at[hit] + 1] = False
        after = np.where(single, at + 2, at + 3)[hit]
        after = after[after < n]
        start[after[~edge[after] & (kind[after] == LETTER)]] = True

    def words(self, which: np.ndarray) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist())]


class WordStore:
    """Values of distinct words as one flat array with offsets, looked up by word hash; arrays only, to stay small."""

    def __init__(self, compute, dtype, kept: int | None = None):
        """Without ``kept`` it holds WORDS_KEPT words; with it, so many words, and eight values for each of them."""
        self.compute, self.dtype, self.kept = compute, dtype, kept
        self.clear()

    def clear(self) -> None:
        self.keys, self.place, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        self.flat = np.zeros(1 << 16, self.dtype)
        self.at = np.zeros(1 << 14, np.int64)

    def _add(self, hashes: np.ndarray, values: list | tuple[np.ndarray, np.ndarray]) -> None:
        """Values as a list for each word, or as one array and the number for each word."""
        if isinstance(values, tuple):
            values, sizes = values
        else:
            sizes = np.fromiter(map(len, values), np.int64, len(values))
            values = np.fromiter(itertools.chain.from_iterable(values), self.dtype, int(sizes.sum()))
        used, n = int(self.at[self.count]), self.count
        need = used + int(sizes.sum())
        while len(self.flat) < need:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.at) < n + len(sizes) + 1:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[used:need] = values
        self.at[n + 1:n + 1 + len(sizes)] = used + np.cumsum(sizes)
        self.count = n + len(sizes)
        where = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, where, hashes)
        self.place = np.insert(self.place, where, np.arange(n, self.count))

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        where = np.searchsorted(self.keys, hashes)
        found = where < len(self.keys)
        found[found] = self.keys[where[found]] == hashes[found]
        return found

    def slots(self, pieces: Pieces) -> np.ndarray:
        """Slot of each word of the slice."""
        import pandas as pd
        inverse, unique = pd.factorize(pieces.hash)
        first = np.zeros(len(unique), np.int64)
        first[inverse] = np.arange(len(inverse))
        order = np.argsort(unique)
        unique, first = unique[order], first[order]
        rank = np.zeros_like(order)
        rank[order] = np.arange(len(order))
        if self.count + len(unique) > (self.kept or WORDS_KEPT) or (self.kept and self.at[self.count] > 8 * self.kept):
            self.clear()
        missing = np.flatnonzero(~self._known(unique))
        for low in range(0, len(missing), 10_000):
            some = missing[low:low + 10_000]
            self._add(unique[some], self.compute(pieces.words(first[some])))
        return self.place[np.searchsorted(self.keys, unique)][rank][inverse]


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges [start, start + size) of ``flat`` one after another."""
    total = int(size.sum())
    step = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    return flat[np.repeat(start, size) + step]


def vocabulary(spec: dict) -> dict[bytes, int]:
    """Bytes of each token; the file writes a byte as a printable character, and ids follow the order of merges."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}


class Encoder:
    """Ids by the tokenizer file at ``path``, as tokenizers gives them without added special tokens."""

    def __init__(self, path: str, kept: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ranks = vocabulary(spec)
        import tiktoken
        #: whether the zero character can stand between words: it is a token, and no other token holds it
        self.joins = b"\0" in self.ranks and sum(b"\0" in t for t in self.ranks) == 1
        self.merge = tiktoken.Encoding("words", pat_str=r"[^\x00]+|\x00" if self.joins else r"(?s:.+)",
                                       mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
        self.store = WordStore(self.merged, np.uint32, kept)

    def merged(self, words: list[str]) -> list | tuple[np.ndarray, np.ndarray]:
        """Ids of each word; words go through the merges as one text with a zero character after each."""
        text = "\0".join([*words, ""])
        if not self.joins or text.count("\0") > len(words):
            return list(map(self.merge, words))
        ids = np.array(self.merge(text), np.uint32)
        end = ids == self.ranks[b"\0"]
        return ids[~end], np.diff(np.flatnonzero(end) - np.arange(len(words)), prepend=0)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice one after another, and n + 1 offsets; null texts are empty."""
        pieces = Pieces(column)
        slot = self.store.slots(pieces)
        begin = self.store.at[slot]
        size = self.store.at[slot + 1] - begin
        ids = gather(self.store.flat, begin, size)
        ends = np.append(0, np.cumsum(size))
        offsets = ends[pieces.first]
        odd = self._special_texts(pieces)
        return self._replaced(ids, offsets, pieces, odd) if odd else (ids, offsets)

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        pieces = Pieces(column)
        slot = self.store.slots(pieces)
        ends = np.append(0, np.cumsum(self.store.at[slot + 1] - self.store.at[slot]))
        found = np.diff(ends[pieces.first])
        for i in self._special_texts(pieces):
            text = pieces.text[pieces.offsets[i]:pieces.offsets[i + 1]]
            found[i] = len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return found

    def _special_texts(self, pieces: Pieces) -> list[int]:
        if not any(s in pieces.text for s in self.special):
            return []
        bounds = pieces.offsets.tolist()
        return [i for i in range(len(bounds) - 1)
                if any(s in pieces.text[bounds[i]:bounds[i + 1]] for s in self.special)]

    def _replaced(self, ids, offsets, pieces, odd):
        parts, bounds = np.split(ids, offsets[1:-1]), pieces.offsets
        for i in odd:
            text = pieces.text[bounds[i]:bounds[i + 1]]
            parts[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))


def encoder(path: str, kept: int | None = None) -> Encoder:
    """The worker's encoder for a tokenizer file, which keeps the ids of ``kept`` words (WORDS_KEPT without it)."""
    state = worker_state()
    if ("encoder", path, kept) not in state:
        state["encoder", path, kept] = Encoder(path, kept)
    return state["encoder", path, kept]


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


ship_by_value(__name__)
ship_by_value("evidloom.llm.textarrays")
