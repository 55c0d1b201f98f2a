"""Toxicity by a lexicon of terms and stems, misspellings of them, and the words around each hit.

The lexicon is learned from a bounded sample of labelled documents: a greedy cover of the toxic ones by words and word
beginnings (stems) that clean ones seldom hold. Its trie is intersected with Levenshtein automata of all words within
EDITS edits of an entry, as one deterministic automaton, which reads all words of a slice at once. Each hit weighs as much
as its entry and number of edits tell of toxicity in the sample; quotation marks, reporting words and forms of address
around it separate quotation from abuse. A logistic regression over the sums of a text gives its score.
"""
from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidloom.llm.textarrays import buffers
from evidloom.llm.workers import give_back, in_arrow, slices
from evidloom.shipping import ship_by_value

#: labelled documents of each class that the model is fitted on at most, and bytes of their texts; a text of more than a
#: hundredth of these bytes isn't taken into the sample (it is scored like any other)
SAMPLE_ROWS, SAMPLE_BYTES = 2_500, 16_000_000
#: entries of the lexicon at most, letters of a stem, letters of an entry, edits of a misspelling
ENTRIES, STEM, LONGEST, EDITS = 96, (4, 8), 32, 1
#: least letters of a word and of a stem that may be misspelled; a lexicon entry's least log odds and share of toxic texts
EDIT_WORD, EDIT_STEM, LEAST_ODDS, LEAST_SHARE = 5, 6, 1.5, 0.004
WINDOW, LINE = 6, 400
REPORTING = {"said", "says", "wrote", "writes", "called", "quoted", "quote", "word", "term", "allegedly", "reported", "sagte",
             "schrieb", "nannte", "wort", "dit", "écrit", "appelé", "mot", "dijo", "escribió", "llamó", "palabra"}
ADDRESS = {"you", "your", "youre", "u", "du", "dich", "dein", "ihr", "tu", "te", "toi", "vous", "eres", "usted", "tú"}
HITS = "array<struct<term:string,start:int,end:int,edits:int,quoted:double>>"


def _point_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case, and whether it belongs to a word, of each code point of the first plane."""
    low, word = np.arange(65536, dtype=np.uint32), np.zeros(65536, bool)
    for k in range(65536):
        c = chr(k)
        word[k] = c.isalnum()
        small = c.lower()
        if len(small) == 1:
            low[k] = ord(small)
    return np.minimum(low, 65535), word


_TABLES: list = []


class PointWords:
    """Code points of a slice in lower case, and the range and text of each word."""

    def __init__(self, column: pa.Array):
        if not _TABLES:
            _TABLES.extend(_point_tables())
        low, is_word = _TABLES
        data, offsets = buffers(column)
        self.text = data.tobytes().decode("utf-8", "replace")
        raw = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        self.offsets = begins[offsets]
        self.points = low[np.minimum(raw, 65535)]
        inside = is_word[np.minimum(raw, 65535)] & (raw < 65536)
        edge = np.zeros(len(raw) + 1, bool)
        edge[self.offsets] = True
        first, last = inside.copy(), inside.copy()
        if len(raw):
            first[1:] &= ~inside[:-1] | edge[1:-1]
            last[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)

    def word(self, k: int) -> str:
        return self.text[self.start[k]:self.end[k]].lower()


class Automaton:
    """All words within ``edits`` edits of an entry, as one table; a stem takes any word that begins like it."""

    def __init__(self, entries: list[tuple[str, bool]], edits: int = EDITS):
        self.entries, self.edits = entries, edits
        self.limit = [edits if len(t) >= (EDIT_STEM if stem else EDIT_WORD) else 0 for t, stem in entries]
        children, ends, stems = [{}], {}, {}
        for k, (text, stem) in enumerate(entries):
            node = 0
            for c in text:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                node = children[node][c]
            (stems if stem else ends)[node] = k
        letters = sorted({c for t, _ in entries for c in t if ord(c) < 65536})
        self.klass = np.zeros(65536, np.int32)
        for k, c in enumerate(letters):
            self.klass[ord(c)] = k + 1
        self._grow(children, ends, stems, letters)

    def _grow(self, children, ends, stems, letters) -> None:
        def closed(pairs):
            best = {}
            todo = list(pairs)
            while todo:
                node, left = todo.pop()
                if best.get(node, -1) >= left:
                    continue
                best[node] = left
                if left:
                    todo += [(child, left - 1) for child in children[node].values()]
            return frozenset(best.items())

        def found(state, table, before):
            out = before
            for node, left in state:
                if node in table and self.edits - left <= self.limit[table[node]]:
                    hit = (self.edits - left, table[node])
                    out = hit if out is None else min(out, hit)
            return out

        def named(state, before):
            key = (state, found(state, stems, before))
            if key not in number:
                number[key] = len(order)
                order.append(key)
            return number[key]

        number, order, rows = {}, [], []
        named(frozenset(), None)
        self.begin = named(closed([(0, self.edits)]), None)
        for at, (state, best) in enumerate(order):
            after = {}
            wild = [p for node, left in state if left
                    for p in [(node, left - 1), *[(child, left - 1) for child in children[node].values()]]]
            row = [named(closed(wild), best) if state else at]
            for c in letters:
                if not state:
                    row.append(at)
                    continue
                step = wild + [(children[node][c], left) for node, left in state if c in children[node]]
                key = frozenset(step)
                if key not in after:
                    after[key] = named(closed(step), best)
                row.append(after[key])
            rows.append(row)
        self.table = np.array(rows, np.int32)
        hits = [found(state, ends, best) for state, best in order]
        self.term = np.array([-1 if h is None else h[1] for h in hits], np.int32)
        self.used = np.array([0 if h is None else h[0] for h in hits], np.int32)
        self.live = np.array([bool(state) for state, _ in order])

    def search(self, words: PointWords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that are hits, with the entry and the edits of each."""
        state = np.full(len(words.start), self.begin, np.int32)
        place = words.start.copy()
        active = np.arange(len(state))
        while len(active):
            now = self.table[state[active], self.klass[words.points[place[active]]]]
            state[active] = now
            place[active] += 1
            active = active[self.live[now] & (place[active] < words.end[active])]
        at = np.flatnonzero(self.term[state] >= 0)
        return at, self.term[state[at]], self.used[state[at]]


def quotation(words: PointWords, at: int, low: int, high: int) -> float:
    """0 (abuse) to 1 (quoted): quotation marks open in the line before the word, reporting words and forms of address near it."""
    start = int(words.start[at])
    line = words.text[max(int(words.offsets[low]), start - LINE):start].rpartition("\n")[2]
    marked = line.count('"') % 2 == 1 or any(line.count(a) > line.count(b) for a, b in ("“”", "«»", "„“"))
    first, last = words.first[low], words.first[high]
    near = {words.word(k) for k in range(max(first, at - WINDOW), min(last, at + WINDOW + 1)) if k != at}
    return max(0.0, 0.7 * marked + 0.3 * bool(near & REPORTING) - 0.3 * bool(near & ADDRESS))


class ToxicModel:
    """Automaton, weight of every entry by its edits, and the regression; without an entry the score is ``base``."""

    def __init__(self, base: float = 0.0):
        self.base, self.automaton = base, None

    def hits(self, words: PointWords) -> tuple:
        """Text, entry, edits, word and quotation of each hit."""
        at, term, used = self.automaton.search(words)
        doc = np.searchsorted(words.first, at, "right") - 1
        quoted = np.array([quotation(words, k, d, d + 1) for k, d in zip(at.tolist(), doc.tolist())], float)
        return doc, term, used, at, quoted

    def sums(self, words: PointWords, hits: tuple) -> np.ndarray:
        doc, term, used, _, quoted = hits
        n = len(words.count)
        weight = self.weight[term, used]
        abuse = np.bincount(doc, weight * (1 - 0.9 * np.minimum(quoted, 1)), n)
        exact = np.unique(doc[used == 0] * len(self.automaton.entries) + term[used == 0]) // max(1, len(self.automaton.entries))
        return np.stack([np.log1p(abuse), np.log1p(100 * abuse / np.maximum(words.count, 1)), np.minimum(np.bincount(exact, minlength=n), 4),
                         np.log1p(np.bincount(doc, weight * quoted, n))], 1)

    def fit(self, texts: list[str], labels: list[int], share: float) -> ToxicModel:
        """``share``: toxic among all labelled documents that may be learned from."""
        seen = dict(zip(texts, labels))
        texts, y = list(seen), np.array(list(seen.values()), float)
        entries = lexicon([t for t, v in seen.items() if v], [t for t, v in seen.items() if not v])
        if not entries:
            return self
        self.automaton = Automaton(entries)
        words = PointWords(pa.array(texts, pa.string()))
        hits = self.hits(words)
        self.weight = self._weights(hits, y)
        x = self.sums(words, hits)
        self.middle, self.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        x = np.column_stack([(x - self.middle) / self.scale, np.ones(len(x))])
        beta, ridge = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
            beta += np.clip(step, -2, 2)
        rate, share = np.clip([y.mean(), share], 1e-6, 1 - 1e-6)
        self.beta, self.bias = beta[:-1], beta[-1] + math.log(share / (1 - share)) - math.log(rate / (1 - rate))
        return self

    def _weights(self, hits: tuple, y: np.ndarray) -> np.ndarray:
        """Log odds of a text with an exact hit; of one with a misspelling, drawn to half of it where such texts are few."""
        doc, term, used, _, _ = hits
        out = np.zeros((len(self.automaton.entries), EDITS + 1))
        toxic, clean = y.sum(), len(y) - y.sum()
        for k in range(len(out)):
            for e in range(EDITS + 1):
                some = np.unique(doc[(term == k) & (used == e)])
                t = y[some].sum()
                odds = math.log((t + 0.5) / (toxic + 1)) - math.log((len(some) - t + 0.5) / (clean + 1))
                if e:
                    odds = (len(some) * odds + 4 * out[k, 0] / 2) / (len(some) + 4)
                out[k, e] = min(max(odds, 0.0), out[k, 0] if e else 20.0)
        return out

    def score(self, column: pa.Array) -> tuple[np.ndarray, list]:
        """Score of each text, and its hits."""
        if self.automaton is None:
            return np.full(len(column), self.base), [[] for _ in range(len(column))]
        words = PointWords(column)
        hits = self.hits(words)
        z = (self.sums(words, hits) - self.middle) / self.scale @ self.beta + self.bias
        spans = [[] for _ in range(len(column))]
        for d, t, e, at, q in zip(*(h.tolist() for h in hits)):
            low = int(words.offsets[d])
            spans[d].append({"term": self.automaton.entries[t][0], "start": int(words.start[at]) - low,
                             "end": int(words.end[at]) - low, "edits": e, "quoted": q})
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), spans


def _pieces(text: str) -> set:
    """Words (marked by a final $) and beginnings of words of a text."""
    words = {w for w in re.findall(r"[^\W_]+", text.lower()) if len(w) >= STEM[0]}
    return {w + "$" for w in words if len(w) <= LONGEST} | {w[:n] for w in words for n in range(STEM[0], min(STEM[1], len(w)) + 1)}


def lexicon(toxic: list[str], clean: list[str], most: int = ENTRIES) -> list[tuple[str, bool]]:
    """(entry, is a stem): a greedy cover of the toxic texts, two entries each where there are, by entries with high log odds."""
    least = max(3, math.ceil(LEAST_SHARE * len(toxic)))
    counts = Counter()
    for t in toxic:
        counts.update(_pieces(t))
    known = {p: n for p, n in counts.items() if n >= least}
    del counts
    others = Counter()
    for t in clean:
        others.update(p for p in _pieces(t) if p in known)
    odds = {p: math.log((n + 0.5) / (len(toxic) + 1)) - math.log((others[p] + 0.5) / (len(clean) + 1)) for p, n in known.items()}
    names = sorted((p for p, v in odds.items() if v >= LEAST_ODDS), key=lambda p: (-len(p), p))
    if not names:
        return []
    place = {p: k for k, p in enumerate(names)}
    holds = np.zeros((len(names), len(toxic)), bool)
    for d, t in enumerate(toxic):
        holds[[place[p] for p in _pieces(t) if p in place], d] = True
    value, free = np.array([odds[p] for p in names]), np.ones(len(names), bool)
    cover, chosen = np.zeros(len(toxic), int), []
    while len(chosen) < most:
        left = holds[:, cover < 2].sum(1)
        gain = np.where(free & (left >= least), left * value, 0)
        k = int(gain.argmax())
        if gain[k] <= 0:
            break
        cover += holds[k]
        text = names[k].rstrip("$")
        chosen.append((text, not names[k].endswith("$")))
        free &= np.array([not (p.rstrip("$").startswith(text) or text.startswith(p.rstrip("$"))) for p in names])
    return chosen


def held_out(key: str) -> Column:
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> ToxicModel:
    """Fitted on at most ``rows`` documents of each class and ``size`` bytes of text, chosen by a hash of the id.

    Only ids that aren't held out are taken. A document with both labels is toxic. With labels of one class, or none, the
    model has no entry, and its score is the share of toxic documents, 0 without labels.
    """
    known = (labels.select(F.col("doc_id").alias("k"), F.col("toxic").cast("int").alias("y")).where("k is not null and y in (0, 1)")
             .where(~held_out("k")).groupBy("k").agg(F.max("y").alias("y")))
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = total.get(1, 0) / max(1, sum(total.values()))
    some = None
    for y in (0, 1):
        one = known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(rows)
        some = one if some is None else some.union(one)
    texts = documents.select(F.col("doc_id").alias("k"), F.col("text").cast("string").alias("t")).where(
        F.octet_length("t") <= size // 100)
    got, left = [], size
    for r in texts.join(F.broadcast(some), "k").select("t", "y", F.xxhash64("k").alias("o")).orderBy("o", "t").toLocalIterator():
        left -= len(r["t"].encode())
        if left < 0:
            break
        got.append((r["t"], r["y"]))
    model = ToxicModel(share)
    if len({y for _, y in got}) == 2:
        model.fit([t for t, _ in got], [y for _, y in got], share)
    del got
    give_back()
    return model


def with_toxicity(df: DataFrame, text: str, model: ToxicModel, score: str = "score", hits: str = "hits") -> DataFrame:
    """``df`` with the chance that a whole text is toxic, and its hits: entry, code points, edits, quotation.

    A null or empty text has no hits and the score of a text without any. Columns named like ``score`` or ``hits`` are
    replaced; nothing is shuffled.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c not in (score, hits)]
    inner = [f"c{k}" for k in range(len(kept))]
    source = df.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(kept, inner)], F.col(f"`{text}`").cast("string").alias("text"))
    schema = StructType([source.schema[i] for i in inner]).add("score", "double").add("hits", StructType.fromDDL(f"h {HITS}")["h"].dataType)
    spans = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32()),
                                ("quoted", pa.float64())]))

    def run(batches):
        import pyarrow.compute  # noqa: F401
        for batch in batches:
            for part in slices(batch, "text"):
                value, found = sent.value.score(part.column(len(inner)))
                yield pa.RecordBatch.from_arrays([*part.columns[:len(inner)], pa.array(value), pa.array(found, spans)],
                                                 schema.fieldNames())

    out = in_arrow(source, run, schema)
    return out.select(*[F.col(i).alias(c) for c, i in zip(kept, inner)], F.col("score").alias(score), F.col("hits").alias(hits))


ship_by_value(__name__)
