"""Conversation trie and importance resampling against brute force."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from evidloom.llm import queries
from evidloom.llm.prefix_trie import conversation_trie, subtree_totals
from evidloom.llm.resampling import importance_resample

DATA = "/root/testdata/sf0.001"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))
    return words, [zlib.crc32(w) % 10000 for w in words] + [zlib.crc32(a + b" " + b) % 10000 for a, b in zip(words, words[1:])]


def resampled(docs, items):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x)[1])
    for x in items:
        t.update(features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for i, x in docs:
        words, found = features(x)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in found]
        weight = sum(gains) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    can = [r for r in rows if r[1] >= 20]
    best = sorted(can, key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))[:25 * len(can) // 100]
    ranks = defaultdict(list)
    for k, r in enumerate(best):
        ranks[r].append(k + 1)
    return sorted(((r[0], *r[2:], ranks[r].pop(0) if ranks[r] else None) for r in rows), key=repr)


@pytest.mark.parametrize("folder", [DATA, "/root/testdata/sf0.01"])
def test_op13_against_brute_force(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [r[0] for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("text").collect()]
    got = queries.QUERIES["op13_importance_resampling"](spark, folder)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == resampled(docs, items)


def test_resampling_of_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, rows without id, ties, clashing columns."""
    words = [f"w{k % 37} É{k % 5}x the THE" for k in range(40)]
    docs = [(k, " ".join(words[k:k + 12])) for k in range(25)] + [(3, " ".join(words[3:15]))] * 3
    docs += [(None, " ".join(words)), (None, " ".join(words)), (50, None), (51, ""), (52, "--- !"), (53, "x" * 300000), (54, "a b " * 60000)]
    rows = [(i, t, 1, 2, "z", 4.0) for i, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int, rank int, c0 string, n_words double")
    items = ["w1 the the W2", None, "", "É1x the"]
    target = spark.createDataFrame([(t,) for t in items], "text string")
    got = importance_resample(df, target)
    assert set(got.columns) == {"doc_id", "c0", "n_words", "n_features", "weight", "score", "rank"}
    got = got.select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted((tuple(r) for r in got), key=repr) == resampled(docs, items)
    none = importance_resample(df.limit(0), target.limit(0))
    assert none.count() == 0


def trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda y: y[:2])] for c, x in own.items()}
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + x[h:]
    members = defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    total = {}
    for k in sorted(members, key=len, reverse=True):
        saved = (len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        total[k] = (sum(total[x][0] for x in kids[k]) if kids[k] else 1, saved + sum(total[x][1] for x in kids[k]))
    out = []
    for k, x in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in x if len(built[c]) == len(k)))
        out.append((min(x), len(k), min(members[k[:-1]]) if k else None, len(x), len(kids[k]), *total[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("folder", [DATA, "/root/testdata/sf0.01"])
def test_op12_against_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op12_prefix_trie"](spark, folder)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == trie(rows)


def test_trie_of_odd_conversations(spark):
    """Null parts, a long chain, many copies, conversations without turns of their own, repeated rows, clashing columns."""
    rows = [(40, k, "user", f"word {k} x") for k in range(90)]
    rows += [(c, k, "user", f"hello {k}") for c in range(100, 160) for k in range(3)]
    rows += [(c, 0, None, None) for c in range(200, 230)] + [(c, 1, "user", "") for c in range(200, 220)]
    rows += [(c, None, "system", " a  b\tc ") for c in range(205, 212)]
    rows += [(c, k, "a", "same") for c in (-41, -40, -3, 0, 7) for k in range(5)]
    rows += [(7, 9, "a", "again"), (7, 9, "a", "again"), (None, 1, "a", "b"), (61, 0, "x", "only"), (63, 0, "x", "only")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, run int, depth int")
    assert sorted((tuple(r) for r in conversation_trie(df).collect()), key=repr) == trie(rows)
    assert conversation_trie(df.limit(0)).collect() == []


def test_contraction_of_a_chain_is_logarithmic(spark):
    n = 700
    tree = spark.range(n).selectExpr(
        "struct(id as conv, id as depth) as node", "case when id > 0 then struct(id - 1 as conv, id - 1 as depth) end as parent", "id as v")
    got = {r[0]: r[1] for r in subtree_totals(tree, ["v"]).select("node.depth", "v").collect()}
    assert got == {k: sum(range(k, n)) for k in range(n)}
