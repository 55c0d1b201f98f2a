"""Toxicity: the automaton against edit distances, held-out accuracy, context, odd rows."""
import random
import zlib

import pyarrow as pa

from evidloom.llm import queries, toxicity
from evidloom.llm.toxicity import Automaton, PointWords, ToxicModel, quotation, with_toxicity

DATA = "/root/testdata/sf0.1"
TERMS = [("stupid", False), ("stump", False), ("idiot", False), ("scum", False), ("réeuxa", True), ("loweis", True), ("chón", True)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row


def expected(word):
    """Least edits over all entries that allow them; a stem is compared with every beginning of the word."""
    best = None
    for text, stem in TERMS:
        most = 1 if len(text) >= (6 if stem else 5) else 0
        row = [distance(word[:k], text)[-1] for k in range(len(word) + 1)] if stem else [distance(word, text)[-1]]
        if min(row) <= most:
            best = min(row) if best is None else min(best, min(row))
    return best


def test_automaton_equals_edit_distance():
    rng = random.Random(5)
    letters = "stupidmocréeuxalwnhóz"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    for text, _ in TERMS:
        for _ in range(300):
            w = list(text + "".join(rng.choice(letters) for _ in range(rng.randint(0, 2))))
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w) + 1)
                w[k:k + rng.randint(0, 1)] = [rng.choice(letters)] * rng.randint(0, 1)
            words.append("".join(w) or "x")
    found = PointWords(pa.array(words))
    at, _, used = Automaton(TERMS).search(found)
    got = dict(zip(at.tolist(), used.tolist()))
    assert {k: got.get(k) for k in range(len(words))} == {k: expected(w) for k, w in enumerate(words)}


def test_words_and_places_are_code_points():
    found = PointWords(pa.array(["Über 𝄞 IDIOT!", None, "", "ﬁn\nÉté"]))
    assert [found.word(k) for k in range(len(found.start))] == ["über", "idiot", "ﬁn", "été"]
    assert found.count.tolist() == [2, 0, 0, 2]


def test_quoted_terms_count_less():
    texts = ['they said "what an idiot" about it', "you are an idiot you know", "idiot", 'a "b" c idiot']
    found = PointWords(pa.array(texts))
    at, _, _ = Automaton([("idiot", False)]).search(found)
    marks = [quotation(found, k, d, d + 1) for d, k in enumerate(at.tolist())]
    assert marks[0] == 1.0 and marks[1] == marks[2] == marks[3] == 0.0


def test_op11_on_held_out_documents(spark):
    rows = queries.QUERIES["op11_toxicity"](spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    truth = dict(spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic").collect())
    judged = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    caught = [p for t, p in judged if t]
    clean = [p for t, p in judged if not t]
    assert sum(caught) >= 0.9 * len(caught) and sum(clean) <= 0.02 * len(clean)


def test_odd_rows_and_labels(spark):
    """Nulls, empty and long texts, repeats, clashing columns, empty tables, one class, both labels of one document."""
    base = [(k, f"good day no {k} to all of you here" if k % 2 else f"what a wretched{'' if k % 4 else 'ly'} fool no {k} you are", 7, "x", k) for k in range(60)]
    docs = base + [(900, None, 7, "x", 1), (901, "", 7, "x", 2), (902, "wretched " * 100000, 7, "x", 3), (2, base[2][1], 7, "x", 4), (None, "wretchedd", 7, "x", 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score int, c0 string, hits int")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(60)] + [(1, 0), (2, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    out = with_toxicity(df, "text", model)
    assert out.columns == ["doc_id", "text", "c0", "score", "hits"]
    rows = out.collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.score >= 0.3) == ("wretched" in (r.text or "")), r[:3]
        for h in r.hits:
            assert r.text[h.start:h.end].lower().startswith(h.term[:3])
    long = next(r for r in rows if r.doc_id == 902)
    assert len(long.hits) == 100000
    assert with_toxicity(df.limit(0), "text", model).count() == 0
    for some, want in ((labels.limit(0), 0.0), (labels.where("toxic = 0"), 0.0), (labels.where("toxic = 1 and doc_id != 1"), 1.0)):
        got = {r.score for r in with_toxicity(df, "text", toxicity.train(df, some)).collect()}
        assert len(got) == 1 and abs(got.pop() - want) < 1e-9


def test_model_without_entries():
    score, hits = ToxicModel(0.1).score(pa.array(["a", None]))
    assert score.tolist() == [0.1, 0.1] and hits == [[], []]
