"""Operators over whole tables against brute force: links, packing, shards, archives, the pipeline."""
import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from evidloom.llm import bpe, packing, queries, training_order, vector_dedup, warc
from evidloom.llm.components import components
from evidloom.llm.ngram_join import divide_skip, ngram_components
from evidloom.llm.storage import shared_folder

DATA = "/root/testdata/sf0.001"


def tops(ids, links):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {i: find(i) for i in ids}


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def linked(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    where = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            where[x].append(k)
    pairs = {(a, b) for ks in where.values() for a in ks for b in ks if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {k: (len(s), c) for (k, s), c in zip(sets.items(), tops(sets, links).values())}


@pytest.mark.parametrize("folder", [DATA, "/root/testdata/sf0.01"])
def test_op1_against_brute_force(spark, folder):
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op1_ngram_jaccard"](spark, folder).collect()}
    assert got == linked(texts)


def test_ngram_join_chains_and_edges(spark):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    texts, k = {}, 0
    for chain in range(3):  # successive small changes: neighbours are linked, ends are not
        words = [f"{chain}{w}" for w in base]
        for _ in range(8):
            for _ in range(2):
                words[rng.randint(0, len(words) - 1)] = f"n{rng.random()}"
            texts[k] = " ".join(words)
            k += 1
    passage = " ".join(f"p{i}" for i in range(60))
    for _ in range(40):  # a shared passage in else different texts
        texts[k] = passage + " " + " ".join(f"u{rng.random()}" for _ in range(60))
        k += 1
    for t in [None, "", " \n ", "one two", "One\ttwo", "one two three four five", "a b c d e f " * 300, "a b c d e f " * 301]:
        texts[k] = t
        k += 1
    rows = [(i, t, "x") for i, t in texts.items()] + [(None, "one two", "y"), (0, texts[0], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = ngram_components(df).collect()
    want = linked(texts)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert ngram_components(df.limit(0)).count() == 0


def test_divide_skip_is_the_plain_join():
    rng = np.random.default_rng(1)
    for _ in range(200):
        query = np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64))
        members = [np.unique(np.where(rng.random(len(query)) < 0.1, rng.integers(0, 60, len(query)), query.astype(np.int64))).astype(np.uint64)
                   for _ in range(12)]
        want = [i for i, m in enumerate(members) if len(m) and len(query)
                and 100 * len(np.intersect1d(query, m)) >= 80 * len(np.union1d(query, m))]
        assert sorted(divide_skip(query, members)) == want


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)]
    df = spark.createDataFrame(links + [(5, None), (None, 6)], "u long, v long")
    got = {r.id: r.component for r in components(df).collect()}
    want = tops({i for p in links for i in p}, links)
    assert got == {i: c for i, c in want.items() if i in got} and all(c == i for i, c in want.items() if i not in got)


def test_op7_recall_and_counts(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = [(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1)))]
    want = tops([r[0] for r in rows], links)
    got = queries.QUERIES["op7_embedding_dedup"](spark, DATA).collect()
    assert sum(r.n_links for r in got) >= 0.95 * 2 * len(links)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert sum(r.component_id == want[r.vec_id] for r in got) >= 0.95 * len(got)


def test_vector_edge_cases(spark):
    nan = float("nan")
    vectors = [[1.0, 0.0], [2.0, 0.0], [1.0, 0.0], [0.0, 0.0], [nan, 1.0], [None, 1.0], None, [], [1.0, 0.0, 0.0], [0.0, 1.0], [0.45, 1.0]]
    df = spark.createDataFrame([(k, v, k) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, n int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.vector_components(df).collect()}
    assert got[0] == (2, 0, True) and got[1] == (2, 0, False) and got[2] == (2, 0, False)
    assert got[9] == (1, 9, True) and got[10] == (1, 9, False)
    assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8))
    assert vector_dedup.vector_components(df.limit(0)).count() == 0


def check_packing(rows, texts, capacity, enc):
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array(enc.tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids + [2], "<u4")
        pieces.sort(key=lambda r: r.piece)
        assert [r.length for r in pieces] == packing.cut_lengths(len(ids), capacity)
        at = 0
        for k, r in enumerate(pieces):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at:at + r.length].tobytes()))
            at += r.length
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in rows)


def test_op10_round_trip(spark):
    texts = dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    n, total = check_packing(queries.QUERIES["op10_best_fit_packing"](spark, DATA).collect(), texts, 1024, bpe.Encoder(bpe.default_tokenizer()))
    assert n <= 1.02 * -(-total // 1024) + 1


def test_packing_edges(spark):
    texts = {1: None, 2: "", 3: "word " * 400, 4: "x"}
    df = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, length int")
    check_packing(packing.pack(df, "doc_id", "text", capacity=16).collect(), texts, 16, bpe.Encoder(bpe.default_tokenizer()))
    assert packing.pack(df.union(df), "doc_id", "text").count() == 8
    assert packing.pack(df.limit(0), "doc_id", "text").count() == 0


def test_plan_fills_exact_sums_first():
    plan = packing.Plan({10: 3, 6: 2, 4: 2, 5: 2, 3: 1, 2: 1, 9: 1}, 10)
    assert sum(t for t, _ in plan.groups) == 8  # 66 ids: 3 tens, 6+4 twice, 5+5, 9, 3+2
    rng = random.Random(3)
    for _ in range(50):
        counts = {rng.randint(1, 40): rng.randint(1, 30) for _ in range(12)}
        plan = packing.Plan(dict(counts), 40)
        used = defaultdict(int)
        for times, lengths in plan.groups:
            assert sum(lengths) <= 40
            for n in lengths:
                used[n] += times
        assert used == counts


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(training_order.feistel(np.arange(n), n).tolist()) == list(range(n))


def test_op9_shards_read_back(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    texts, folder = dict(docs.collect()), shared_folder(spark, "test-shards")
    rows = training_order.materialise(docs, "doc_id", "text", folder).collect()
    enc = bpe.Encoder(bpe.default_tokenizer())
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    read = list(training_order.read_slots(folder, 0, len(rows) + 5))
    assert len(read) == len(rows)
    assert all((a == b).all() for a, b in zip(training_order.read_slots(folder, 7, 5), read[7:12]))
    got = defaultdict(dict)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(read[r.slot].astype("<u2").tobytes()) and r.byte_offset == r.slot * 512
        got[r.doc_id][r.piece] = read[r.slot][:r.n_tokens]
    for doc, pieces in got.items():
        ids = np.concatenate([pieces[k] for k in range(len(pieces))]).tolist()
        assert ids == enc.tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids + [training_order.END_ID]
    assert len(got) == len(texts)


def test_words_of_the_counting_are_known_in_the_encoding(monkeypatch):
    """A store that starts anew merges the same words again; one that is large enough does not, and both give the same ids."""
    monkeypatch.setattr(bpe, "WORDS_KEPT", 50)
    texts = [pa.array([" ".join(f"w{chr(97 + i % 26)}{i}é" for i in range(low, low + 40)), None, ""]) for low in range(0, 400, 40)]
    path = bpe.default_tokenizer()
    small, large, narrow = bpe.Encoder(path), bpe.Encoder(path, 10_000), bpe.Encoder(path, 100)
    counted = [large.counts(t).tolist() for t in texts]
    monkeypatch.setattr(large.store, "compute", None)
    for t, n in zip(texts, counted):
        ids, offsets = large.encode(t)
        assert np.diff(offsets).tolist() == n and ids.tolist() == large.tokenizer.encode(t[0].as_py(), add_special_tokens=False).ids
        for other in (small, narrow):
            assert other.encode(t)[0].tolist() == ids.tolist()
    assert small.store.count <= 100 and narrow.store.count <= 100 and training_order.WORDS > bpe.WORDS_KEPT


def test_sequences_packed_by_either_library(monkeypatch):
    ids = np.random.default_rng(3).integers(0, 50_257, (40, 256)).astype("<u2")
    planes = np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 256, 2).transpose(0, 2, 1)).reshape(40, -1)
    one = list(map(training_order._zstd()[0], planes))
    want = training_order._unpack(one, 256)
    monkeypatch.setitem(__import__("sys").modules, "zstandard", None)
    other = list(map(training_order._zstd()[0], planes))
    for blocks in (one, other):
        assert (training_order._unpack(blocks, 256) == want).all() and (want.view("<u2") == ids).all()


def test_training_order_edges(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (2, "x"), (2, "x")], "k long, t string")
    assert training_order.materialise(df, "k", "t").count() == 4
    assert training_order.materialise(df.limit(0), "k", "t").count() == 0


def test_op6_against_brute_force(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    top = {}
    for k in sorted(pages):
        top[pages[k]] = k
    rows = queries.QUERIES["op6_warc"](spark, DATA).collect()
    assert len(rows) == len(pages)
    for r in rows:
        html = pages[r.page_id]
        own = top[html] == r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(html), base64.b32encode(hashlib.sha1(html).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if own else ("revisit", top[html]))


def test_warc_edges(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 700)
    rows = [(1, "http://a/ü\r\nx", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "only"), (5, "u", "é" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_archives(df, shared_folder(spark, "test-warc"))
    got = {r.page_id: r for r in warc.read_records(index).collect()}
    assert got[1].record_type == "revisit" and got[1].refers_to == 2 and got[1].payload == ""
    assert got[3].refers_to == 4 and got[4].record_type == "response" and got[None].payload == "only"
    assert got[5].payload == "é" * 3000
    assert warc.read_records(index.where("page_id = 5")).count() == 1
    assert all(r.record_type == "response" for r in warc.archive_round_trip(df, min_bytes=100).collect())
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DATA)
        if k < 4:
            assert docs.columns == names
        folder = shared_folder(spark, "test-stage")
        docs.write.parquet(folder)
        docs = spark.read.parquet(folder)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert kept[0] > kept[1] >= kept[2] == kept[3] == kept[4] and len(kept[4]) > 50
    want = {(r.doc_id, r.piece, r.ids_crc32) for r in docs.collect()}
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, DATA).collect()} == want


def test_near_copies_against_brute_force_with_repeated_and_null_ids(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(80)) for _ in range(8)]
    rows = [(k, t, "a") for k, t in enumerate(texts[:6])]
    rows += [(0, texts[0], "b"), (0, texts[0], "a"), (1, texts[6], "a"), (8, texts[2] + " more", "a"), (8, texts[2] + " more", "a"), (9, None, "a"), (9, None, "a")]
    rows += [(None, t, x) for t in (texts[7], texts[3], None, "") for x in "cab"]
    rng.shuffle(rows)
    rows += [(20, texts[0] + " x", "a"), (20, "quite another text", "b"), (21, "quite another text", "c")]
    sets = [shingles(r[1]) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    top, best = tops(range(len(rows)), links), {}
    for k, r in enumerate(rows):
        best[top[k]] = min(best.get(top[k], (True, 99, 99)), (r[0] is None, r[0] or 0, k))
    want = [rows[k] for *_, k in best.values()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [tuple(r) for r in corpus_pipeline.near_copies(spark, docs, DATA).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) < len(rows) - 10
    assert (20, "quite another text", "b") in got


def test_vectors_of_any_size_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0]), (10, [1e200, 1e200]), (11, [1e-200, 1e-200]),
            (12, [-1e300, 1e300]), (13, [-5e-310, 5e-310]), (None, [1.0, 0.0]), (20, [0.0, 0.0]), (21, [float("nan"), 1.0]), (22, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.vector_components(df).collect()), key=str)
    want = [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (10, 1, 10, True), (11, 1, 10, False),
            (12, 1, 12, True), (13, 1, 12, False), (None, 0, None, True), (20, 0, 20, True), (21, 0, 21, True), (22, 0, 22, True)]
    assert got == sorted(want, key=str)


def test_op7_links_lie_between_exact_bounds(spark):
    """No link below 0.9: n_links of every vector is at most the exact count, and recall is that of close pairs."""
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    good = [(r.vec_id, np.array(r.embedding, float)) for r in rows if r.embedding and np.isfinite(np.array(r.embedding, float)).all() and np.any(r.embedding)]
    unit = np.stack([v / np.linalg.norm(v) for _, v in good])
    close = (unit @ unit.T >= 0.9).sum(1) - 1
    exact = dict(zip([k for k, _ in good], close.tolist()))
    got = {r.vec_id: r.n_links for r in queries.QUERIES["op7_embedding_dedup"](spark, DATA).collect()}
    assert all(got[k] <= exact.get(k, 0) for k in got)
    assert sum(got.values()) >= 0.95 * sum(exact.values())


def test_arrow_slices_keep_all_rows():
    from evidloom.llm.workers import slices
    import pyarrow.compute  # noqa: F401
    batch = pa.RecordBatch.from_pydict({"key": list(range(50)), "text": [None, "", "x" * 100] * 16 + ["y" * 5000, "z"]})
    assert [k for s in slices(batch, "text", 250) for k in s.column(0).to_pylist()] == list(range(50))
