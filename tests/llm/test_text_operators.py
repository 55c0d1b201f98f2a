"""Operators on single texts against brute force: tokens, benchmark passages, personal data, secrets, quality."""
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidloom.llm import bpe, personal_data, queries, secrets, storage, token_counts
from evidloom.llm.decontamination import with_benchmark_hits
from evidloom.llm.quality import Model, features, held_out, with_quality
from evidloom.llm.token_counts import prefix_counts, truncation_points

DATA = "/root/testdata/sf0.001"
ODD = list("ab'strevldm  \n\t1٣!-.é中​   ß²½🙂́\x1c\x85_")
EMPTY = hashlib.sha256(b"").hexdigest()


def odd_texts(n, seed, longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, longest))) for _ in range(n)]


SPECIAL = [" <|endoftext|> x", "a  <|endoftext|>!!<|endoftext|>", "", None, "it's we're they'll 'so  'd !'s", "x" * 5000]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.default_tokenizer())


def test_ids_are_those_of_the_library(encoder):
    texts = odd_texts(1500, 3) + SPECIAL
    ids, at = encoder.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_prefix_counts_are_those_of_the_library(encoder):
    texts = odd_texts(300, 5, 30) + SPECIAL[:5]
    counts, at = token_counts.PrefixCounter(encoder).counts(pa.array(texts))
    for i, t in enumerate(texts):
        want = [len(encoder.tokenizer.encode((t or "")[:k], add_special_tokens=False).ids) for k in range(1, len(t or "") + 1)]
        assert counts[at[i]:at[i + 1]].tolist() == want, repr(t)


def test_op8_counts_whole_table(spark, encoder):
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op8_token_counts"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(encoder.tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_truncation_reads_stored_counts(spark, encoder):
    df = spark.createDataFrame([(1, "one two three four", 5), (2, None, 5), (3, "", 5), (None, "one", 5)], "k int, t string, key int")
    got = {r.k: r.keep_chars for r in truncation_points(prefix_counts(df, "k", "t"), 2).collect()}
    assert got == {1: len("one two"), 2: 0, 3: 0, None: 3}


def test_op8_stores_the_count_at_every_prefix(spark, encoder, monkeypatch):
    folders = []

    def kept_folder(df, name):
        folders.append(storage.stored(df, name))
        return folders[-1]

    monkeypatch.setattr(token_counts, "stored", kept_folder)
    rows = {r.doc_id: r.n_tokens for r in queries.QUERIES["op8_token_counts"](spark, DATA).collect()}
    assert len(folders) == 1 and all("/evidloom-prefixes-" in f for f in folders[0].inputFiles())
    kept = folders[0].withColumnRenamed("key", "doc_id").collect()
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    assert len(kept) == len(rows) == len(texts)
    for r in kept:
        counts, text = token_counts.unpacked(r.prefix), texts[r.doc_id]
        assert len(counts) == len(text) and (counts[-1] if text else 0) == rows[r.doc_id]
        for n in {1, len(text) // 3, len(text) // 2} - {0} if text else ():
            assert counts[n - 1] == len(encoder.tokenizer.encode(text[:n], add_special_tokens=False).ids)


def test_packed_counts_come_back():
    for counts in ([], [1], [1, 1, 2, 1], [1, 500, 2], list(range(1, 400))):
        assert token_counts.unpacked(token_counts.packed(np.array(counts, np.int64))).tolist() == counts


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))


def contamination(text, items, size=10):
    words, hit, found = words_of(text), set(), set()
    for item, passage in items:
        p = words_of(passage)
        n = min(size, len(p))
        windows = {tuple(p[k:k + n]) for k in range(len(p) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if tuple(words[k:k + n]) in windows:
                hit |= set(range(k, k + n))
                found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_op3_against_brute_force(spark):
    items = [(str(r[0]), r[1]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op3_decontaminate"](spark, DATA).collect()
    assert len(rows) == len(texts) and any(r.contaminated for r in rows)
    for r in rows:
        assert tuple(r)[1:] == contamination(texts[r.doc_id], items)


def test_decontamination_edge_cases(spark, monkeypatch):
    from evidloom.llm import decontamination
    rng = random.Random(1)
    items = [(str(k), " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))) for k in range(12)]
    texts = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (0, 1, 5, 30, 700)] + [None, "", "  "]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[3], "x")], "k long, t string, n_hit string")
    bench = spark.createDataFrame([(k, t) for k, t in items] + [("13", None)], "item_id string, text string")
    for per_set in (1_000_000, 20):
        monkeypatch.setattr(decontamination, "WINDOWS_PER_SET", per_set)
        for r in with_benchmark_hits(docs, "t", bench).collect():
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == contamination(r.t, items)
    assert not any(r.contaminated for r in with_benchmark_hits(docs, "t", bench.limit(0)).collect())


def luhn_ok(d):
    s = [int(c) for c in d][::-1]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def private(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    out = [("email", m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 13 <= len(digits(m.group())) <= 19 and luhn_ok(digits(m.group()))]
    out += [("phone", m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m.group())) <= 15]
    return [(k, a, b) for k, (a, b) in out]


@pytest.mark.parametrize("seed", range(3))
def test_personal_data_base_spans(seed):
    rng = random.Random(seed)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "@", ".", "1", "4", "255", "+", " ", "-", "é", "4111 1111 1111 1111", "x@y.com"])
                       for _ in range(rng.randint(0, 25)))
        assert personal_data.base_spans(text) == private(text), text


def test_op4_against_brute_force(spark):
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.QUERIES["op4_personal_data"](spark, DATA).collect():
        base = private(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, _, _ in base) for n in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()


def test_account_numbers_and_context():
    assert personal_data.added_spans("pay DE89 3704 0044 0532 0130 00 now") == [("iban", 4, 31)]
    assert personal_data.added_spans("pay DE89 3704 0044 0532 0130 01 now") == []
    call, order = (personal_data.score(f"{w} +49 30 1234567", "phone", len(w) + 1, len(w) + 15) for w in ("call", "order"))
    assert call > order


def secret_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN.replace("(?i)", ""), text, re.I | re.A) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


def test_op2_against_brute_force(spark):
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op2_secret_scan"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = secret_spans(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()


def test_random_strings_are_found_and_written_ones_are_not(spark):
    rng = np.random.default_rng(5)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    keys = ["".join(rng.choice(letters, 40)) for _ in range(40)]
    keys = [k for k in keys if re.search("[0-9]", k)]
    plain = [f"chapter-{k}-of-the-long-report-{k}" for k in range(60)]
    edge = [None, "", "é🙂 password: abcdef12 AKIA" + "A1" * 8, "token=abc secret=token:abcdefgh", "0" * 30, "ab12" * 5000]
    rows = [(k, f"é🙂 see {t} here") for k, t in enumerate(keys + plain)] + [(None, t) for t in edge]
    df = spark.createDataFrame(rows, "k long, t string").withColumn("secrets", F.lit(1))
    got = secrets.with_secrets(df, "t").select("k", "t", "secrets", secrets.masked(F.col("t"), F.col("secrets")).alias("m")).collect()
    for r in got:
        assert [s[:] for s in map(tuple, r.secrets) if s[1] < 3] == secret_spans(r.t or "")
        if r.k is not None:
            assert any(s.kind == 3 for s in r.secrets) == (r.k < len(keys)), r.t
            assert r.m == (f"é🙂 see {secrets.MASK} here" if r.k < len(keys) else r.t)
    assert secrets.with_secrets(df.limit(0), "t").count() == 0


def test_keys_without_digits_and_dotted_tokens_are_found(spark):
    rng = np.random.default_rng(11)
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    key = lambda letters, n: "".join(rng.choice(list(letters), n))
    url = low + up + "0123456789-_"
    letters = [key(low + up, n) for n in (20, 24, 32, 40) for _ in range(10)] + [key(low, 40) for _ in range(10)]
    dotted = [f"SG.{key(url, 22)}.{key(url, 43)}" for _ in range(20)]
    assigned = [f"aws.secret_access_key={key(low + up + '0123456789+/', 40)}" for _ in range(20)]
    host = [f"user@{key(low + up + '0123456789', 40)}" for _ in range(10)]
    words = "the committee of long reports publishes general information about responsible accounting and international trade".split()
    slugs = [f(rng.choice(words, 5)) for _ in range(60) for f in ("-".join, "_".join, "/".join, "".join, lambda w: "".join(x.title() for x in w))]
    texts = letters + dotted + assigned + host + slugs
    df = spark.createDataFrame([(k, f"see {t} here") for k, t in enumerate(texts)], "k int, t string")
    for r in secrets.with_secrets(df, "t").collect():
        found = [r.t[s.start:s.end] for s in r.secrets if s.kind == 3]
        t = texts[r.k]
        want = t.split(".")[1:] if t in dotted else [re.split("[=@]", t)[-1]] if t in assigned + host else [t] * (t in letters)
        assert found == want, t


def test_quality_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = queries.QUERIES["op5_quality"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    own = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in own) >= 0.95 * len(own)


def test_quality_edge_cases(spark):
    model = Model().fit(["fine words here", "junk!!! junk!!!", ""], [1, 0, 1], epochs=3)
    df = spark.createDataFrame([(1, None), (None, ""), (2, "fine words here"), (2, "fine words here")], "k long, t string").withColumn("score", F.lit("x"))
    got = [r.score for r in with_quality(df, "t", model).orderBy("k").collect()]
    assert len(got) == 4 and got[0] == got[1] and got[2] == got[3]
    assert len(features(pa.array([None, ""], pa.string()))[0]) == 0
    assert df.select(held_out("k")).count() == 4


def _names_of_temporary_columns(df):
    names = ["__text", "__a", "__base", "row", "own", "value", "v0", "a", "score0", "added", "base"]
    return df.withColumns({n: F.lit(i) for i, n in enumerate(names)}), names


def test_input_columns_of_any_name_pass_through(spark):
    df, names = _names_of_temporary_columns(spark.createDataFrame([(1, "password: abcdef12 one two"), (2, None), (3, "")], "k long, text string"))
    items = spark.createDataFrame([(7, "abcdef12 one"), (None, "one two"), (8, None), (9, "")], "item_id long, text string")
    outs = {"secrets": secrets.with_secrets(df, "text"), "personal_data": personal_data.with_personal_data(df, "text"),
            "score": with_quality(df, "text", Model()), "contaminated": with_benchmark_hits(df, "text", items)}
    for added, out in outs.items():
        rows = out.orderBy("k").collect()
        assert [r.k for r in rows] == [1, 2, 3] and added in out.columns
        assert all(r[n] == i for r in rows for i, n in enumerate(names))
        assert out.where("false").count() == 0
    hit = outs["contaminated"].orderBy("k").first()
    assert (hit.n_items, hit.items_sha256, hit.n_hit) == (1, hashlib.sha256(b"7").hexdigest(), 2)


def test_context_words_are_whole_words():
    phone = "+49 170 1234567"
    assert personal_data.score(f"hotel {phone}", "phone", 6, 6 + len(phone)) == personal_data.START["phone"]
    assert personal_data.score(f"Telefon: {phone}", "phone", 9, 9 + len(phone)) == pytest.approx(personal_data.START["phone"] + 0.2)


def test_secrets_of_very_long_texts_in_linear_time(spark):
    import time
    one = "token=" + "ab1" * 4 + " and some words; "
    text = one * 40_000
    df = spark.createDataFrame([(1, text), (2, "x " * 400_000)], "k long, text string")
    start = time.time()
    got = secrets.with_secrets(df, "text").select("k", "secrets", secrets.masked(F.col("text"), F.col("secrets")).alias("m")).orderBy("k").collect()
    assert time.time() - start < 60
    assert len(got[0].secrets) == 40_000 and [tuple(s) for s in got[0].secrets[-1:]] == [(39_999 * len(one), 0, 39_999 * len(one) + 18)]
    assert got[0].m == (secrets.MASK + " and some words; ") * 40_000 and got[1].m == "x " * 400_000


@pytest.mark.parametrize("name", ["decontamination", "quality", "ngram_join", "token_counts", "toxicity", "resampling"])
def test_every_module_ships_what_it_needs(name):
    """An operator imported alone pickles the helpers that its tasks use by value."""
    import subprocess
    import sys
    code = (f"import evidloom.llm.{name}; from pyspark import cloudpickle; "
            "assert 'evidloom.llm.textarrays' in cloudpickle.list_registry_pickle_by_value()")
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0
