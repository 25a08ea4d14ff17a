import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import SCHEMA, row
from tidewatch.llm import bpe, caps, common, licenses, media, mixing, queries, secrets, sharding, simhash, suffix_dedup, toxicity
from tidewatch.llm.common import components
from tidewatch.llm.oracles import OP9

TEXT_QUERIES = {
    "licenses": licenses.scan_licenses,
    "simhash": simhash.near_groups,
    "bpe": lambda d: bpe.round_trip(d, queries.RANKS, queries.PATTERN),
    "secrets": secrets.secret_columns,
    "shards": sharding.shard_by_bytes,
    "media": media.text_media,
    "mix": mixing.mix,
    "repeats": suffix_dedup.remove_repeats,
    "toxicity": lambda d: toxicity.score(d, toxicity.Model()),
}


@pytest.mark.parametrize("name", TEXT_QUERIES)
def test_odd_rows_and_empty_tables(name, odd, empty):
    rows = TEXT_QUERIES[name](odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.select("doc_id").collect())
    assert TEXT_QUERIES[name](empty).count() == 0


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Remote:
        master, _jsc = "spark://host:7077", spark.sparkContext._jsc

    class Session:
        sparkContext, conf = Remote, spark.conf

    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        with pytest.raises(RuntimeError):
            common.shared_folder(Session)


def test_join_hot_equals_a_plain_join(spark):
    rows = spark.createDataFrame([(1 if i < 900 else i, i) for i in range(1000)], "k long, v long")
    facts = rows.groupBy("k").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).where("k <> 950")
    got = common.join_hot(rows, facts, "k", "n", 1000, share=10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(facts.drop("n"), "k").collect()))


# --- 1 -------------------------------------------------------------------------------------------


def test_caps_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 24))
    rows = []
    for i in range(400):
        v = base[i % 60] + rng.standard_normal(24) * (0.08 if i % 3 else 0.0)
        rows.append((i, [float(x) for x in v], i % 2))
    odd = [(400, None, 1), (401, [0.0] * 24, 1), (402, [float("nan")] * 24, 1), (403, [None] * 24, 1), (404, rows[0][1], None), (405, [1e30] * 24, 1), (406, [1e-30] * 24, 1), (407, [math.inf] * 24, 0), (408, [], 0), (409, [1.0, 2.0], 0)]
    got = {r["vec_id"]: r for r in caps.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("x"))).collect()}
    x = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (np.arange(400)[:, None] % 2 == np.arange(400) % 2)
    np.fill_diagonal(near, False)
    links = near.sum(axis=1)
    found = np.array([got[i]["n_links"] for i in range(400)])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum() and links.sum() > 1000
    want = brute.components(400, lambda a, b: near[a, b])
    assert [got[i]["component_id"] for i in range(400)] == want
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i for i in (400, 401, 402, 403, 404, 407, 408, 409))
    assert got[405]["n_links"] == got[406]["n_links"] == 1 and got[406]["component_id"] == 405 and not got[406]["kept"]
    assert caps.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_large_filters_are_compared_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.array([1.0, 1, 1, 1, 1, 1, 1, 1]) + rng.standard_normal(8) * 0.05], 0) for i in range(60)]
    monkeypatch.setattr(caps, "CHUNK", 16)
    got = caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert all(r["n_links"] == 59 and r["component_id"] == 0 for r in got)


@pytest.mark.parametrize("per_label", [256, 8192, 1 << 20])
def test_recall_at_the_threshold(per_label):
    """Pairs other than those the number of codes was found with."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((1000, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * z
    hit = np.zeros(1000, dtype=bool)
    for code in caps.codes_for(64, per_label):
        a, b = (set(zip(*map(np.ndarray.tolist, code.decode(v)))) for v in (x, y))
        hit[[i for i, _ in a & b]] = True
    assert hit.mean() >= 0.99


# --- 2 -------------------------------------------------------------------------------------------


def test_expressions():
    e = licenses.to_postfix
    assert e("mit or apache-2.0 and bsd-3-clause") == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert e("(mit or x) and gpl-2.0 with classpath -- more") == ["mit", "x", "or", "gpl-2.0", "classpath", "with", "and"]
    assert e("mit or") == ["mit"] and e("") == [] and e(") mit") == [] and e("mit some words") == ["mit"]
    assert licenses.evaluate(e("gpl-3.0 or mit")) is True and licenses.evaluate(e("gpl-3.0 and mit")) is False
    assert licenses.licences(e("gpl-2.0 with classpath or apache-2.0")) == {"gpl-2.0", "apache-2"}


def test_licenses_against_brute_force(spark):
    rng = random.Random(2)
    pieces = ["under", "the", "MIT", "license", "Apache License, Version 2", "cc-by-nc", "CC BY NC", "under the mit license.", "é", "x"]
    texts = [rng.choice([" ", "\n", "-- "]).join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    got = by_id(licenses.scan_licenses(spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)))
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == (min((p[0] for p in places), default=None), max((p[0] for p in places), default=None))
        assert r["base_labels"] == ",".join(sorted({p[1] for p in places})) and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_tags(spark):
    got = by_id(licenses.scan_licenses(spark.createDataFrame([row(1, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only)\ncode"), row(2, "spdx license identifier")], SCHEMA)))
    assert got[1]["labels"] == "gpl-2.0-only,mit" and got[1]["base_labels"] == "" and got[1]["permissive"] is True and got[2]["labels"] == ""


def test_long_texts_take_linear_time():
    machine = licenses.automaton()
    for unit in ("SPDX-License-Identifier: MIT\n", "spdx-license-identifier:y and ", "SPDX-License-Identifier: MIT ", "under the mit license ", "spdx-license-identifier: (a or "):
        began = time.perf_counter()
        got = licenses.scan(unit * (1_000_000 // len(unit)), machine)
        assert time.perf_counter() - began < 10 and got["score"] > 0
    assert licenses.scan("x " * 70_000 + "under the MIT license", machine)["first_word"] == 70_000


# --- 3 -------------------------------------------------------------------------------------------


def test_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    model = toxicity.Model(start=0.3, transition=rng.standard_normal((2, 2)))
    e = rng.standard_normal((2, 5))
    p, pairs = toxicity.marginals(e, np.array([5, 3]), model, pairs=True)
    want = np.zeros((2, 2))
    for k, n in enumerate((5, 3)):
        total, hot = 0.0, np.zeros(n)
        joint = np.zeros((2, 2))
        for s in itertools.product((0, 1), repeat=n):
            w = math.exp(0.3 * s[0] + sum(e[k, i] * s[i] for i in range(n)) + sum(model.transition[a, b] for a, b in zip(s, s[1:])))
            total += w
            hot += w * np.array(s)
            for a, b in zip(s, s[1:]):
                joint[a, b] += w
        assert np.allclose(p[k, :n], hot / total)
        want += joint / total
    assert np.allclose(pairs, want)


def test_held_out_accuracy(spark):
    rng = random.Random(0)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    bad = ["vileword", "nastyterm", "grimthing"]

    def text(toxic):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        return " ".join(words)

    data = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(600)]
    model = toxicity.fit([(t, y) for _, t, y in data[:400]])
    docs = spark.createDataFrame([row(i, t) for i, t, _ in data[400:]] + [row(999, ""), row(998, None)], SCHEMA)
    got = by_id(toxicity.score(docs, model))
    assert sum(got[i]["predicted"] == y for i, _, y in data[400:]) >= 198
    assert got[999]["predicted"] == got[998]["predicted"] == 0
    hit = next((i, t) for i, t, y in data[400:] if y)
    assert {hit[1][s["start"] : s["end"]] for s in got[hit[0]]["spans"]} & set(bad)
    kept = {r["doc_id"] for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {i for i, r in got.items() if not r["predicted"]}


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = {t for t, _ in toxicity.training_rows(docs, labels)}
    assert got == {f"text {i}" for i in range(50) if zlib.crc32(str(i).encode()) % 5}
    assert len(toxicity.training_rows(docs, labels, 7)) == 7
    assert toxicity.fit([]).document[2] < 0


def test_the_model_is_fitted_off_the_driver(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"plain words {i % 7} and {'vileword' if i % 3 == 0 else 'more'} of row {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    want, sample = toxicity.fit(toxicity.training_rows(docs, labels)), toxicity.training_sample(docs, labels)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    empty = toxicity.fit_sample(toxicity.training_sample(docs.limit(0), labels))
    assert empty.weights == {} and empty.document.tolist() == toxicity.fit([]).document.tolist()
    driver, fit = os.getpid(), toxicity.fit

    def elsewhere(rows):
        assert os.getpid() != driver
        return fit(rows)

    monkeypatch.setattr(toxicity, "fit", elsewhere)
    monkeypatch.setattr(toxicity, "training_rows", None)
    got = toxicity.fit_sample(sample)
    assert got.weights == want.weights and got.bias == want.bias and got.document.tolist() == want.document.tolist()
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i in range(200) if i % 3}


# --- 4 -------------------------------------------------------------------------------------------


def test_fingerprints(spark, sf):
    texts = ["", None, "a", "a B", "a b c", "É x y z", "w " * 70_000] + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    assert [simhash.fingerprint(t) for t in texts] == [brute.simhash(t) for t in texts]


def test_pairs_and_groups_against_brute_force(spark):
    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in fps[:30]:
        g = f
        for _ in range(rng.randint(1, 3)):
            for b in rng.sample(range(64), rng.randint(0, 4)):
                g ^= 1 << b
            fps.append(g)
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {frozenset((r["a"], r["b"])) for r in simhash.near_pairs(df).collect()}
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3
    assert got == {frozenset((signed[a], signed[b])) for a in range(len(fps)) for b in range(a) if near(a, b)}
    links = spark.createDataFrame([(a, b) for a in range(len(fps)) for b in range(a) if near(a, b)], "a long, b long")
    want = brute.components(len(fps), near)
    found = {r["node"]: r["component_id"] for r in components(links).collect()}
    assert all(found.get(i, i) == want[i] for i in range(len(fps)))


def test_variants_are_never_broadcast(spark):
    """A few fingerprints are small, their variants are not: Spark sizes them alike, so it would broadcast them."""
    pairs = simhash.near_pairs(spark.createDataFrame([(1 << i,) for i in range(60)], "fp long"))
    assert len(pairs.collect()) == 60 * 59 // 2
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_the_stage_of_near_copies_asks_for_a_shuffle_of_variants(spark, odd, monkeypatch):
    met, plain = [], simhash.near_pairs
    monkeypatch.setattr(simhash, "near_pairs", lambda distinct: met.append(plain(distinct)) or met[-1])
    corpus_pipeline.drop_near_copies(spark, odd, "").count()
    assert met and "strategy=merge" in met[0]._jdf.queryExecution().optimizedPlan().toString()


def test_long_chains_are_one_component(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long").orderBy(F.rand(1))
    assert {r["component_id"] for r in components(links).collect()} == {0}


def test_keep_first_keeps_all_columns(odd):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {1, 4, 5, 6}
    assert {2, 3, 7}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_keep_first_keeps_one_row_of_each_group(spark):
    a, b, c, d = ("".join(f"{w}{i} " for i in range(40)) for w in "abcd")
    rows = [row(1, a), row(1, a), row(2, a), row(1, b), row(5, b), row(None, c), row(None, c), row(None, d), row(7, d), row(None, "e f g"), row(None, None), row(8, None), row(8, ""), row(9, "i j k")]
    kept = simhash.keep_first(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    got = sorted(((r["doc_id"], r["text"] or "") for r in kept), key=str)
    assert got == sorted([(1, a), (1, b), (None, c), (7, d), (None, "e f g"), (8, ""), (9, "i j k")], key=str)


# --- 5 -------------------------------------------------------------------------------------------


def test_bpe_against_the_library(spark, odd, sf):
    ranks = bpe.read_ranks(queries.RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["a" * 500, "  \n\n\t x", "日本語" * 30, "<|endoftext|>", "".join(chr(rng.randrange(32, 0xD000)) for _ in range(2000))]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)] + [(20_000, ""), (20_001, None)], "doc_id long, text string"))
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = by_id(bpe.round_trip(docs, queries.RANKS, queries.PATTERN, with_ids=True))
    for i, t in rows.items():
        ids = enc.encode_ordinary(t)
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    back = by_id(bpe.decode_ids(bpe.round_trip(docs, queries.RANKS, queries.PATTERN, with_ids=True), queries.RANKS))
    assert all(bytes(back[i]["text"]).decode() == t for i, t in rows.items())


def test_long_pieces_take_little_more_than_linear_time():
    ranks = bpe.read_ranks(queries.RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rng = bpe.Bpe(ranks, queries.PATTERN), random.Random(4)
    for piece in ("a" * 5000, "日本語" * 1000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000))):
        assert codec.merge([piece.encode()]) == [enc.encode_ordinary(piece)]
    began = time.perf_counter()
    codec.merge([("abcdefghij" * 50_000).encode()])
    assert time.perf_counter() - began < 10


# --- 6 -------------------------------------------------------------------------------------------


def spans_of(text):
    out = []
    for k, r in enumerate(secrets.RULES):
        out += [(m.start(), k, f"{r.kind}:{m.start()}:{m.end()}") for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least]
    return sorted(out)


def test_secrets_against_brute_force(spark):
    rng = random.Random(6)
    parts = ["token", "Secret", "api_key", "APIKEY", "passwd", "password", "=", ":", " ", '"', "'", "abcdefgh", "x1", "0123456789abcdef", "AKIA", "ABCDEFGH12345", "ghp_", "q" * 36, "xoxb-", "1" * 20, "-----BEGIN RSA PRIVATE KEY-----", "é", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(600)] + ["token=secret: abcdefghij", "", "a" * 31, "a" * 32]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    got = by_id(secrets.secret_columns(docs))
    masked = by_id(secrets.redact(docs))
    for i, t in enumerate(texts):
        want = spans_of(t)
        base = [s[2] for s in want if s[1] < 3]
        assert got[i]["spans"] == ",".join(s[2] for s in want)
        assert [got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]] == [sum(s[1] == k for s in want) for k in range(3)]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        clean, at = "", 0
        for _, _, s in want:
            a, b = map(int, s.split(":")[1:])
            if a >= at:
                clean += t[at:a] + secrets.MASK
            at = max(at, b)
        assert masked[i]["text"] == clean + t[at:]
    assert secrets.redact(docs).columns == docs.columns


def test_columns_keep_their_values_whatever_they_are_called(spark):
    names = "doc_id long, text string, source string, spans string, row string, rules string, key string, all string, h string, nth string, times string, n string, _h string, _key string"
    rows = [(i, t, "a", *(f"{c}{i}" for c in range(11))) for i, t in enumerate(["token=abcdefghij", None, "", "plain words here"])]
    docs = spark.createDataFrame(rows, names)
    plain = [tuple(r) for r in docs.orderBy("doc_id").collect()]
    masked = [tuple(r) for r in secrets.redact(docs).orderBy("doc_id").collect()]
    assert [r[:1] + r[2:] for r in masked] == [r[:1] + r[2:] for r in plain] and [r[1] for r in masked] == [secrets.MASK, None, "", "plain words here"]
    assert {tuple(r) for r in mixing.mixed_rows(docs).collect()} <= set(plain)
    assert {tuple(r) for r in simhash.keep_first(docs).collect()} == {plain[0], plain[1], plain[3]}
    assert [tuple(r) for r in toxicity.keep_clean(docs, toxicity.Model()).orderBy("doc_id").collect()] in (plain, [])


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("[0-9a-f]+") == frozenset([frozenset()]) == q("ab|[xy]z") == q("(abc)*")
    assert q("abcd") == frozenset([frozenset(["abc", "bcd"])])
    assert q("foo(bar|baz)?qux+") >= frozenset([frozenset(["foo", "ooq", "oqu"])])
    for rule in secrets.RULES:
        for alternative in q(rule.pattern):
            assert all(len(g) == 3 and g == g.lower() for g in alternative)


# --- 7 -------------------------------------------------------------------------------------------


def test_shards(spark):
    rng = random.Random(7)
    texts = ["é" * rng.randint(0, 400) for _ in range(500)]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    got = sorted(sharding.shard_by_bytes(docs).collect(), key=lambda r: r["doc_id"])
    sizes = [len(t.encode()) + 1 for t in texts]
    assert [r["size"] for r in got] == sizes and [r["text_crc32"] for r in got] == [zlib.crc32(t.encode()) for t in texts]
    total, before, slots = sum(sizes), 0, Counter()
    for r, s in zip(got, sizes):
        assert r["shard"] == before * 16 // total and r["slot"] == slots[r["shard"]]
        slots[r["shard"]] += 1
        before += s
    again = sorted(sharding.shard_by_bytes(docs.repartition(7)).collect(), key=lambda r: r["doc_id"])
    assert again == got


# --- 8 -------------------------------------------------------------------------------------------


def test_images():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(b"P2 # c\n4 3\n255\n" + b" ".join(str(x).encode() for x in range(12))) == grey).all()
    assert media.decode(b"P1\n3 2\n0 1 0\n111").tolist() == [[255, 0, 255], [0, 0, 0]]
    assert media.decode(b"P4\n3 2\n\x40\xe0").tolist() == [[255, 0, 255], [0, 0, 0]]
    assert media.decode(b"P6 1 2 255\n" + bytes(range(6))).tolist() == [[[0, 1, 2]], [[3, 4, 5]]]
    assert media.decode(b"P5 1 1 65535\n\xff\xff").tolist() == [[255]]
    import struct

    bmp = b"BM" + struct.pack("<IHHI", 70, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, 16, 0, 0, 0, 0) + bytes([1, 2, 3, 4, 5, 6, 0, 0, 7, 8, 9, 10, 11, 12, 0, 0])
    assert media.decode(bmp).tolist() == [[[9, 8, 7], [12, 11, 10]], [[3, 2, 1], [6, 5, 4]]]
    fields = b"BM" + struct.pack("<IHHI", 82, 0, 0, 66) + struct.pack("<IiiHHIIiiII", 40, 2, -1, 1, 32, 3, 16, 0, 0, 0, 0) + struct.pack("<III", 0xFF, 0xFF00, 0xFF0000) + bytes([1, 2, 3, 0, 4, 5, 6, 0])
    assert media.decode(fields).tolist() == [[[1, 2, 3], [4, 5, 6]]]
    with pytest.raises(ValueError):
        media.decode(b"P2 1 1 255\n300")
    with pytest.raises(ValueError):
        media.decode(fields.replace(struct.pack("<I", 0xFF0000), struct.pack("<I", 0x7F0000)))
    for broken in (b"", b"P5", b"P5 9 9 255\n\0", b"BM\0"):
        with pytest.raises((ValueError, struct.error)):
            media.decode(broken)


def test_area_resize_equals_plain_means():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (7, 10))
    fine = np.kron(image, np.ones((8, 9)))  # 56 x 90: both divide evenly
    want = fine.reshape(8, 7, 9, 10).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, 8, 9), want)


def test_text_media(odd):
    got = by_id(media.text_media(odd))
    for r in odd.collect():
        if r["doc_id"] is None:
            continue
        raw = (r["text"] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[6]["feature"] == got[7]["feature"] and len(got[1]["feature"]) == 16


def test_media_columns(spark):
    rows = [(1, media.encode_pgm(np.zeros((4, 4), np.uint8))), (2, None), (3, b"junk"), (4, b"")]
    got = {r["id"]: r for r in media.media_columns(spark.createDataFrame(rows, "id long, media binary"), (2, 2)).collect()}
    assert media.read_npy(bytes(got[1]["tile"])).shape == (2, 2) and got[2]["tile"] is None and got[3]["feature"] is None and got[4]["height"] is None


# --- 9 -------------------------------------------------------------------------------------------


def test_mix(spark):
    rng = random.Random(9)
    rows = [row(i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "c", None]) if i else "é") for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = by_id(mixing.mix(docs))
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    sources = defaultdict(int)
    for r in rows:
        sources[r[3]] += size[r[0]]
    names = sorted((s for s in sources if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sources.values()))
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * sources[s] < level * weight[s]}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * sources[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    taken = defaultdict(int)
    for i, *_ in rows:
        s = rows[i][3]
        assert (got[i]["size"], got[i]["source_size"]) == (size[i], sources[s]) and math.isclose(got[i]["target"], target[s])
        assert got[i]["taken"] <= 3 * size[i]
        taken[s] += got[i]["taken"]
    assert all(abs(taken[s] - target[s]) <= 61 for s in names)
    mixed = Counter(r["doc_id"] for r in mixing.mixed_rows(docs).collect())
    assert all(mixed[i] == got[i]["epochs"] for i in got)
    assert mixing.mixed_rows(docs).columns == docs.columns
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, mixing.mix(docs).collect()))


@pytest.mark.parametrize("words", [(100, 200), (100, 200, 300), (60,) * 6, (10, 10, 10, 400)])
def test_mix_of_sources_with_equal_caps_per_weight(spark, words):
    docs = spark.createDataFrame([row(100 * s + i, "w " * (n // 10), chr(97 + s)) for s, n in enumerate(words) for i in range(10)], SCHEMA)
    left, open_, target = float(sum(words)), set(range(len(words))), {}
    while True:
        level = left / sum(s % 3 + 1 for s in open_)
        full = {s for s in open_ if 3 * words[s] <= level * (s % 3 + 1)}
        if not full:
            break
        target |= {s: 3.0 * words[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    target |= {s: level * (s % 3 + 1) for s in open_}
    got = by_id(mixing.mix(docs))
    assert all(math.isclose(r["target"], target[i // 100]) for i, r in got.items())
    assert abs(sum(r["taken"] for r in got.values()) - sum(words)) <= sum(n // 10 for n in words)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(con.sql(OP9).fetchall()) == sorted((i, r["size"], r["source_size"], r["target"], r["taken"]) for i, r in got.items())


# --- 10 ------------------------------------------------------------------------------------------


def test_deep_shallow_sort():
    rng = random.Random(3)
    for _ in range(150):
        pool = [bytes(rng.choice(b"\0ab") for _ in range(rng.randint(0, 90))) for _ in range(6)]
        s = [rng.choice(pool)[: rng.randint(0, 90)] + bytes(rng.choice(b"\0ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 60))]
        g = np.array([rng.randint(0, 2) for _ in s])
        order, shared = suffix_dedup.deep_shallow(g, s)
        assert [(g[i], s[i]) for i in order] == sorted(zip(g, s))
        for k in range(1, len(s)):
            a, b = s[order[k - 1]], s[order[k]]
            common = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
            assert shared[k] == (common if g[order[k - 1]] == g[order[k]] else -1)


@pytest.mark.parametrize("group", [4000, 2])
def test_repeats_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1500)
    rng = random.Random(group)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 900))) for _ in range(6)]
    texts = [None, "", "x" * 199, "x" * 200, "y" * 201, "z" * 700, base[0] + "w" * 100, base[0] + "w" * 100, "ab" * 1500]
    for _ in range(50):
        t = ""
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            a = rng.randint(0, max(0, len(b) - 1))
            t += b[a : a + rng.randint(0, 500)] + "".join(rng.choice("qrs") for _ in range(rng.randint(0, 120)))
        texts.append(t)
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    got = by_id(suffix_dedup.remove_repeats(docs))
    assert [tuple(got[i][1:]) for i in range(len(texts))] == brute.remove_repeats(texts)


def test_repeated_rows_lose_what_they_share(spark):
    t = "".join(chr(97 + i * i % 23) for i in range(300))
    docs = spark.createDataFrame([row(1, t), row(1, t), row(None, t[:250]), row(2, "other")], SCHEMA)
    assert sorted(r["n_removed"] for r in suffix_dedup.remove_repeats(docs).collect()) == [0, 250, 300, 300]


def test_thousands_of_repeated_rows(spark):
    """Copies with one id, copies without an id, another text with part of them, and short copies."""
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefg ") for _ in range(420))
    texts = [(1, text)] * 5000 + [(None, text[:300])] * 5000 + [(2, "x" * 50 + text[50:330] + "y" * 260), (3, "unlike " * 3), (4, None)] + [(5, "short")] * 300
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    began = time.perf_counter()
    got = Counter(map(tuple, suffix_dedup.remove_repeats(docs).collect()))
    assert time.perf_counter() - began < 60
    want = brute.remove_repeats([t for _, t in texts[4998:5002]] + [t for _, t in texts[10_000:]])
    ids = [i for i, _ in texts[4998:5002]] + [i for i, _ in texts[10_000:]]
    plain = Counter((i, *w) for i, w in zip(ids, want))
    for key in plain:
        plain[key] = 5000 if key[0] in (1, None) else plain[key]
    assert got == plain
