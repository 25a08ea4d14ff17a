import hashlib
import io
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.compare import same
from tests.llm import brute
from tidewatch.llm import licenses, queries, toxicity
from tidewatch.llm.oracles import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf, duck):
    same(queries.queries()[name], ORACLES[name], spark, sf, duck)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(ORACLES)))
def test_query_covers_its_table(name, spark, sf):
    table = "embeddings" if name.startswith("op1_") else "documents"
    assert queries.queries()[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes, now = [docs.count()], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf).cache()
        assert now.columns == docs.columns
        sizes.append(now.count())
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3] > 0
    texts = now.select("doc_id", "text").collect()
    got = corpus_pipeline.run(spark, sf).collect()
    want = sorted((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in texts)
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in got) == want
    assert all(len(r["ids"]) == r["n_tokens"] for r in got)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(stage, spark, odd, empty, sf):
    assert stage(spark, odd, sf).count() > 0
    assert stage(spark, empty, sf).count() == 0


# --- results of the queries that SQL cannot express, worked out plainly over whole tables ------------


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def rows_of(name, spark, sf):
    return {r["doc_id"]: r for r in queries.queries()[name](spark, sf).collect()}


def test_licenses_of_all_documents(spark, sf, texts):
    got = rows_of("op2_license_scans", spark, sf)
    phrases = [(p.split(), label, kind) for kind, table in (("base", licenses.BASE), ("notice", licenses.NOTICES), ("tag", {licenses.TAG: ""})) for p, label in table.items()]
    for i, t in texts.items():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        words = [(m[0], m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]
        base, labels, places, more, verdicts = set(), set(), [], 0, []
        for k in range(len(words)):
            for phrase, label, kind in phrases:
                if [w for w, _ in words[k : k + len(phrase)]] != phrase:
                    continue
                if kind == "base":
                    places.append(k)
                    base.add(label)
                elif kind == "notice":
                    labels.add(label)
                    more += 1
                else:
                    line = low[words[k + 2][1] :].split("\n")[0].lstrip(" \t:=\"'")
                    postfix = licenses.to_postfix(line)
                    if postfix:
                        labels |= licenses.licences(postfix)
                        verdicts.append(licenses.evaluate(postfix))
                        more += 1
        want = (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1 - 0.5 ** min(50, len(places) + more), all(verdicts) if verdicts else None)
        assert tuple(got[i])[1:] == want


def test_toxicity_of_all_documents(spark, sf, texts):
    """Scores from plain forward and backward sums, one word after the other."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    got = rows_of("op3_toxicity", spark, sf)
    t = np.exp(model.transition)
    for i, text in texts.items():
        words = re.findall(r"\w+", text)
        lift = [math.exp(min(40, max(-40, model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features(w.lower()))))) for w in words]
        forward, now = [], np.array([1.0, math.exp(model.start)])
        for k, x in enumerate(lift):
            now = (now if k == 0 else now @ t) * np.array([1.0, x])
            now /= now.sum()
            forward.append(now)
        p, back = [0.0] * len(words), np.ones(2)
        for k in range(len(words) - 1, -1, -1):
            joint = forward[k] * back
            p[k] = joint[1] / joint.sum()
            back = t @ (np.array([1.0, lift[k]]) * back)
            back /= back.sum()
        top = max([1e-6, *(min(x, 1 - 1e-6) for x in p)])
        total = -sum(math.log1p(-min(x, 1 - 1e-6)) for x in p if x > 0.01)
        z = (math.log(1e-6 + total) * model.document[0] + math.log(top / (1 - top)) * model.document[1] + model.document[2]) if words else math.log(1e-6) * model.document[0] - 14 * model.document[1] + model.document[2]
        want = 1 / (1 + math.exp(-min(30, max(-30, z))))
        assert got[i]["score"] == pytest.approx(want, abs=1e-6) and got[i]["predicted"] == (got[i]["score"] >= 0.5) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_simhash_of_all_documents(spark, sf, texts):
    got = rows_of("op4_simhash", spark, sf)
    ids = sorted(texts)
    fps = [brute.simhash(texts[i]) for i in ids]
    found = brute.components(len(ids), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert all(got[i]["fingerprint"] == f"{fps[k]:016x}" and got[i]["component_id"] == ids[found[k]] for k, i in enumerate(ids))


def test_media_of_all_documents(spark, sf, texts):
    got = rows_of("op8_media", spark, sf)
    for i, t in list(texts.items())[:60]:
        raw = t.encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        out = io.BytesIO()
        np.save(out, image)
        stored = out.getvalue()
        # Means of 8 x 9 areas in fractions: what each pixel's rows and columns share with a cell.
        height = len(image)
        share = lambda n, cells: [[max(Fraction(0), min(Fraction(k + 1), Fraction(n * (c + 1), cells)) - max(Fraction(k), Fraction(n * c, cells))) for k in range(n)] for c in range(cells)]
        across = np.array([[float(x) for x in r] for r in share(64, 9)])
        down = np.array([[float(x) for x in r] for r in share(height, 8)])
        means = np.round(down @ image.astype(float) @ across.T / (height / 8 * 64 / 9) * 1024)
        bits = [int(means[r, c] < means[r, c + 1]) for r in range(8) for c in range(8)]
        feature = bytes(sum(bits[k * 8 + b] << (7 - b) for b in range(8)) for k in range(8)).hex()
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), feature)


def test_repeats_of_all_documents(spark, sf, texts):
    got = rows_of("op10_suffix_array", spark, sf)
    ids = sorted(texts)
    assert [tuple(got[i])[1:] for i in ids] == brute.remove_repeats([texts[i] for i in ids])
