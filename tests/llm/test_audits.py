"""Merkle manifests, divergence of sources and suffix-tree scores."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import SCHEMA, row
from tidewatch.llm import divergence, merkle, suffix_tree

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def fifth():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def crc5(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5


@pytest.fixture(scope="module")
def copies(spark, odd):
    """Hundreds of copies with one id, with no id, and with an id each."""
    more = [row(50, "Same words, same ID", "b")] * 300 + [row(None, "no ID", "c")] * 300 + [row(1000 + k, "copy of a Text", "a") for k in range(300)]
    return odd.unionByName(spark.createDataFrame(more, SCHEMA)).repartition(5)


def plain(rows):
    return sorted(map(str, rows))


def manifests_agree(docs):
    rows = [tuple(r[c] for c in FIELDS) for r in docs.select(*FIELDS).collect()]
    got = [tuple(r) for r in merkle.manifest(docs, fifth() == 0).collect()]
    assert plain(got) == plain(brute.merkle(rows, [crc5(r[0]) == 0 for r in rows]))


def test_manifest_of_odd_rows_and_copies(odd, copies):
    manifests_agree(odd)
    manifests_agree(copies)


def test_manifest_of_sources_beyond_a_block_and_many_sources(spark):
    def rows(n, source):
        return [(k, f"Text {k % 7}", "en", source, k % 3) for k in range(n)]

    data = rows(merkle.BLOCK * 2 + 33, "big") + rows(merkle.BLOCK, "full") + rows(17, "small") + rows(1, None)
    for k in range(40):
        data += rows(1, f"one{k}")
    manifests_agree(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(6))


def test_manifest_of_one_row_and_of_none(spark, empty):
    one = spark.createDataFrame([row(5, "A")], SCHEMA)
    r = merkle.manifest(one).first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["verified"]
    manifests_agree(one)
    assert merkle.manifest(empty).count() == 0


def test_changed_rows_are_not_verified(spark):
    docs = spark.createDataFrame([row(k, "Upper" if k % 2 else "lower") for k in range(100)], SCHEMA)
    got = {r["doc_id"]: r["verified"] for r in merkle.manifest(docs, F.col("doc_id") < 50).collect()}
    assert got == {k: not (k < 50 and k % 2) for k in range(100)}


def audit_of(rows, least=3, top=200):
    """One source and term after the other, with whole numbers."""
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        mine = {s: c for (x, s), c in groups.items() if x == lang}
        p = {s: share(c) for s, c in mine.items()}
        q = share(sum(mine.values(), Counter()))
        for s in mine:
            f = lambda a, b: sum((a[t] - b[t]) ** 2 // b[t] for t in kept)
            pairs = [(-f(p[s], p[o]), o.encode()) for o in mine if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if mine[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(sorted(items))]
    return out


def audits_agree(docs, **limits):
    rows = [(r["text"], r["lang"], r["source"]) for r in docs.select("text", "lang", "source").collect()]
    assert plain(tuple(r) for r in divergence.audit(docs, **limits).collect()) == plain(audit_of(rows, *limits.values()))


def test_audit_of_odd_rows_and_copies(odd, copies, empty):
    audits_agree(odd)
    audits_agree(copies)
    audits_agree(copies, least_docs=1, top=2)
    assert divergence.audit(empty).count() == 0


def test_audit_in_parts(spark, sf, monkeypatch):
    """Few entries in a task at once, few cells of a matrix, many sources with terms of their own."""
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "CELLS", 64)
    docs = spark.createDataFrame([(f"common w{k % 5} x{k % 11} y{k // 3} É{k % 4}", "en" if k % 10 else "de", f"s{k % 17}") for k in range(400)], "text string, lang string, source string")
    audits_agree(docs)


def test_audit_counts_beyond_64_bits(spark):
    n = spark.createDataFrame([(10**15, 10**15 + 7, 5)], "n long, size long, v long")
    assert n.select(divergence.share(F.col("n"), F.col("size"), F.col("v"))).first()[0] == 1 + 10**9 * (10**15 + 1) // (10**15 + 12)


def scores_agree(docs, depth=suffix_tree.DEPTH):
    rows = docs.select("doc_id", "text").collect()
    trained = [crc5(r["doc_id"]) != 1 for r in rows]
    want = sorted((str(r["doc_id"]), not t, len((r["text"] or "").encode().split()) + 1, k, round(b, 6), round(s, 6)) for r, t, (s, b, k) in zip(rows, trained, brute.suffix_tree([r["text"] for r in rows], trained, depth)))
    got = suffix_tree.lm_scores(docs, fifth() != 1, depth).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == pytest.approx_rows(want)
    assert {r["train_tokens"] for r in got} == {sum(len((r["text"] or "").encode().split()) + 1 for r, t in zip(rows, trained) if t)}


@pytest.fixture(autouse=True)
def approx_rows(monkeypatch):
    class Rows(list):
        def __eq__(self, other):
            return len(self) == len(other) and all(a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9, abs=2e-6) for a, b in zip(self, other))

    monkeypatch.setattr(pytest, "approx_rows", Rows, raising=False)


def test_scores_of_odd_rows_and_copies(odd, copies, empty):
    scores_agree(copies)
    scores_agree(odd, depth=2)
    assert suffix_tree.lm_scores(empty, fifth() != 1).count() == 0


def test_scores_of_all_documents(spark, sf):
    scores_agree(spark.read.parquet(f"{sf}/documents.parquet"))


def test_scores_in_small_blocks_and_chunks(odd, monkeypatch):
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 60)
    monkeypatch.setattr(suffix_tree, "CHUNK", 7)
    monkeypatch.setattr(suffix_tree, "SCORED", 5)
    scores_agree(odd.where("length(text) < 1000 or text is null"))


def test_scores_without_training_rows(spark):
    docs = spark.createDataFrame([row(1, "ab"), row(2, None)], SCHEMA)
    got = {r["doc_id"]: r for r in suffix_tree.lm_scores(docs, F.lit(False)).collect()}
    assert got[1]["score"] == pytest.approx(3 * suffix_tree.np.log10(1 / 255)) and got[2]["n_known"] == got[2]["train_tokens"] == 0


def test_states_and_shares(spark):
    """Every state's next symbols share one; a context that tells nothing new is no state."""
    text = b"ab" * 500 + b"cb" * 500
    grams = Counter()
    data = bytes([suffix_tree.START]) * 2 + text + bytes([suffix_tree.END])
    for k in range(2, len(data)):
        grams[data[k - 2] << 16 | data[k - 1] << 8 | data[k]] += 1
    tree = suffix_tree.suffix_tree(spark.createDataFrame(list(grams.items()), "gram long, n long"), depth=2)
    got = {r["gram"].to_bytes(3): r for r in tree.collect()}
    assert got[b"abc"]["state"] == 2 or got[b"abc"]["state"] == 1
    assert got[b"bab"]["state"] == 1  # b after a is certain whatever was before it
    assert sum(r["p"] for g, r in got.items() if g[:2] == b"ab") < 1
