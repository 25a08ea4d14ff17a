"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import components, cut, join_hot, shuffle_width

WORDS = 3
SEED = 42
RADIUS = 3
#: Parts of the 64 bits, each left out once; see near_pairs.
PARTS = (range(0, 21), range(21, 42), range(42, 64))
#: Shingles hashed before their bits are added up, so a very long text needs little memory.
BLOCK = 255 * 64


def _ones(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set, lowest bit first."""
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    ones = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:  # 255 ones fit a byte, which adds up fast
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return ones


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined, width = b" ".join(tokens), min(words, len(tokens))
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(tokens) - width + 1
    starts, ends = starts[:n].tolist(), ends[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        ones += _ones([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])])
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, *carry): the fingerprint of every text as a signed long; carried columns are longs without nulls."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fps.view(np.int64)} | {c: batch[c] for c in carry})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry).mapInPandas(kernel, ", ".join(f"{c} long" for c in ("doc_id", "fp", *carry)))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _variants(fp: Column) -> Column:
    """For each part left out, the fingerprint without it and all its variants with one other bit flipped."""
    every = (1 << 64) - 1
    out = []
    for part in PARTS:
        kept = every ^ sum(1 << b for b in part)
        left = fp.bitwiseAND(F.lit(_signed(kept)))
        out.append(F.array(left, *(left.bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64) if b not in part)))
    return F.concat(*out)


def near_pairs(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b, with at most ``radius`` differing bits among distinct fingerprints ``fp``; each pair once.

    Meet in the middle: if words differ in 1 to 3 bits, some part of PARTS has one of them, and
    with it left out at most two differ, which a variant at distance one from both has in common. Every
    fingerprint emits all variants within half the radius of what each left-out part leaves, 131
    rows. They are shuffled on the variant; what meets is verified on all 64 bits inside the join,
    and what meets on several variants is deduplicated. On 42 bits or more, words meet by chance
    seldom: of n fingerprints, n * n / 4.7e9 pairs. Leaving out one of four parts would make that
    25 times fewer, for 196 rows instead of 131.
    """
    if not 0 <= radius <= 3:
        raise ValueError("with one part left out, two bits may differ at most: radius 0 to 3")
    # Dealt anew, as few partitions of fingerprints make very many variants.
    dealt = distinct.select("fp").repartition(shuffle_width(distinct.sparkSession))
    emitted = dealt.select(F.col("fp").alias("a"), F.explode(_variants(F.col("fp"))).alias("variant"))
    return (
        # Spark sizes variants as their fingerprints, which are a 131st of them, so it must not choose to broadcast them.
        emitted.join(emitted.withColumnRenamed("a", "b").hint("merge"), "variant")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        .select("a", "b")
        .distinct()
    )


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): each document's fingerprint and the smallest id it is linked to.

    Copies share a fingerprint and are one node, so a group of copies of any size adds no pairs.
    Null and empty texts have fingerprint zero and link with each other; texts under three words
    are one shingle; repeated rows fall in one component; a null id never becomes a component's id
    unless all ids in it are null; an empty table gives no rows; other columns are ignored.
    """
    return _grouped(docs).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, *carry, root, component_id): ``root`` is the least fingerprint of a component, so it names it also where ids are null or repeat."""
    fps = cut(fingerprints(docs, carry=carry))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")))
    n_classes, n_docs = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    linked = components(near_pairs(classes)).withColumnsRenamed({"node": "fp", "component_id": "root"})
    smallest = linked.join(classes, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    moved = join_hot(linked, smallest, "root", "members", n_classes).select("fp", "root", "component_id")
    named = cut(classes.join(moved, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first_id").alias("component_id"), "copies"))
    return join_hot(fps, named, "fp", "copies", n_docs).select("doc_id", "fp", *carry, "root", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group, with all its columns: that of least id, then of least digest of the text.

    An id on texts of several groups stays once for each group it is the first of; null ids come
    last; of repeated rows, those with the same id and text, one stays. Null and empty texts are one
    group; an empty table gives no rows; columns keep their values whatever they are called.
    """
    doc_id, h = F.col("doc_id").cast("long"), F.xxhash64("text")
    keyed = docs.select(doc_id.alias("doc_id"), "text", h.alias("h"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    kept = _grouped(keyed, carry=("h",)).groupBy("root").agg(first.alias("first")).select(F.struct("first.doc_id", "first.h").alias("key"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.struct(doc_id.alias("doc_id"), h.alias("h")).alias("key"))
    # Structs are equal where both ids are null; the rows come from the join dealt and sorted by the key.
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
