"""How far the sources of a language diverge in their words, pair by pair and term by term."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import written

#: A term is kept if so many documents of its language have it; probabilities are whole numbers of this scale.
LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP = 200

#: Lowers A-Z and blanks whatever separates terms, in one pass: all of ASCII but its letters.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Entries that a task gathers before it passes them on.
HELD = 750_000
#: An entry passes on what it has before it counts so many occurrences or documents.
OCCURRENCES, DOCUMENTS = 1 << 40, 1 << 22
#: Cells of the pairs of sources that are worked out at once.
CELLS = 1 << 20

COUNTS = "lang string, source string, term binary, n long, docs long"


def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term), of parts of a task; a group's documents stand under the empty term.

    An entry holds both counts as one number, documents above ``OCCURRENCES``.
    """
    gathered: dict[tuple, dict[bytes, int]] = {}

    def passed() -> Iterator[pa.RecordBatch]:
        for group, entries in gathered.items():
            both = np.fromiter(entries.values(), np.int64, len(entries))
            head = [pa.repeat(pa.scalar(x, pa.string()), len(entries)) for x in group]
            yield pa.RecordBatch.from_arrays([*head, pa.array(list(entries), pa.binary()), pa.array(both & (OCCURRENCES - 1)), pa.array(both // OCCURRENCES)], names=["lang", "source", "term", "n", "docs"])
        gathered.clear()

    held = texts = size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            document = text.as_py().translate(TABLE).split()
            texts, size = texts + 1, size + len(document)
            if held > HELD or texts == DOCUMENTS or size >= OCCURRENCES:
                yield from passed()
                held, texts, size = 0, 1, len(document)
            entries = gathered.setdefault((lang.as_py(), source.as_py()), {})
            held -= len(entries)
            known = entries.get
            for term, n in Counter(document).items():
                entries[term] = known(term, 0) + n + OCCURRENCES
            entries[b""] = known(b"", 0) + OCCURRENCES
            held += len(entries)
    yield from passed()


def share(n: Column, size: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (size + terms)), exact however large the counts are."""
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    return F.call_function("div", whole(F.lit(SCALE), 10) * whole(n + 1, 19), whole(size + terms, 19)) + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def both_have(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each language and pair of its sources: what terms that both have add beyond what each adds alone.

    A row is a term with its sources, their shares of it and their shares of an unseen term. Terms
    with the same number of sources are a matrix, worked out ``CELLS`` at a time in 64 bits, which
    the squares of shares fit.
    """
    f = lambda p, q: (p - q) * (p - q) // q
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        lists, parts = batch.column(1), [np.asarray(x) for x in batch.column(1).flatten().flatten()]
        starts, lengths, code = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py(), np.asarray(lists.value_lengths()), np.asarray(langs.indices)
        width = int(parts[0].max()) + 1 if len(parts[0]) else 1
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for m in np.unique(lengths[lengths > 1]):
            rows, step = np.flatnonzero(lengths == m), max(1, CELLS // int(m * m))
            for k in range(0, len(rows), step):
                at = starts[rows[k : k + step], None] + np.arange(m)
                i, p, z = (x[at] for x in parts)
                a, b, a0, b0 = p[:, :, None], p[:, None, :], z[:, :, None], z[:, None, :]
                value = (f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0)).ravel()
                key = ((code[rows[k : k + step], None, None].astype(np.int64) * width + i[:, :, None]) * width + i[:, None, :]).ravel()
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                found.append((key[first], np.add.reduceat(value[order], first)))
        if found:
            keys, values = (np.concatenate(x) for x in zip(*found, strict=True))
            names = np.array(langs.dictionary.to_pylist(), object)
            yield pa.RecordBatch.from_arrays([pa.array(names[keys // width**2], pa.string()), pa.array(keys // width % width), pa.array(keys % width), pa.array(values)], names=["lang", "a", "b", "value"])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of each (lang, source) group.

    Part ``pair``: every other source of the language and how far the group's term shares diverge
    from its shares, over all kept terms, also those neither has. Part ``term``: the ``top`` terms
    that the group has more of than its language, by how far. Null lang, source and text are read
    as empty; a group without terms has its pairs; a language without kept terms has pairs of value
    0; repeated rows count each; ties are ordered by item; an empty table gives no rows; other
    columns are ignored.

    A term's shares differ from those of an unseen term for few sources, so a pair's sum is what it
    would be if no term were seen, plus what the terms of either source add (by how many terms have
    each count), plus what terms of both add beyond that (worked out a term at a time, as
    sums by pair within a batch). No list of pairs of rows is made.
    """
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    slim = docs.select(plain("lang").alias("lang"), plain("source").alias("source"), plain("text").cast("binary").alias("text"))
    counts = slim.mapInArrow(tokenise, COUNTS).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", F.col("n").alias("k"))).alias("by"))
    marker = F.col("term") == F.lit(b"")
    kept = written(terms.where(marker | (F.col("docs") >= least_docs)).drop("docs"))

    hits = kept.select("lang", "term", "n", F.explode("by").alias("e")).select("lang", "term", "n", "e.source", "e.k")
    sizes = hits.groupBy("lang", "source").agg(F.sum(F.when(~marker, F.col("k")).otherwise(0)).alias("size"))
    langs = kept.groupBy("lang").agg(F.sum(F.when(~marker, F.col("n")).otherwise(0)).alias("lang_size"), F.sum(F.when(marker, 0).otherwise(1)).alias("v"))
    groups = sizes.join(langs, "lang").withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    # A row for each group: where these are few, Spark broadcasts them by their size.
    groups = written(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("size"), F.col("v"))).otherwise(1)))

    seen = hits.where(~marker & (F.col("k") > 0)).join(groups, ["lang", "source"]).withColumn("p", share(F.col("k"), F.col("size"), F.col("v")))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    q = share(F.col("n"), F.col("lang_size"), F.col("v"))
    by_term = (
        seen.withColumn("q", q)
        .where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
    )

    together = seen.groupBy("lang", "term").agg(F.collect_list(F.struct("i", "p", "p0")).alias("by")).where(F.size("by") > 1)
    shared = together.select("lang", "by").mapInArrow(both_have, "lang string, a long, b long, value long")
    # How many terms of a group have each share, against each other group of the language.
    alike = seen.groupBy("lang", "i", "p0", "p").agg(F.count(F.lit(1)).alias("m"))
    other = groups.select("lang", F.col("i").alias("j"), F.col("p0").alias("q0"))
    alone = alike.join(other, "lang").where("i <> j")
    ours = F.struct(F.col("i").alias("a"), F.col("j").alias("b"), (F.col("m") * (gap(F.col("p"), F.col("q0")) - gap(F.col("p0"), F.col("q0")))).alias("value"))
    theirs = F.struct(F.col("j").alias("a"), F.col("i").alias("b"), (F.col("m") * (gap(F.col("q0"), F.col("p")) - gap(F.col("q0"), F.col("p0")))).alias("value"))
    either = alone.select("lang", F.explode(F.array(ours, theirs)).alias("e")).select("lang", "e.*")
    sums = shared.where("a <> b").unionByName(either).groupBy("lang", "a", "b").agg(F.sum("value").alias("more"))
    left = groups.select("lang", "source", F.col("i").alias("a"), F.col("p0").alias("p"), "v")
    right = groups.select("lang", F.col("source").alias("item"), F.col("i").alias("b"), F.col("p0").alias("q"))
    by_pair = (
        left.join(right, "lang")
        .where("a <> b")
        .join(sums, ["lang", "a", "b"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("v") * gap(F.col("p"), F.col("q")) + F.coalesce("more", F.lit(0))).alias("value"))
        .withColumn("rank", F.row_number().over(best))
    )
    return by_pair.unionByName(by_term)
