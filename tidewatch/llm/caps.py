"""Embedding near-duplicates by spherical-cap filters from random product codes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import components, cut, join_hot, shuffle_width, written

COSINE = 0.93
#: Filters of a code that a vector exceeds and vectors in a filter, on average.
#: Few blocks and many codes: the more blocks, the more unevenly filters fall to vectors.
FILTERS, FILL, BLOCKS = 2, 128, 2
#: Independent codes are added until this share of TRIALS pairs at exactly the threshold share a filter.
RECALL, TRIALS = 0.998, 2000
#: Rows of a filter that are compared in one task; larger filters are cut in chunks, and pairs of chunks compared.
CHUNK = 2048
SEED = 93


def _cap_share(angle: float, dim: int) -> float:
    """The share of the sphere within an angle of a direction."""
    grid = np.linspace(0, math.pi, 20001)
    density = np.sin(grid) ** (dim - 2) if dim > 1 else np.ones_like(grid)
    return float(density[grid <= angle].sum() / density.sum())


def cap_angle(share: float, dim: int) -> float:
    low, high = 0.0, math.pi / 2
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if _cap_share(middle, dim) < share else (low, middle)
    return high


class ProductCode:
    """Filter directions: a random rotation, then one of ``size`` random codewords for each block of dimensions."""

    def __init__(self, dim: int, per_label: float, number: int, cosine: float = COSINE):
        blocks = 1 if dim < 8 else BLOCKS
        angle = max(cap_angle(min(0.25, FILL / max(per_label, 1.0)), dim), 1.5 * math.acos(cosine))
        directions = FILTERS / _cap_share(angle, dim)
        self.size = max(2, math.ceil(directions ** (1 / blocks)))
        # The rounded-up number of directions sets the angle anew, unless pairs need a wider cap.
        angle = max(cap_angle(FILTERS / self.size**blocks, dim), 1.5 * math.acos(cosine))
        self.least = math.cos(angle)
        random = np.random.default_rng([SEED, dim, number])
        self.rotation = np.linalg.qr(random.standard_normal((dim, dim)))[0]
        self.parts = np.array_split(np.arange(dim), blocks)
        self.words = []
        for part in self.parts:
            words = random.standard_normal((self.size, len(part)))
            words /= np.linalg.norm(words, axis=1, keepdims=True)
            self.words.append(words * math.sqrt(len(part) / dim))

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that the unit vectors exceed.

        Block by block each partial choice is extended by every codeword, and dropped when even
        the best codewords of the remaining blocks cannot lift it over the threshold.
        """
        turned = unit @ self.rotation
        gains = [turned[:, p] @ w.T for p, w in zip(self.parts, self.words)]
        best = np.cumsum([g.max(axis=1) for g in gains[::-1]], axis=0)[::-1]
        rows = np.arange(len(unit))
        sums, names = np.zeros(len(unit)), np.zeros(len(unit), dtype=np.int64)
        for k, gain in enumerate(gains):
            reach = sums[:, None] + gain[rows]
            rest = best[k + 1][rows] if k + 1 < len(gains) else 0.0
            at, word = np.nonzero(reach + np.reshape(rest, (-1, 1) if k + 1 < len(gains) else ()) >= self.least)
            sums, names, rows = reach[at, word], names[at] * self.size + word, rows[at]
        return rows, names


def codes_for(dim: int, per_label: int, cosine: float = COSINE) -> list[ProductCode]:
    """As many codes as RECALL takes among ``per_label`` vectors: the more vectors, the narrower caps, the more codes."""
    random = np.random.default_rng([SEED, dim])
    one = _unit(random.standard_normal((TRIALS, dim)))
    if dim == 1:
        return [ProductCode(dim, per_label, 0, cosine)]
    way = random.standard_normal((TRIALS, dim))
    way = _unit(way - (way * one).sum(axis=1, keepdims=True) * one)
    other = cosine * one + math.sqrt(1 - cosine * cosine) * way
    codes: list[ProductCode] = []
    met = np.zeros(TRIALS, dtype=bool)
    while met.mean() < RECALL:
        codes.append(ProductCode(dim, per_label, len(codes), cosine))
        (a, f), (b, g) = codes[-1].decode(one), codes[-1].decode(other)
        met[np.intersect1d(a << 40 | f, b << 40 | g) >> 40] = True
    return codes


_ENTRIES = "label string, dim int, filter long, rep long, size long, vec binary, earlier binary"
_SLIM = "label string, dim int, filter long"


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares neither over- nor underflow
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _entries(classes: DataFrame, codes: Broadcast, kind: str, slim: bool = False) -> DataFrame:
    """A row for each filter that a vector exceeds, with the vector and its filters of lower number; ``slim``: the filter alone."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed, power = batch.column("embedding"), batch.column("power").to_numpy()
            dims = np.array([len(x) for x in listed])
            for dim, two in sorted(set(zip(dims.tolist(), power.tolist()))):
                own = codes.value[dim, two]
                chosen = np.flatnonzero((dims == dim) & (power == two))
                for part in np.array_split(chosen, max(1, len(chosen) // 2048)):
                    take = pa.array(part)
                    vectors = listed.take(take).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
                    found = [code.decode(_unit(vectors)) for code in own]
                    rows = np.concatenate([r for r, _ in found])
                    names = np.concatenate([f * len(own) + k for k, (_, f) in enumerate(found)])
                    order = np.lexsort((names, rows))
                    rows, names = rows[order], names[order]
                    pick = pa.array(rows)
                    columns = [batch.column("label").take(take).take(pick), pa.array(np.full(len(rows), dim, np.int32)), pa.array(names)]
                    if not slim:
                        raw, first = [v.tobytes() for v in vectors], np.searchsorted(rows, rows).tolist()
                        columns += [
                            batch.column("rep").take(take).take(pick),
                            batch.column("size").take(take).take(pick),
                            pa.array([raw[i] for i in rows], pa.binary()),
                            pa.array([names[a:b].tobytes() for b, a in enumerate(first)], pa.binary()),
                        ]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in (_SLIM if slim else _ENTRIES).split(", ")])

    return classes.mapInArrow(kernel, _SLIM if slim else _ENTRIES)


def _compare(a: dict, b: dict | None, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Within chunk ``a``, or between ``a`` and ``b``: (vector, links) and (vector, linked vector) of a spanning forest.

    A pair is counted in the first of the filters that both exceed, so in one place only.
    """
    other = a if b is None else b
    close = a["vec"] @ other["vec"].T >= cosine
    if b is None:
        np.fill_diagonal(close, False)
    i, j = np.nonzero(close)
    if not len(i):
        return (np.zeros(0, np.int64),) * 4
    # Earlier filters that are shared: incidence of each earlier filter, a slice at a time.
    near = np.unique(i), np.unique(j)
    early = [[side["earlier"][k] for k in rows.tolist()] for side, rows in zip((a, other), near)]
    flat = [np.concatenate(e) for e in early]
    common = np.intersect1d(flat[0], flat[1])
    first = np.ones((len(near[0]), len(near[1])), dtype=bool)
    for at in range(0, len(common), 1024):
        some = common[at : at + 1024]
        tables = []
        for e, names in zip(early, flat):
            table = np.zeros((len(e), len(some)), np.float32)
            rows = np.repeat(np.arange(len(e)), [len(x) for x in e])
            where = np.searchsorted(some, names)
            ok = (where < len(some)) & (some[np.minimum(where, len(some) - 1)] == names)
            table[rows[ok], where[ok]] = 1
            tables.append(table)
        first &= tables[0] @ tables[1].T == 0
    counted = close.copy()
    counted[np.ix_(*near)] &= first
    links_a = counted @ other["size"]
    # Each vector's first partner here, followed to a fixed point, spans what is linked within the chunk pair.
    ids = np.concatenate((a["rep"], [] if b is None else b["rep"])).astype(np.int64)
    shift = 0 if b is None else len(a["rep"])
    parent = np.arange(len(ids))
    while True:
        least = parent.copy()
        np.minimum.at(least, i, parent[j + shift])
        np.minimum.at(least, j + shift, parent[i])
        np.minimum.at(least, parent[i], parent[j + shift])
        np.minimum.at(least, parent[j + shift], parent[i])
        least = least[least]
        if (least == parent).all():
            break
        parent = least
    child = np.flatnonzero(parent != np.arange(len(ids)))
    if b is None:
        return a["rep"], links_a, ids[child], ids[parent[child]]
    return ids, np.concatenate((links_a, a["size"] @ counted)), ids[child], ids[parent[child]]


_FOUND = "a long, b long, links long"


def _verify(cosine: float, kind: str):
    def solve(low: int, high: int, rows: list[tuple]) -> pa.RecordBatch:
        def side(chosen: list[tuple]) -> dict:
            return {
                "rep": np.array([r[4] for r in chosen], np.int64),
                "size": np.array([r[5] for r in chosen], np.int64),
                "vec": _unit(np.frombuffer(b"".join(r[6] for r in chosen), kind).reshape(len(chosen), -1)),
                "earlier": [np.frombuffer(r[7], np.int64) for r in chosen],
            }

        if low == high:
            ids, links, a, b = _compare(side(rows), None, cosine)
        else:
            left, right = [r for r in rows if r[8] == low], [r for r in rows if r[8] == high]
            if not left or not right:
                ids = links = a = b = np.zeros(0, np.int64)
            else:
                ids, links, a, b = _compare(side(left), side(right), cosine)
        some = links > 0
        none = pa.nulls(int(some.sum()), pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(ids[some]), pa.array(a)]),
                pa.concat_arrays([none, pa.array(b)]),
                pa.concat_arrays([pa.array(links[some].astype(np.int64)), pa.nulls(len(a), pa.int64())]),
            ],
            names=["a", "b", "links"],
        )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[:4] + row[9:] != rows[-1][:4] + rows[-1][9:]:
                    yield solve(rows[0][3], rows[0][9], rows)
                    rows = []
                rows.append(row)
        if rows:
            yield solve(rows[0][3], rows[0][9], rows)

    return kernel


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector of (vec_id, embedding, label).

    Vectors link when their labels are equal and their cosine, in double precision, is at least
    ``cosine``. Null, empty and zero vectors, those with a null or non-finite component and those
    without a label link with nothing and are kept; vectors of different length never link.
    Equal vectors are one class, whose members link with each other and share all other links.
    Repeated rows (the same vec_id twice) count as two vectors; an empty table gives no rows; other
    columns are ignored. Pairs are found by filters that both exceed, so a pair may be missed
    with a small probability (README has measured recall); none below ``cosine`` is returned.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    sound = F.expr(
        "label is not null and vec_id is not null and embedding is not null and size(embedding) > 0"
        " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"
        " and exists(embedding, x -> x <> 0)"
    )
    if dict(rows.dtypes)["embedding"] != "array<float>":
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    members = rows.where(sound)
    # -0.0 and 0.0 are one key in Spark's groups, and one direction.
    classes = cut(members.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size")))
    labels = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.log2(F.count(F.lit(1)))).cast("int").alias("power"))
    sized = join_hot(classes, labels, "label", "n", classes.count())
    # A row for each length of vector and each power of two up to the largest label.
    kinds = sized.select(F.size("embedding").alias("dim"), "power").distinct().collect()
    codes = vectors.sparkSession.sparkContext.broadcast({(r["dim"], r["power"]): codes_for(r["dim"], 1 << r["power"], cosine) for r in kinds})
    kind = "<f4" if dict(classes.dtypes)["embedding"] == "array<float>" else "<f8"
    # Written first, so that Spark knows how few filters need chunks, and need not shuffle the vectors to find them.
    large = written(_entries(sized, codes, kind, slim=True).groupBy("label", "dim", "filter").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CHUNK))
    spread = shuffle_width(vectors.sparkSession)
    dealt = (
        _entries(sized, codes, kind)
        .join(large, ["label", "dim", "filter"], "left")
        .withColumn("_k", F.expr(f"int((coalesce(_n, 1) + {CHUNK - 1}) div {CHUNK})"))
        .withColumn("chunk", F.expr("int(pmod(xxhash64(rep), _k))"))
        .withColumn("_p", F.explode(F.expr("sequence(0, _k - 1)")))
        .select("label", "dim", "filter", F.least("chunk", "_p").alias("low"), "rep", "size", "vec", "earlier", "chunk", F.greatest("chunk", "_p").alias("high"))
        .repartition(spread, "label", "dim", "filter", "low", "high")
        .sortWithinPartitions("label", "dim", "filter", "low", "high")
    )
    found = cut(dealt.mapInArrow(_verify(cosine, kind), _FOUND))
    counts = found.where("links is not null").groupBy("a").agg(F.sum("links").alias("more")).withColumnRenamed("a", "rep")
    named = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    solved = (
        classes.join(counts, "rep", "left")
        .join(named, "rep", "left")
        .select(
            "label",
            "embedding",
            (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
            F.coalesce("component_id", "rep").alias("component_id"),
        )
    )
    linked = members.join(solved, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
