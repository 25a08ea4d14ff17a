"""Exact substring dedup: a sparse suffix array sorted deep-shallow.

A string of LENGTH bytes is a *window*. Every window names one *anchor* in it, the start of the
GRAM-byte gram of least hash (the leftmost such), so equal windows have equal grams at equal
distance from their starts, and each anchor stands for a run of windows next to each other. Only anchors whose
gram occurs again can stand for repeated windows; for those the suffixes that start at the
anchor, and the reversed prefixes that end there, are sorted. Two windows at distance d left of
their anchors are equal if their suffixes share LENGTH - d bytes and their prefixes share d, and
both are classes of neighbours in the sorted orders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import shuffle_width, written

LENGTH = 200
GRAM = 48
SPAN = LENGTH - GRAM + 1  # grams in a window; at most 255 for the packing below
#: Window starts looked at together.
BLOCK = 1 << 18
#: Depth in words of 8 bytes to which multikey quicksort sorts; blind tries order the rest.
SHALLOW = 8
#: Distinct contexts that a gram may have to be sorted in one task; beyond, each window is a key.
GROUP = 4000
#: Contexts sorted together, and texts unpacked together.
BATCH = 20_000
ROWS = 256

_TABLE = np.random.default_rng(200).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


# --- anchors ---------------------------------------------------------------------------------


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position, by doubling."""
    parts, width = {1: _TABLE[data]}, 1
    while width * 2 <= GRAM:
        h = parts[width]
        parts[width * 2] = h[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
        width *= 2
    h, done = parts[width], width
    while done < GRAM:
        width = 1 << ((GRAM - done).bit_length() - 1)
        n = len(data) - done - width + 1
        h = h[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + parts[width][done : done + n]
        done += width
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def anchors(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of every run; ``ends`` are the ends of the texts in ``data``."""
    low = np.uint64((1 << 32) - 1)
    ranked = (_gram_hashes(np.frombuffer(data, np.uint8)) & ~low) | np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        ranked = np.minimum(ranked[:-width], ranked[width:])
        width *= 2
    if width < SPAN:
        ranked = np.minimum(ranked[: -(SPAN - width)], ranked[SPAN - width :])
    spot = (ranked & low).astype(np.int64)
    whole = np.ones(len(spot), dtype=bool)
    for end in ends[:-1]:  # windows that would cross into the next text
        whole[max(0, end - LENGTH + 1) : end] = False
    starts = np.flatnonzero(whole)
    spot = spot[starts]
    if not len(starts):
        return starts, starts, starts
    new = np.flatnonzero((np.diff(spot) != 0) | (np.diff(starts) != 1)) + 1
    first = np.concatenate(([0], new))
    last = np.concatenate((new, [len(starts)])) - 1
    return spot[first], starts[first], starts[last]


def _blocks(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to blocks, long ones in overlapping pieces: (data, text numbers, offsets in them, ends)."""
    parts: list[bytes] = []
    numbers: list[int] = []
    offsets: list[int] = []
    room = BLOCK

    def out():
        return b"".join(parts), np.array(numbers), np.array(offsets), np.cumsum([len(p) for p in parts])

    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 0), BLOCK):
            piece = t[at : at + BLOCK + LENGTH - 1]
            parts.append(piece)
            numbers.append(i)
            offsets.append(at)
            room -= len(piece)
            if room <= 0:
                yield out()
                parts, numbers, offsets, room = [], [], [], BLOCK
    if parts:
        yield out()


def pack(anchor, first, last):
    return anchor << 16 | (anchor - first) << 8 | (last - first)


def unpack(spot: int) -> tuple[int, int, int]:
    """(anchor, first window, last window)."""
    anchor = spot >> 16
    first = anchor - (spot >> 8 & 255)
    return anchor, first, first + (spot & 255)


def _raw(column: pa.Array) -> list[bytes]:
    return [b if b is not None else b"" for b in column.cast(pa.large_binary()).to_pylist()]


def packed(keyed: DataFrame) -> DataFrame:
    """(doc_id, h, packed binary): the texts compressed, before they are shuffled."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = pa.array([compress(t) for t in _raw(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), texts], names=["doc_id", "h", "packed"])

    return keyed.mapInArrow(kernel, "doc_id long, h long, packed binary")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that unpacked texts need little memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _unpacked(column: pa.Array) -> list[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    return [expand(b) for b in column.to_pylist()]


_ANCHORS = "doc_id long, h long, gram long, context binary, spot long"


def find_anchors(keyed: DataFrame, grams_only: bool = False) -> DataFrame:
    """(doc_id, h, gram, context, spot) of every run; context is a 128-bit digest of the run's bytes and the anchor's place in them."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, whole = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        for batch in batches:
            ids, hs = batch.column("doc_id"), batch.column("h")
            for data, numbers, offsets, ends in _blocks(_raw(batch.column("text"))):
                spot, first, last = anchors(data, ends)
                if not len(spot):
                    continue
                piece = np.searchsorted(ends, spot, side="right")
                begin = np.concatenate(([0], ends))[piece] - offsets[piece]
                grams = [digest(data[a : a + GRAM]) for a in spot.tolist()]
                gram = pa.array(np.array(grams, np.uint64).view(np.int64))
                if grams_only:
                    yield pa.RecordBatch.from_arrays([gram], names=["gram"])
                    continue
                contexts = [whole(data[b : e + LENGTH], a) for b, e, a in zip(first.tolist(), last.tolist(), (spot - first).tolist())]
                take = pa.array(numbers[piece])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(take),
                        hs.take(take),
                        gram,
                        pa.array(contexts, pa.binary()),
                        pa.array(pack(spot - begin, first - begin, last - begin)),
                    ],
                    names=["doc_id", "h", "gram", "context", "spot"],
                )

    return keyed.mapInArrow(kernel, "gram long" if grams_only else _ANCHORS)


# --- sorting ---------------------------------------------------------------------------------


def _words(strings: list[bytes], width: int) -> np.ndarray:
    """Strings as rows of big-endian words of 8 bytes, zero-padded."""
    joined = b"".join(s.ljust(width, b"\0") for s in strings)
    return np.frombuffer(joined, ">u8").reshape(len(strings), width // 8).astype(np.uint64)


def _blind_trie(strings: list[bytes], members: list[int]) -> list[int]:
    """The members in order of their strings, shorter first among prefixes of each other.

    Nodes hold only a depth and the bytes they branch on. An insertion descends blindly to some
    leaf, compares with its string once, and branches at the depth where they part.
    """
    first = members[0]
    root: list = [len(strings[first]), {}, [first]]  # depth, children, members that end here
    for i in members[1:]:
        s = strings[i]
        node, path = root, [root]
        while node[1]:
            child = node[1].get(s[node[0]]) if node[0] < len(s) else None
            if child is None:  # any leaf below shares the node's depth
                if node[2]:
                    break
                child = next(iter(node[1].values()))
            node = child
            path.append(node)
        other = strings[node[2][0]]
        shared = min(len(s), len(other))
        if s[:shared] != other[:shared]:
            shared -= ((int.from_bytes(s[:shared], "big") ^ int.from_bytes(other[:shared], "big")).bit_length() + 7) // 8
        # The highest node on the path that is as deep as what is shared takes or gets the branch.
        at = next(k for k, n in enumerate(path) if n[0] >= shared)
        node = path[at]
        if node[0] == shared:
            if len(s) == shared:
                node[2].append(i)
            else:
                node[1][s[shared]] = [len(s), {}, [i]]
            continue
        split: list = [shared, {other[shared]: node}, []]
        if len(s) == shared:
            split[2].append(i)
        else:
            split[1][s[shared]] = [len(s), {}, [i]]
        if at == 0:
            root = split
        else:
            path[at - 1][1][other[path[at - 1][0]]] = split
    out: list[int] = []
    todo = [root]
    while todo:
        node = todo.pop()
        out += node[2]
        todo += [node[1][b] for b in sorted(node[1], reverse=True)]
    return out


def deep_shallow(groups: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sort strings within their groups: (order, bytes shared with the one before; -1 where a group begins).

    Multikey quicksort with words of 8 bytes as characters, all buckets of a level at once: each
    round a bucket is split three ways by its middle word, and the equal part moves on one word.
    Buckets that still hold several strings at SHALLOW words are ordered by blind tries.
    """
    n = len(strings)
    lengths = np.array([len(s) for s in strings])
    width = (int(lengths.max(initial=0)) + 7) // 8 * 8 or 8
    words = _words(strings, width)
    limit = min(SHALLOW, width // 8)
    order = np.argsort(groups, kind="stable")
    edges = np.flatnonzero(np.diff(groups[order])) + 1
    begin = np.concatenate(([0], edges)).astype(np.int64)
    size = np.diff(np.concatenate((begin, [n])))
    depth = np.zeros(len(begin), dtype=np.int64)
    deep: list[tuple[int, int]] = []
    while True:
        stay = size > 1
        begin, size, depth = begin[stay], size[stay], depth[stay]
        over = depth >= limit
        deep += zip(begin[over].tolist(), size[over].tolist())
        begin, size, depth = begin[~over], size[~over], depth[~over]
        if not len(begin):
            break
        bucket = np.repeat(np.arange(len(begin)), size)
        place = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(len(bucket))
        rows = order[place]
        now = words[rows, depth[bucket]]
        pivot = words[order[begin + size // 2], depth][bucket]
        side = (now > pivot).astype(np.int64) - (now < pivot)
        key = bucket * 3 + side + 1
        sort = np.argsort(key, kind="stable")
        order[place] = rows[sort]
        key = key[sort]
        first = np.flatnonzero(np.concatenate(([True], np.diff(key) != 0)))
        size = np.diff(np.concatenate((first, [len(key)])))
        begin, depth = place[first], depth[key[first] // 3] + (key[first] % 3 == 1)
    for at, count in deep:
        order[at : at + count] = _blind_trie(strings, order[at : at + count].tolist())
    shared = np.full(n, -1, dtype=np.int64)
    if n > 1:
        a, b = order[:-1], order[1:]
        differ = words[a] ^ words[b]
        at = (differ != 0).argmax(axis=1)
        last = differ[np.arange(n - 1), at]
        zeros = np.where(last == 0, 0, 8 - (np.frexp((last >> np.uint64(11)).astype(np.float64))[1] + 11 + 7) // 8)
        # Below 2^11 the shift leaves nothing: such a word parts in its last two bytes.
        small = (last > 0) & (last < 1 << 11)
        zeros[small] = np.where(last[small] < 256, 7, 6)
        full = np.where(last == 0, width, at * 8 + zeros)
        same = groups[a] == groups[b]
        shared[1:] = np.where(same, np.minimum(full, np.minimum(lengths[a], lengths[b])), -1)
    return order, shared


def repeated_windows(groups: np.ndarray, texts: list[bytes], offsets: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    """For each context of one or more groups, the windows that another context of its group has too.

    A context is the bytes of a run of ``counts`` windows, its anchor at ``offsets``; the result
    lists first and last window of each repeated stretch, from the context's start.
    """
    suffixes = [t[o:] for t, o in zip(texts, offsets.tolist())]
    prefixes = [t[:o][::-1] for t, o in zip(texts, offsets.tolist())]
    right, right_shared = deep_shallow(groups, suffixes)
    left, left_shared = deep_shallow(groups, prefixes)
    n = len(texts)
    hits: list[np.ndarray] = []
    for d in range(SPAN):
        valid = (offsets >= d) & (offsets - d < counts)
        if valid.sum() < 2:
            continue
        right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
        right_class[right] = np.cumsum(right_shared < LENGTH - d)
        left_class[left] = np.cumsum(left_shared < d)
        rows = np.flatnonzero(valid)
        key = right_class[rows] * (n + 1) + left_class[rows]
        sort = np.argsort(key, kind="stable")
        same = np.diff(key[sort]) == 0
        twice = np.zeros(len(rows), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        found = rows[sort[twice]]
        hits.append(found * 256 + offsets[found] - d)
    out: list[list[int]] = [[] for _ in range(n)]
    marks = np.sort(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
    if len(marks):
        first = np.flatnonzero(np.concatenate(([True], np.diff(marks) != 1)) | (marks & 255 == 0))
        last = np.concatenate((first[1:], [len(marks)])) - 1
        for a, b in zip(marks[first].tolist(), marks[last].tolist()):
            out[a >> 8] += [a & 255, b & 255]
    return out


# --- the operator ----------------------------------------------------------------------------

_CONTEXTS = "gram long, context binary, copy int, spot long, bytes binary, window binary"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted run; for grams with very many contexts a digest of each window instead."""
    names = ["gram", "context", "copy", "spot", "bytes", "window"]
    types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    for batch in _slices(batches):
        rows: list[tuple] = []
        texts = _unpacked(batch.column("packed"))
        for text, wanted in zip(texts, batch.column("wanted").to_pylist()):
            for w in wanted:
                anchor, first, last = unpack(w["spot"])
                if w["split"]:
                    gram = w["gram"].to_bytes(8, "little", signed=True)
                    for s in range(first, last + 1):
                        rows.append((w["gram"], w["context"], w["copy"], s - first, None, hashlib.blake2b(text[s : s + LENGTH], digest_size=16, key=gram).digest()))
                else:
                    rows.append((w["gram"], w["context"], w["copy"], w["spot"], text[first : last + LENGTH], None))
            if len(rows) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by gram; whole groups are taken BATCH contexts at a time. The second copy of a context only makes up its class."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        grams = np.array([r[0] for r in rows])
        groups = np.cumsum(np.concatenate(([0], np.diff(grams) != 0)))
        spots = np.array([r[3] for r in rows])
        found = repeated_windows(groups, [r[4] for r in rows], spots >> 8 & 255, (spots & 255) + 1)
        hit = [i for i, f in enumerate(found) if f and rows[i][2] == 0]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][0] for i in hit], pa.int64()), pa.array([rows[i][1] for i in hit], pa.binary()), pa.array([found[i] for i in hit], pa.list_(pa.int32()))],
            names=["gram", "context", "stretches"],
        )

    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "context", "copy", "spot", "bytes"))):
            if len(rows) >= BATCH and row[0] != rows[-1][0]:
                yield solve(rows)
                rows = []
            rows.append(row)
    if rows:
        yield solve(rows)


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(doc_id, h, marks array<struct<spot, stretches>>): the repeated windows of each text of ``keyed`` (doc_id, h, text).

    Runs with the same bytes and anchor are a class, named by a 128-bit digest. Of a class that occurs
    again two runs go to the sorter, of others one if its gram has another class, so it is the sorted
    orders that decide what repeats; the digest only spares the further copies.
    """
    runs = find_anchors(keyed)
    # What is joined to a side that may be skewed is cut first: Spark splits a hot key only where
    # both sides of the join come straight from a shuffle.
    again = written(find_anchors(keyed, grams_only=True).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    candidates = written(runs.join(again, "gram", "left_semi"))
    place = F.struct("doc_id", "h", "spot")
    contexts = written(candidates.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("one"), F.max(place).alias("two")))
    rivals = written(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("rivals"), F.max("times").alias("most")).where("rivals > 1 or most > 1").select("gram", "rivals"))
    copies = F.when(F.col("times") > 1, F.array("one", "two")).otherwise(F.array("one"))
    wanted = (
        contexts.join(rivals, "gram")
        .where("rivals > 1 or times > 1")
        .select("gram", "context", (F.col("rivals") > GROUP).alias("split"), F.posexplode(copies).alias("copy", "at"))
        .groupBy(F.col("at.doc_id").alias("_id"), F.col("at.h").alias("_h"))
        .agg(F.collect_list(F.struct("gram", "context", "copy", F.col("at.spot").alias("spot"), "split")).alias("wanted"))
    )
    texts = packed(keyed)
    fetched = written(
        texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["_id"]) & (texts["h"] == wanted["_h"]))
        .select("packed", "wanted")
        .mapInArrow(_fetch, _CONTEXTS)
    )
    spread = shuffle_width(keyed.sparkSession)
    by_sorting = (
        fetched.where("window is null")
        .repartition(spread, "gram")
        .sortWithinPartitions("gram")
        .select("gram", "context", "copy", "spot", "bytes")
        .mapInArrow(_sort_groups, "gram long, context binary, stretches array<int>")
    )
    split = fetched.where("window is not null").select("gram", "context", "copy", "spot", "window")
    often = written(split.distinct().groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window"))
    by_window = split.where("copy = 0").join(often, "window", "left_semi").select(
        "gram", "context", F.array(F.col("spot").cast("int"), F.col("spot").cast("int")).alias("stretches")
    )
    verdicts = written(by_sorting.unionByName(by_window))
    return (
        candidates.join(verdicts, ["gram", "context"])
        .groupBy("doc_id", "h")
        .agg(F.collect_list(F.struct("spot", "stretches")).alias("marks"))
    )


def covered(length: int, marks: list[dict] | None) -> np.ndarray:
    """Which bytes of a text the repeated windows cover."""
    edge = np.zeros(length + 1, dtype=np.int64)
    for mark in marks or ():
        _, first, _ = unpack(mark["spot"])
        for a, b in zip(mark["stretches"][::2], mark["stretches"][1::2]):
            edge[first + a] += 1
            edge[first + b + LENGTH] -= 1
    return np.cumsum(edge[:-1]) > 0


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_copies(keyed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(one row of each (doc_id, h), the rows whose key is their own, the rows that have copies or None).

    Keys are counted first, without the texts; only rows with copies are grouped, and as a rule there are none.
    """
    counted = keyed.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("n"))
    often = written(counted.where("n > 1").drop("n"))
    if often.isEmpty():
        return keyed, keyed, None
    same = keyed["doc_id"].eqNullSafe(often["_id"]) & (keyed["h"] == often["_h"])
    own, copies = keyed.join(often, same, "left_anti"), keyed.join(often, same, "left_semi")
    return own.unionByName(copies.groupBy("doc_id", "h").agg(F.first("text").alias("text"))), own, copies


def remove_repeats(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) for every document.

    Removes each byte covered by a LENGTH-byte string that starts anywhere else too, in the same
    document or another. Null, empty and shorter texts keep all bytes; repeated rows repeat each
    other and lose all if they are LENGTH bytes or longer, and one of them stands for all where others
    are compared with them; null ids are kept as such, an empty table gives no rows, other columns are ignored.
    """
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).select("doc_id", F.xxhash64("text").alias("h"), "text")
    distinct, own, copies = without_copies(keyed)
    marks = repeated_spans(distinct).withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    texts = packed(own)
    joined = texts.join(marks, texts["doc_id"].eqNullSafe(marks["_id"]) & (texts["h"] == marks["_h"]), "left").select("doc_id", "packed", "marks", F.lit(False).alias("copied"))
    if copies is not None:
        joined = joined.unionByName(packed(copies).select("doc_id", "packed", F.lit(True).alias("copied")), allowMissingColumns=True)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = []
            for text, found, copied in zip(_unpacked(batch.column("packed")), batch.column("marks").to_pylist(), batch.column("copied").to_pylist()):
                kept, removed, spans = text, 0, 0
                if copied and len(text) >= LENGTH:
                    kept, removed, spans = b"", len(text), 1
                elif found:
                    gone = covered(len(text), found)
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            arrays = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(arrays[: 6 if with_kept else 5], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_kept else 5])

    return joined.mapInArrow(kernel, _RESULT + ", kept binary" * with_kept)
