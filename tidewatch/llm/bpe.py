"""Byte-level BPE on length-bucketed padded matrices."""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import kept

NONE = np.int64(1 << 40)
#: Cells of a padded matrix, and pieces a worker remembers, at most.
CELLS = 1 << 19
REMEMBERED = 150_000
#: Bytes of a piece from which its pairs wait in a heap: compacting a row costs its length for each merge.
LONG = 1024


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """(left id, right id) to merged id: an open-addressing hash table probed for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 3))))
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int64)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slots, values = self._slot(keys), merged.astype(np.int64)
        while len(keys):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]  # of several keys for a slot one stays
            settled = self.keys[slots] == keys
            self.values[slots[settled]] = values[settled]
            keys, values = keys[~settled], values[~settled]
            slots = (slots[~settled] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids; NONE where the pair does not merge or a side is padding (-1)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(keys.shape, NONE, dtype=np.int64)
        ask = np.flatnonzero((left >= 0) & (right >= 0))
        flat, keys = out.reshape(-1), keys.reshape(-1)
        slots = self._slot(keys[ask])
        while len(ask):
            there = self.keys[slots]
            hit = there == keys[ask]
            flat[ask[hit]] = self.values[slots[hit]]
            on = ~hit & (there != -1)
            ask, slots = ask[on], (slots[on] + 1) & ((1 << self.bits) - 1)
        return out


class Bpe:
    """Encoder and decoder for one rank file; the id of a token is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens = {i: t for t, i in ranks.items()}
        pairs = [
            (ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        ]
        self.pairs = PairTable(*(np.array(x, dtype=np.int64) for x in (zip(*pairs) if pairs else ((), (), ()))))
        self.single: dict[int, int] = {}
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.bytes < 0).any():
            raise ValueError("every byte needs a rank")
        self.known: dict[str, tuple[int, str, bytes, bytes]] = {}

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece (none empty)."""
        out: list[list[int]] = [[]] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if p in self.ranks:  # a piece that is a token stays whole
                out[i] = [self.ranks[p]]
            elif len(p) >= LONG:
                out[i] = self._merge_long(p)
            else:
                buckets.setdefault((len(p) - 1).bit_length(), []).append(i)
        for power, members in buckets.items():
            step = max(1, CELLS >> power)
            for at in range(0, len(members), step):
                rows = members[at : at + step]
                for i, ids in zip(rows, self._merge_rows([pieces[i] for i in rows])):
                    out[i] = ids
        return out

    def _merge_rows(self, pieces: list[bytes]) -> list[list[int]]:
        """Each round every row merges its leftmost pair of least rank; rows without one leave."""
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        ids = np.full((len(pieces), width), -1, dtype=np.int64)
        ids[np.arange(width) < lengths[:, None]] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:])
        row_of, out = np.arange(len(pieces)), [[]] * len(pieces)
        while len(ids):
            if width > 1:
                spot = rank.argmin(axis=1)
                least = rank[np.arange(len(ids)), spot]
                busy = least < NONE
            else:
                busy = np.zeros(len(ids), dtype=bool)
            for i in np.flatnonzero(~busy):
                out[row_of[i]] = ids[i][ids[i] >= 0].tolist()
            ids, rank, row_of = ids[busy], rank[busy], row_of[busy]
            if not len(ids):
                break
            spot, least = spot[busy], least[busy]
            every = np.arange(len(ids))
            ids[every, spot] = least
            # Compact: what stands right of the merged pair moves one to the left.
            columns = np.arange(width - 1)
            ids = np.take_along_axis(ids, columns + (columns > spot[:, None]), axis=1)
            if width > 2:
                rank = np.take_along_axis(rank, columns[:-1] + (columns[:-1] >= spot[:, None]), axis=1)
                for near in (spot - 1, spot):
                    ok = (near >= 0) & (near < width - 2)
                    rank[every[ok], near[ok]] = self.pairs.get(ids[every[ok], near[ok]], ids[every[ok], near[ok] + 1])
            width -= 1
        return out

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges, leftmost of least rank first, in time n log n: a row of its own whose pairs wait in a heap."""
        if not self.single:
            filled = self.pairs.keys >= 0
            self.single = dict(zip(self.pairs.keys[filled].tolist(), self.pairs.values[filled].tolist()))
        row = self.bytes[np.frombuffer(piece, np.uint8)]
        rank = self.pairs.get(row[:-1], row[1:])
        heap = ((rank << 32) | np.arange(len(rank)))[rank < NONE].tolist()  # rank, then place; places and ranks are under 2^31
        heapq.heapify(heap)
        ids, now, n = row.tolist(), [*rank.tolist(), int(NONE)], len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def ask(place: int) -> None:
            """Look up the pair that begins at ``place`` anew."""
            right = after[place]
            now[place] = merged = self.single.get(ids[place] << 32 | ids[right], int(NONE)) if right < n else int(NONE)
            if merged < NONE:
                heapq.heappush(heap, merged << 32 | place)

        while heap:
            top = heapq.heappop(heap)
            place = top & 0xFFFFFFFF
            if now[place] != top >> 32:  # the pair is gone
                continue
            gone = after[place]
            ids[place], ids[gone], now[gone] = top >> 32, -1, int(NONE)
            after[place] = after[gone]
            if after[place] < n:
                before[after[place]] = place
            ask(place)
            if before[place] >= 0:
                ask(before[place])
        return [i for i in ids if i >= 0]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def learn(self, pieces: Iterable[str]) -> None:
        """Remember the count, joined ids, decoded bytes and packed ids of pieces not yet known."""
        fresh = [p for p in dict.fromkeys(pieces) if p not in self.known]
        for p, ids in zip(fresh, self.merge([p.encode("utf-8", "surrogatepass") for p in fresh])):
            self.known[p] = len(ids), ",".join(map(str, ids)), self.decode(ids), array("i", ids).tobytes()

    def encode(self, texts: list[str | None], chars: int = 1 << 22) -> Iterator[list[tuple[int, str, bytes, bytes]]]:
        """For each text its pieces as (count, joined ids, decoded bytes, packed ids); texts are taken ``chars`` at a time."""
        at = 0
        while at < len(texts):
            end, room = at, chars
            while end < len(texts) and (end == at or room > 0):
                room -= len(texts[end] or "")
                end += 1
            split = [self.split(t or "") for t in texts[at:end]]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.learn(p for pieces in split for p in pieces)
            for pieces in split:
                yield list(map(self.known.__getitem__, pieces))
            at = end


def worker_codec(key: tuple, ranks: Broadcast) -> Bpe:
    """One Bpe for each worker process; building its tables and merging the frequent pieces is done once and not for each task."""
    return kept(("bpe", *key), lambda: Bpe(ranks.value, key[1]))


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode every text, decode the ids, and return the digests of both (and ``ids array<int>``).

    Null and empty texts have no tokens and the digests of nothing; repeated rows and null ids are
    taken row by row; an empty table gives no rows; other columns are ignored.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))  # a vocabulary: its size is fixed
    key = path, pattern, len(ranks.value)
    names = [c.split()[0] for c in DIGESTS.split(", ")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_codec(key, ranks)
        for batch in batches:
            keys, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for start in range(0, len(texts), 1024):
                counts, ids, back, all_ids = [], [], [], []
                for parts in bpe.encode(texts[start : start + 1024]):
                    counts.append(sum(p[0] for p in parts))
                    joined = ",".join([p[1] for p in parts])
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    back.append(hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest())
                    if with_ids:
                        all_ids.append(b"".join([p[3] for p in parts]))
                columns = [keys.slice(start, len(counts)), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
                if with_ids:
                    flat = pa.array(np.frombuffer(b"".join(all_ids), np.int32))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), flat))
                yield pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernel, DIGESTS + ", ids array<int>" * with_ids)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) to (doc_id, text binary): the bytes that the ids stand for; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = {i: t for t, i in shared.value.items()}
        for batch in batches:
            out = [None if x is None else b"".join(tokens[int(i)] for i in x) for x in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": out})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInPandas(kernel, "doc_id long, text binary")
