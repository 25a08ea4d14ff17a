"""Toxic spans by a linear-chain conditional random field over words."""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import kept

#: Labelled texts that the model is fitted on, and their characters, at most: those of least digest of their id.
#: Of near copies with the same label one is fitted.
SAMPLE, SAMPLE_CHARS = 8000, 200_000_000
#: Every how many-th fitted text calibrates the document score instead of the field.
HELD = 4
EPOCHS = 25
#: How far, as a logarithm, a feature's odds must exceed the number of features tried.
CERTAINTY = 3.0
#: Words of a training sequence; longer texts are cut into several, which lose one transition at each cut.
SEGMENT = 256
#: Words whose potentials a worker remembers, and cells of a padded matrix, at most.
REMEMBERED = 300_000
CELLS = 1 << 19
#: Characters whose words are scored together.
CHARS = 8_000_000
_WORD = re.compile(r"\w+")


def features(word: str) -> list[int]:
    """Checksums of a lower-cased word, of three of its beginnings and of its end."""
    parts = "w" + word, "3" + word[:3], "4" + word[:4], "5" + word[:5], "e" + word[-4:]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) for p in parts]


@dataclass
class Model:
    """Log potentials are those of the toxic state less those of the clean one."""

    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -6.0
    start: float = 0.0
    #: transition[a, b]: from state a to b, clean 0, toxic 1
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: of log expected toxic words, the largest log-odds, and one
    document: np.ndarray = field(default_factory=lambda: np.zeros(3))


class Potentials(dict):
    """Word to its emission potential, worked out when first asked for."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        got = self.model.weights.get
        value = self.model.bias + sum(got(f, 0.0) for f in features(word.lower()))
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def worker_potentials(name: str, shared: Broadcast) -> Potentials:
    """Words' potentials are worked out once for each worker process and model, not for each task."""
    return kept(("toxicity", name), lambda: Potentials(shared.value))


def marginals(emissions: np.ndarray, lengths: np.ndarray, model: Model, pairs: bool = False):
    """Forward-backward over padded rows: P(toxic) of each word; with ``pairs`` also the four transitions' expected counts.

    Messages are ratios of toxic to clean. Padding carries the neutral message backward.
    """
    n, width = emissions.shape
    lift = np.exp(np.clip(emissions, -40, 40))
    t = np.exp(model.transition)
    forward = np.empty((width, n))
    ratio = np.full(n, np.exp(model.start))
    columns = lift.T
    for k in range(width):
        if k:
            ratio = (t[0, 1] + t[1, 1] * ratio) / (t[0, 0] + t[1, 0] * ratio)
        ratio = np.clip(ratio * columns[k], 1e-30, 1e30)
        forward[k] = ratio
    backward = np.empty((width, n))
    back = np.ones(n)
    for k in range(width - 1, -1, -1):
        backward[k] = back
        seen = np.where(k < lengths, columns[k] * back, 1.0)
        back = np.where(k < lengths, (t[1, 0] + t[1, 1] * seen) / (t[0, 0] + t[0, 1] * seen), 1.0)
    odds = forward * backward
    p = (odds / (1 + odds)).T
    p[np.arange(width) >= lengths[:, None]] = 0.0
    if not pairs:
        return p
    expected = np.zeros((2, 2))
    for k in range(1, width):
        live = k < lengths
        a, b = forward[k - 1][live], columns[k][live] * backward[k][live]
        joint = np.array([[t[0, 0] * np.ones_like(a), t[0, 1] * b], [t[1, 0] * a, t[1, 1] * a * b]])
        expected += (joint / joint.sum(axis=(0, 1))).sum(axis=2)
    return p, expected


def _padded(rows: list[np.ndarray], cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, padded matrix, lengths) of rows of similar length."""
    lengths = np.array([len(r) for r in rows])
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        width = int(lengths[order[at]])
        most = max(1, cells // max(1, int(width * 1.3)))
        end = at + int(np.searchsorted(lengths[order[at : at + most]], max(width * 1.3, width + 16), side="right"))
        end = max(end, at + 1)
        members = order[at:end]
        matrix = np.zeros((len(members), int(lengths[members[-1]])), dtype=rows[members[0]].dtype)
        mask = np.arange(matrix.shape[1]) < lengths[members][:, None]
        matrix[mask] = np.concatenate([rows[i] for i in members])
        yield members, matrix, lengths[members]
        at = end


def summarise(p: np.ndarray) -> np.ndarray:
    """The document features of one text's marginals."""
    if not len(p):
        return np.array([np.log(1e-6), -14.0, 1.0])
    p = np.minimum(p, 1 - 1e-6)
    top = max(p.max(), 1e-6)
    # Marginals below a hundredth are background; a long text must not add up to toxic.
    return np.array([np.log(1e-6 - np.log1p(-p[p > 0.01]).sum()), np.log(top / (1 - top)), 1.0])


def document_marginals(texts: list[str | None], model: Model, potentials: Potentials) -> list[np.ndarray]:
    rows = []
    for text in texts:
        words = _WORD.findall(text or "")
        rows.append(np.fromiter(map(potentials.__getitem__, words), np.float64, len(words)))
    return _row_marginals(rows, model)


def _row_marginals(rows: list[np.ndarray], model: Model) -> list[np.ndarray]:
    out = [np.zeros(0)] * len(rows)
    for members, matrix, lengths in _padded(rows):
        p = marginals(matrix, lengths, model)
        for i, row, n in zip(members, p, lengths):
            out[i] = row[:n]
    return out


def _near_key(words: np.ndarray) -> int:
    """The least hash of a text's five-word shingles, of word numbers: near copies mostly share it."""
    mixed = words.astype(np.uint64) + np.uint64(1)
    n = max(1, len(words) - 4)
    total = np.zeros(n, np.uint64)
    for k in range(min(5, len(words))):
        total = total * np.uint64(0x9E3779B97F4A7C15) + mixed[k : k + n]
    total ^= total >> np.uint64(31)
    return int((total * np.uint64(0xBF58476D1CE4E5B9)).min()) if len(words) else 0


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 50) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(x.shape[1]), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _telling(docs: list[np.ndarray], toxic: np.ndarray, of_type: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which features tell of toxic texts, and in how many texts each is.

    A feature tells if nine in ten of its texts or more are toxic, and so many that chance would not
    bring forth even one such feature among all: by texts, and not by occurrences.
    """
    counts = np.zeros((2, int(of_type.max(initial=-1)) + 1), dtype=np.int64)
    for types, y in zip(docs, toxic):
        counts[int(y), np.unique(of_type[np.unique(types)])] += 1
    clean, bad = counts
    n, base = counts.sum(axis=0), toxic.mean()
    share = bad / np.maximum(n, 1)
    gain = bad * np.log(np.maximum(share, 1e-9) / base) + clean * np.log(np.maximum(1 - share, 1e-9) / (1 - base))
    return (share >= 0.9) & (gain >= np.log(max(1, int((n > 1).sum()))) + CERTAINTY), n


def batch_sums(batch: tuple, emission: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, their observed less expected labels, expected transitions) of a batch of padded sequences."""
    matrix, lengths, table = batch
    mask = np.arange(matrix.shape[1]) < lengths[:, None]
    p, expected = marginals(np.where(mask, emission[matrix], 0.0), lengths, model, pairs=True)
    words, place = np.unique(matrix[mask], return_inverse=True)
    return words, np.bincount(place, (table - p)[mask], len(words)), expected


def fit(labelled: Iterable[tuple[str | None, int]]) -> Model:
    """Fit the field and the document score to (text, toxic) rows.

    Words of toxic texts are labelled toxic if one of their features tells of toxic texts; all
    other words, and all words of clean texts, are clean. Texts are held as word numbers. The sample is
    bounded, so the rounds run in one process: dealt to tasks they took 39 s instead of 14 for 3,000 texts.
    """
    types: dict[str, int] = {}
    docs: list[np.ndarray] = []
    labels, seen = [], set()
    for text, y in labelled:
        words = np.array([types.setdefault(w, len(types)) for w in map(str.lower, _WORD.findall(text or ""))], dtype=np.int32)
        key = (_near_key(words), y)
        if key not in seen:  # of near copies one is enough
            seen.add(key)
            docs.append(words)
            labels.append(int(y))
    model, toxic = Model(), np.array(labels, dtype=np.int64)
    if not toxic.any() or toxic.all():
        model.document = np.array([0.0, 0.0, 20.0 if toxic.any() else -20.0])
        return model
    fitted = np.arange(len(docs)) % HELD > 0
    if not toxic[fitted].any():
        fitted[:] = True
    trained, truth_of = [d for d, f in zip(docs, fitted) if f], toxic[fitted]
    sums = np.fromiter((f for w in types for f in features(w)), np.uint32).reshape(-1, 5)
    known, of_type = np.unique(sums, return_inverse=True)
    of_type = of_type.reshape(sums.shape).astype(np.int32)
    telling, often = _telling(trained, truth_of, of_type)
    toxic_type = telling[of_type].any(axis=1)
    used = often >= (3 if (often >= 3).any() else 1)
    place = np.where(used, np.cumsum(used) - 1, -1)[of_type]
    type_of, slot = np.nonzero(place >= 0)
    kind_of, kinds = place[type_of, slot], int(used.sum())
    rows, gold = [], []
    for d, y in zip(trained, truth_of):
        for k in range(0, len(d), SEGMENT):
            rows.append(d[k : k + SEGMENT])
            gold.append(toxic_type[rows[-1]] if y else np.zeros(len(rows[-1]), dtype=bool))
    batches = []
    observed = np.zeros((2, 2))
    for members, matrix, lengths in _padded(rows, 1 << 19):
        mask = np.arange(matrix.shape[1]) < lengths[:, None]
        table = np.zeros(matrix.shape, dtype=bool)
        table[mask] = np.concatenate([gold[i] for i in members])
        batches.append((matrix.astype(np.int32), lengths, table))
        a, b, live = table[:, :-1], table[:, 1:], mask[:, 1:]
        observed += [[(~a & ~b & live).sum(), (~a & b & live).sum()], [(a & ~b & live).sum(), (a & b & live).sum()]]
    # Transitions start from their counts; their gradient then moves them with the weights.
    smooth = observed + np.array([[1.0, 0.1], [0.1, 0.1]])
    model.transition = 0.5 * np.log(smooth / smooth.sum(axis=1, keepdims=True) / (smooth.sum(axis=0) / smooth.sum()))
    weights, bias = np.zeros(kinds), model.bias
    rates = np.full(kinds, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(EPOCHS):
        emission = bias + np.bincount(type_of, weights[kind_of], len(types))
        by_type, expected = np.zeros(len(types)), np.zeros((2, 2))
        for words, sums, pairs in (batch_sums(b, emission, model) for b in batches):
            by_type[words] += sums
            expected += pairs
        slope = np.bincount(kind_of, by_type[type_of], kinds) - 0.01 * weights, by_type.sum(), observed - expected
        rates = tuple(r + g * g for r, g in zip(rates, slope))
        weights = weights + 0.8 * slope[0] / np.sqrt(rates[0])
        bias += 0.2 * slope[1] / np.sqrt(rates[1])
        model.transition = model.transition + 0.05 * slope[2] / np.sqrt(rates[2])
    model.bias = float(bias)
    model.weights = {int(f): float(w) for f, w in zip(known[used], weights) if abs(w) > 1e-3}
    judged = ~fitted if len(set(toxic[~fitted].tolist())) == 2 else np.ones(len(docs), dtype=bool)
    emission = model.bias + np.bincount(type_of, weights[kind_of], len(types))
    x = np.array([summarise(p) for p in _row_marginals([emission[d] for d, j in zip(docs, judged) if j], model)])
    model.document = _logistic(x, toxic[judged].astype(np.float64), 0.1)
    return model


def training_sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """(text, toxic, order, id) of at most ``bound`` labelled rows whose id's checksum modulo 5 is not 0, and of those what SAMPLE_CHARS hold, in one partition by order and id."""
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
        .where("_id is not null and _toxic is not null and crc32(encode(cast(_id as string), 'UTF-8')) % 5 <> 0")
        .groupBy("_id")
        .agg(F.max("_toxic").alias("_toxic"))
        .orderBy(F.md5(F.col("_id").cast("string")), "_id")
        .limit(bound)
    )
    # The limit bounds what is broadcast and what one task gets.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).withColumn("_order", F.md5(F.col("_id").cast("string"))).orderBy("_order", "_id").limit(bound)
    # A window over as many rows as the bound.
    room = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.orderBy("_order", "_id").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("_room", room).where(F.col("_room") <= SAMPLE_CHARS)
    return found.select("text", F.col("_toxic").alias("toxic"), F.col("_order").alias("order"), F.col("_id").alias("id")).coalesce(1).sortWithinPartitions("order", "id")


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> list[tuple[str | None, int]]:
    """The (text, toxic) rows of training_sample."""
    return [(r["text"], r["toxic"]) for r in training_sample(docs, labels, bound).select("text", "toxic").collect()]


def fit_sample(sample: DataFrame) -> Model:
    """``fit`` of the rows of training_sample, in the task that has them: the driver gets the model alone, neither texts nor what fitting needs."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((t.as_py(), y.as_py()) for batch in batches for t, y in zip(batch.column(0), batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["model"])

    found = sample.select("text", "toxic").mapInArrow(kernel, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([])


def _scored(texts: list[str | None], model: Model, potentials: Potentials) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(document scores, words' marginals) of the texts, about CHARS characters at a time."""
    sizes, at = np.cumsum([len(t or "") for t in texts]), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHARS, side="right")))
        found = document_marginals(texts[at:end], model, potentials)
        x = np.array([summarise(p) for p in found])
        yield 1 / (1 + np.exp(-np.clip(x @ model.document, -30, 30))), found
        at = end


_SCORES = "doc_id long, score double, predicted int, spans array<struct<start:int,end:int,score:double>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, spans): document scores, and where words are toxic by their marginals.

    Spans are stretches of words of marginal 0.5 or more, as character offsets with their largest
    marginal. Null and empty texts get the score of a text without toxic words and no spans;
    repeated rows score alike; null ids stay; an empty table gives no rows; other columns are ignored.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # bounded by the sample it was fitted on

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, potentials = shared.value, worker_potentials(name, shared)
        for batch in batches:
            texts, at = batch["text"].tolist(), 0
            for scores, found in _scored(texts, model, potentials):
                end = at + len(scores)
                spans = [toxic_spans(t, p) for t, p in zip(texts[at:end], found)]
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[at:end].to_numpy(), "score": scores, "predicted": (scores >= 0.5).astype(np.int32), "spans": spans})
                at = end

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(kernel, _SCORES)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns whatever they are called, whose text scores below 0.5.

    Null and empty texts score as a text without toxic words; repeated rows are judged alike; an
    empty table gives no rows.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    names = docs.columns

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        potentials = worker_potentials(name, shared)
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            clean = [scores < 0.5 for scores, _ in _scored(texts, shared.value, potentials)]
            yield batch.filter(pa.array(np.concatenate(clean) if clean else [], pa.bool_()))

    return docs.mapInArrow(kernel, docs.schema)


def toxic_spans(text: str | None, p: np.ndarray) -> list[dict]:
    hot = np.flatnonzero(p >= 0.5)
    if not len(hot):
        return []
    places = [m.span() for m in _WORD.finditer(text or "")]
    out: list[dict] = []
    before = -2
    for k in hot.tolist():
        if k == before + 1:
            out[-1]["end"], out[-1]["score"] = places[k][1], max(out[-1]["score"], float(p[k]))
        else:
            out.append({"start": places[k][0], "end": places[k][1], "score": float(p[k])})
        before = k
    return out
