"""Language-model scores of documents: a probabilistic suffix tree over bytes, and word counts as a base."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import written

#: Bytes of the longest context, and of the texts of a block.
DEPTH = 4
BLOCK_BYTES = 16 << 20
#: Bytes that UTF-8 never has: what stands before a text, and the symbol after its last byte.
START, END = 0xFE, 0xFF
#: Symbols that a state can be followed by: all bytes but START.
SYMBOLS = 255
#: Positions that are counted, and that are scored, at once.
CHUNK, SCORED = 1 << 21, 1 << 18

#: Lowers A-Z; the two bytes that are taken, which no valid text has, become a third such.
TABLE = bytes(b + 32 if 65 <= b <= 90 else min(b, 0xFD) for b in range(256))

#: The text of a row is compressed, as it is written once and shuffled once.
ROWS = "doc_id long, trained boolean, text binary, block long"


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lower-case A-Z and number blocks of up to ``BLOCK_BYTES`` of neighbouring texts; a longer text is a block of its own."""
    block, size, pack = TaskContext.get().partitionId() << 32, 0, zstandard.ZstdCompressor().compress
    for batch in batches:
        texts, blocks = [x.as_py().translate(TABLE) for x in batch.column("text")], []
        for text in texts:
            if size and size + len(text) > BLOCK_BYTES:
                block, size = block + 1, 0
            size += len(text) + 1
            blocks.append(block)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("trained"), pa.array(map(pack, texts), pa.binary()), pa.array(blocks)], names=["doc_id", "trained", "text", "block"])


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[bool]]]:
    """(block, texts, trained) of runs of rows with the same block."""
    now, texts, trained, unpack = None, [], [], zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for block, text, train in zip(*(batch.column(c).to_pylist() for c in ("block", "text", "trained")), strict=True):
            if block != now and texts:
                yield now, texts, trained
                texts, trained = [], []
            now = block
            texts.append(unpack(text))
            trained.append(train)
    if texts:
        yield now, texts, trained


def grams(texts: list[bytes], depth: int, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of (gram, place of its text): each byte and END of the texts as a number, after the ``depth`` bytes before it."""
    data = np.frombuffer(b"".join(bytes([START]) * depth + t + bytes([END]) for t in texts), np.uint8)
    ends = np.cumsum([depth + len(t) + 1 for t in texts])
    for k in range(0, len(data) - depth, chunk):
        part = data[k : k + chunk + depth].astype(np.int64)
        count = len(part) - depth
        code = np.zeros(count, np.int64)
        for j in range(depth + 1):
            code = code << 8 | part[j : j + count]
        at = np.flatnonzero(part[depth:] != START)
        yield code[at], np.searchsorted(ends, at + k + depth, side="right")


def count_grams(depth: int):
    """(block, gram, n): how often the training texts of a block have each gram that any of its texts has."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts, trained in by_block(batches):
            train, codes, times = np.array(trained), np.zeros(0, np.int64), np.zeros(0, np.int64)
            for code, at in grams(texts, depth, CHUNK):
                mine = train[at]
                some, n = np.unique(code[mine], return_counts=True)
                rest = np.unique(code[~mine])
                both = np.concatenate([codes, some, rest])
                order = np.argsort(both, kind="stable")
                both = both[order]
                first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
                codes, times = both[first], np.add.reduceat(np.concatenate([times, n, np.zeros(len(rest), np.int64)])[order], first)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), block)), pa.array(codes), pa.array(times)], names=["block", "gram", "n"])

    return counted


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, word, n): how often the training texts of a block have each word that any has; the end of a text is the empty word."""
    for block, texts, trained in by_block(batches):
        words: Counter = Counter()
        for text, train in zip(texts, trained, strict=True):
            if train:
                words.update(text.split())
        words[b""] = sum(trained)
        for text, train in zip(texts, trained, strict=True):
            if not train:
                for w in text.split():
                    words.setdefault(w, 0)
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(words), pa.int64()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["block", "word", "n"])


def suffix_tree(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, p, state): the probability of each gram's last byte after the others, and the length of the state it comes from.

    ``counts`` is (gram, n), n being 0 where only other texts have the gram. A context is kept as a
    state if what its next bytes gain in likelihood over those of the context without its first byte,
    n * ln(share / share there) summed over them, is more than half the log of all n. The empty
    context is always a state. A state's distribution takes the weight of its different next bytes
    from that of the longest state which is its suffix (Witten and Bell), down to equal shares of
    all symbols; where a context is no state its longest suffix that is one stands for it.

    Contexts are worked out from the empty one down. A level is a sum by shorter gram, a join to the
    level above and a window over a context, which at most 256 symbols follow.
    """
    levels = [counts.groupBy("gram").agg(F.sum("n").alias("n"))]
    for d in range(depth, 0, -1):
        levels.insert(0, levels[0].groupBy((F.col("gram").bitwiseAND(F.lit((1 << 8 * d) - 1))).alias("gram")).agg(F.sum("n").alias("n")))
    of = Window.partitionBy(F.shiftright("gram", 8))
    size, kinds = F.sum("n").over(of), F.sum((F.col("n") > 0).cast("long")).over(of)
    smooth = lambda below: F.when(F.col("size") > 0, (F.col("n") + F.col("kinds") * below) / (F.col("size") + F.col("kinds"))).otherwise(below)
    now = levels[0].withColumns({"size": size, "kinds": kinds}).select("gram", "n", "size", smooth(F.lit(1 / SYMBOLS)).alias("p"), F.lit(0).alias("state"), F.col("size").alias("total"))
    for d in range(1, depth + 1):
        up = now.select(F.col("gram").alias("up"), F.col("n").alias("n_up"), F.col("size").alias("size_up"), F.col("p").alias("p_up"), F.col("state").alias("state_up"), "total")
        level = levels[d].withColumns({"size": size, "kinds": kinds, "up": F.col("gram").bitwiseAND(F.lit((1 << 8 * d) - 1))}).join(up, "up")
        term = F.when(F.col("n") > 0, F.col("n") * F.ln(F.col("n") / F.col("size") / (F.col("n_up") / F.col("size_up")))).otherwise(0.0)
        keep = F.sum(term).over(of) > F.ln("total") / 2
        level = level.withColumn("keep", keep)
        now = level.select("gram", "n", "size", F.when(F.col("keep"), smooth(F.col("p_up"))).otherwise(F.col("p_up")).alias("p"), F.when(F.col("keep"), d).otherwise(F.col("state_up")).alias("state"), "total")
    return now.select("gram", "p", "state")


def score_block(depth: int):
    """Sums of a block's documents from what its grams and words came back with."""

    def scored(texts: pa.Table, facts: pa.Table) -> pa.Table:
        gram, value = facts["gram"].combine_chunks(), np.asarray(facts["value"].combine_chunks())
        is_word = np.asarray(gram.is_null())
        codes, logs = np.asarray(gram.drop_null()), value[~is_word]
        order = np.argsort(codes)
        codes, logs = codes[order], logs[order]
        times = dict(zip(facts["word"].combine_chunks().drop_null().to_pylist(), value[is_word].tolist(), strict=True))
        unpack = zstandard.ZstdDecompressor().decompress
        raw = [unpack(x.as_py()) for x in texts["text"]]
        score = np.zeros(len(raw))
        for code, at in grams(raw, depth, SCORED):
            place = np.searchsorted(codes, code)
            if (codes[np.minimum(place, len(codes) - 1)] != code).any():
                raise RuntimeError("a gram of a block came back without its probability")
            score += np.bincount(at, logs[place], len(raw))
        tokens, known, base = [], [], []
        for text in raw:
            c = np.fromiter(map(times.__getitem__, text.split()), float)
            c = np.append(c, times[b""])
            tokens.append(len(c))
            known.append(int((c > 0).sum()))
            base.append(float(np.log10(c + 0.5).sum()))
        new = [int(np.count_nonzero(np.asarray(facts["first"].combine_chunks()) & (value > 0) & is_word))] + [0] * (len(raw) - 1)
        return pa.table({"doc_id": texts["doc_id"], "trained": texts["trained"], "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()), "logs": pa.array(base), "score": pa.array(score), "new": pa.array(new, pa.int64())})

    return scored


def lm_scores(docs: DataFrame, trained: Column, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    ``trained`` is a condition for the rows to learn from; a null counts as yes. The model is a
    suffix tree over the bytes of all training texts (A-Z lowered) and an end symbol; ``score`` is
    log10 of the probability of a text's bytes and its end. ``base_score`` adds up words, as
    log10((c + 0.5) / (N + 0.5 * (V + 1))). A null text is an empty one, which has an end alone;
    repeated rows are learnt from and scored each, an empty table gives no rows, a table without
    training rows scores by equal shares, other columns are ignored.

    Texts are dealt into blocks of bounded size. A block asks once for each different gram and word
    that it has, whatever their number in the corpus; sums over all blocks answer, and block and
    answers meet by block. So the model is as large as the corpus makes it, is never in one place, and
    no key has more rows than there are blocks.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(trained, F.lit(True)).alias("trained"), text.alias("text")).mapInArrow(in_blocks, ROWS))
    slim = rows.select("block", "trained", "text")
    asked = written(slim.mapInArrow(count_grams(depth), "block long, gram long, n long"))
    tree = suffix_tree(asked.select("gram", "n"), depth)
    by_gram = asked.join(tree, "gram").select("block", "gram", F.lit(None).cast("binary").alias("word"), F.log10("p").alias("value"), F.lit(False).alias("first"))
    of = Window.partitionBy("word")
    by_word = slim.mapInArrow(count_words, "block long, word binary, n long").select(
        "block", F.lit(None).cast("long").alias("gram"), "word", F.sum("n").over(of).cast("double").alias("value"), (F.min("block").over(of) == F.col("block")).alias("first")
    )
    facts = by_gram.unionByName(by_word)
    scored = written(
        rows.groupBy("block")
        .cogroup(facts.groupBy("block"))
        .applyInArrow(score_block(depth), "doc_id long, trained boolean, n_tokens long, n_known long, logs double, score double, new long")
    )
    # One row: the tokens learnt from and how many are different.
    sums = scored.agg(F.coalesce(F.sum(F.when(F.col("trained"), F.col("n_tokens"))), F.lit(0)).cast("long").alias("train_tokens"), F.coalesce(F.sum("new"), F.lit(0)).alias("v"))
    return scored.crossJoin(F.broadcast(sums)).select(
        "doc_id",
        (~F.col("trained")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        (F.col("logs") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.5 * (F.col("v") + 1))).alias("base_score"),
        "score",
    )
