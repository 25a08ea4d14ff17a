"""Merkle manifest of a dataset: a tree for each source, one above them, and a proof for each row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import ascii_lower, cut, shuffle_width, written

#: Nodes under one parent, and how many digits of a rank are grouped away within one block.
FAN = 16
DIGITS = 3
BLOCK = FAN**DIGITS


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(text: Column) -> Column:
    """Digest of a row's five columns with ``text`` as its text: each ``-`` if null, else its UTF-8 byte count, a colon and its value."""

    def field(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text)))


def ranked(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """Add ``rank`` (from 0) in ``order`` within ``tree`` and ``size``, the rows of the tree.

    Rows are dealt into ranges of (tree, order). What the ranges hold of each tree is at most one
    row for each range and one for each tree, so offsets are a window over a slim table, and no
    task sees more than a range, however large a tree is.
    """
    by = [F.col(tree).asc_nulls_first(), *order]
    ranged = cut(rows.repartitionByRange(shuffle_width(rows.sparkSession), *by).withColumn("_range", F.spark_partition_id()))
    of_tree = Window.partitionBy("_tree")
    offsets = (
        ranged.groupBy(F.col("_range").alias("_r"), F.col(tree).alias("_tree"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "_r",
            "_tree",
            F.coalesce(F.sum("_n").over(of_tree.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
            F.sum("_n").over(of_tree).alias("size"),
        )
    )
    within = Window.partitionBy("_range", tree).orderBy(*order)
    return (
        ranged.withColumn("_row", F.row_number().over(within))
        .join(offsets, (F.col("_range") == F.col("_r")) & F.col(tree).eqNullSafe(F.col("_tree")))
        .withColumn("rank", F.col("_before") + F.col("_row") - 1)
        .drop("_range", "_r", "_tree", "_row", "_before")
    )


def nodes_at(size: Column, level: int) -> Column:
    """Nodes that a tree of ``size`` leaves has ``level`` levels up."""
    return F.ceil(size / F.lit(FAN**level)).cast("long")


def blocks_of(nodes: DataFrame) -> DataFrame:
    """(tree, block, size, hash, kids) from nodes (tree, rank, size, hash, data): subtrees of ``BLOCK`` nodes as nested structs.

    The digits of a rank are grouped away from the last one up; each grouping nests the structs of
    the one before. Rows are shuffled once, by tree and block, and a block is bounded.
    """
    digit = [F.expr(f"cast(rank div {FAN**k} % {FAN} as int)").alias(f"d{k}") for k in range(DIGITS)]
    now = nodes.select("tree", "size", F.expr(f"rank div {BLOCK}").alias("block"), *digit, "hash", F.col("data").alias("kids"))
    now = now.repartition("tree", "block")
    for k in range(DIGITS):
        above = [f"d{j}" for j in range(k + 1, DIGITS)]
        now = now.groupBy("tree", "block", "size", *above).agg(F.array_sort(F.collect_list(F.struct(F.col(f"d{k}").alias("digit"), "hash", "kids"))).alias("kids"))
        joined = F.array_join(F.transform("kids", lambda kid: kid["hash"]), "")
        now = now.withColumn("hash", F.when(nodes_at(F.col("size"), k) > 1, digest(joined)).otherwise(F.col("kids")[0]["hash"]))
    return now.select("tree", "block", "size", "hash", "kids")


def proofs(nodes: DataFrame, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(tree, hash, data, path, subroot, root) for every node: ``path`` holds what stands before and after it, level by level.

    Trees of more than a block are rolled up from their blocks' digests in the same way. A block
    meets the path above it by grouping both on (tree, block); then structs are transformed and
    exploded a digit at a time, so that a task holds one block. ``above`` gives (tree, block, path,
    subroot, root) for trees that have come to one node.
    """
    blocks = written(blocks_of(nodes))
    tops = blocks.select("tree", F.col("block").alias("rank"), nodes_at(F.col("size"), DIGITS).alias("size"), "hash")
    if (tops.agg(F.max("size")).first()[0] or 0) > 1:
        over = proofs(tops.withColumn("data", F.struct("rank")), above).select("tree", F.col("data.rank").alias("block"), "path", "subroot", "root")
    else:
        over = above(tops)
    both = blocks.select("tree", "block", "size", "kids").unionByName(over, allowMissingColumns=True)
    now = both.groupBy("tree", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("size", "kids", "path", "subroot", "root")))
    for k in reversed(range(DIGITS)):
        now = now.withColumn("all", F.transform("kids", lambda kid: kid["hash"]))
        step = lambda i: F.struct(F.array_join(F.slice("all", F.lit(1), i), "").alias("before"), F.array_join(F.slice("all", i + 2, F.lit(FAN)), "").alias("after"))
        now = now.withColumn("e", F.explode(F.transform("kids", lambda kid, i: F.struct(kid.alias("kid"), step(i).alias("step")))))
        path = F.when(nodes_at(F.col("size"), k) > 1, F.concat(F.array("e.step"), "path")).otherwise(F.col("path"))
        now = now.select("tree", "size", F.col("e.kid.hash").alias("hash"), F.col("e.kid.kids").alias("kids"), path.alias("path"), "subroot", "root")
    return now.select("tree", "hash", F.col("kids").alias("data"), "path", "subroot", "root")


def above_sources(subroots: DataFrame) -> DataFrame:
    """The tree over all sources' subroots, in order of source: null first, then by UTF-8 bytes."""
    named = ranked(subroots.select(F.lit(0).alias("top"), F.col("tree").alias("source"), "hash"), "top", [F.col("source").asc_nulls_first()])
    nodes = named.select(F.col("top").alias("tree"), "rank", "size", "hash", F.struct("source").alias("data"))
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    last = lambda tops: tops.select("tree", F.col("rank").alias("block"), nothing.alias("path"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    return proofs(nodes, last).select(F.col("data.source").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("hash").alias("subroot"), "root")


def folded(path: Column, leaf: Column) -> Column:
    """The root that ``leaf`` leads to by ``path``."""
    return F.aggregate(path, leaf, lambda below, step: digest(F.concat(step["before"], below, step["after"])))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    Per source, leaves ascend by doc_id; every 16 consecutive nodes (the last run fewer) become
    their digest until one is left, and the sources' subroots likewise. Where ``tampered`` holds,
    the root is folded from a leaf whose text has A-Z lower-cased, so it is verified only if there
    was nothing to lower. Null fields count as ``-`` (an empty text as ``0:``), null ids come first
    and rows with the same id are ordered by leaf, repeated rows have a leaf each, null is a source
    of its own, an empty table gives no rows, other columns are ignored.
    """
    tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    leaves = docs.select("doc_id", "source", leaf_digest(F.col("text")).alias("leaf"), F.when(tampered, leaf_digest(ascii_lower(F.col("text")))).alias("altered"))
    nodes = ranked(leaves, "source", [F.col("doc_id").asc_nulls_first(), F.col("leaf")]).select(
        F.col("source").alias("tree"), "rank", "size", F.col("leaf").alias("hash"), F.struct("doc_id", "altered").alias("data")
    )
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["before"], step["after"])), "")
    return (
        proofs(nodes, above_sources)
        .select(
            F.col("data.doc_id").alias("doc_id"),
            F.col("hash").alias("leaf"),
            "subroot",
            "root",
            digest(siblings).alias("proof_sha256"),
            folded(F.col("path"), F.coalesce(F.col("data.altered"), F.col("hash"))).alias("folded_root"),
        )
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )
