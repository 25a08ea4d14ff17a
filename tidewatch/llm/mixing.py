"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, global_prefix

MAX_EPOCHS = 3
SEED = "mix-1"


def count_words(text: Column) -> Column:
    """Number of runs of characters other than space, tab and the four line and page controls."""
    gaps = F.size(F.split(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), "[ \\t-\\r]+", -1)) - 2
    return F.greatest(gaps, F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to (source, source_size, n): shares by weight 1, 2, 3, ... clamped at max_epochs.

    Clamping a source and resharing its excess by weight ends at one water level L, where each
    target is the smaller of its cap and L times its weight. Sources sorted by cap per weight are
    clamped in a prefix, and L is what is left over for the rest, by weight: the level of the first
    source that is not clamped, also where others tie with its cap per weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_cap = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    levels = (
        sources.withColumn("_place", F.row_number().over(by_name))
        .withColumn("rows_first", F.sum("n").over(by_name.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
        .withColumn("_weight", ((F.col("_place") - 1) % 3 + 1).cast("long"))
        .withColumn("_cap", F.col("source_size") * max_epochs)
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_spent", F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cap"))
        .withColumn("_left", F.sum("_weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_spent")) / F.col("_left"))
        .withColumn("_open", F.col("_cap") > F.col("_level") * F.col("_weight"))
        .withColumn("_rank", F.row_number().over(by_cap))
        .withColumn("_water", F.min_by(F.when(F.col("_open"), F.col("_level")), F.when(F.col("_open"), F.col("_rank"))).over(everything))
    )
    return levels.select(
        "source",
        "source_size",
        "rows_first",
        F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_water") * F.col("_weight"), F.col("_cap"))).alias("target"),
    )


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, epochs, *carry): how many words the mix takes of each document.

    Every document of a source is taken floor(target / source_size) times whole, and a seeded
    systematic sample of the source, in order of size and of a seeded digest, once more, so the
    words taken stay within about one document of the target. Null text has size 0, null sources
    form one source that comes last, repeated rows count each, an empty table gives no rows,
    other columns are ignored.
    """
    slim = cut(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), *carry))
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = water_fill(sources, max_epochs)
    keyed = slim.withColumn("_draw", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("_draw"), F.col("doc_id")]
    placed = global_prefix(keyed, order, "size").alias("p")
    # No hint: Spark broadcasts the targets only while their size is below its own threshold.
    joined = placed.join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("p.source"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return (
        joined.select("p.doc_id", "p.size", *(f"p.{c}" for c in carry), "source_size", "target", ratio.alias("_r"), start.alias("_u"), (F.col("rows_before") - F.col("rows_first")).alias("_i"))
        .withColumn("_whole", F.floor("_r"))
        .withColumn("_part", F.col("_r") - F.col("_whole"))
        .withColumn("_more", F.floor((F.col("_i") + 1) * F.col("_part") + F.col("_u")) - F.floor(F.col("_i") * F.col("_part") + F.col("_u")))
        .withColumn("epochs", (F.col("_whole") + F.col("_more")).cast("long"))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"), "epochs", *carry)
    )


def mixed_rows(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of ``docs``, with all its columns whatever they are called, as often as its epochs say.

    Rows with the same id and text are interchangeable, so their epochs are added up and dealt
    evenly. Null texts have size 0 and are taken as their source is; null ids count as one id; an
    empty table gives no rows.
    """
    key = F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key")
    share = (
        mix(docs.select("doc_id", "text", "source", F.xxhash64("text").alias("h")), max_epochs, seed, carry=("h",))
        .groupBy(F.struct("doc_id", "h").alias("key"))
        .agg(F.sum("epochs").alias("all"), F.count(F.lit(1)).alias("n"))
    )
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key)
    dealt = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("key"))).join(share, "key")
    times = F.expr("cast(all div n + if(nth <= all % n, 1, 0) as int)")
    return dealt.select("row", times.alias("times")).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
