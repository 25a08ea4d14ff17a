"""What several corpus operators share: reading, cutting lineage, global prefix sums, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where the session names none, a local master gets a folder of its own; a cluster is refused, as
    its executors would not share the driver's folder.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewatch-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the shared folder; for slim tables."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again; for wide or large tables, which it compresses."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave all other characters alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def join_hot(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int, share: int = 1000) -> DataFrame:
    """``rows`` inner-joined to ``facts`` on ``key``, which is unique and not null in ``facts``; ``weight`` is dropped.

    ``weight`` is how many of the ``total`` rows a key has. Fewer than ``share`` keys can have more
    than a ``share``-th of all rows; these are broadcast, so their rows stay where they are. The
    rows of all other keys are shuffled, and no key puts more than that share in one task. Facts are
    worked out once; where no key is that frequent, the join is a plain one.
    """
    facts, hot = written(facts), F.col(weight) * share > total
    if facts.where(hot).isEmpty():
        return rows.join(facts.drop(weight), key)
    often = F.broadcast(facts.where(hot).drop(weight).withColumn("_hot", F.lit(True)))
    tagged = rows.join(often, key, "left")
    rest = tagged.where("_hot is null").select(*rows.columns).join(facts.where(~hot).drop(weight), key)
    return tagged.where("_hot").drop("_hot").unionByName(rest)


#: What a worker process keeps between tasks, for one operator at a time.
_KEPT: dict = {}


def kept(key, make):
    """``make()``, once for each worker process; what another key kept is let go, so that workers do not fill up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def global_prefix(df: DataFrame, order: list[Column], value: str) -> DataFrame:
    """Add ``rows_before``, ``sum_before`` and ``sum_total``: rows and sum of ``value`` ahead of each row in ``order``, and of all.

    Rows are dealt into ranges of the order, each range is summed, the few range totals are
    accumulated, and every range then adds its own running sum to its offset; no task sees more
    than a range, and ties fall in any order among equal rows only if ``order`` is total.
    """
    spark = df.sparkSession
    ranged = cut(df.repartitionByRange(shuffle_width(spark), *order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range")
        .agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
        .select(
            "_range",
            F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum0"),
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows0"),
            F.sum("_sum").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("sum_total"),
        )
    )
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The offsets hold one row for each shuffle partition at most, so their size is bounded.
    return (
        ranged.withColumn("_row", F.row_number().over(within))
        .withColumn("_run", F.sum(value).over(within))
        .join(F.broadcast(offsets), "_range")
        .withColumn("rows_before", F.col("_rows0") + F.col("_row") - 1)
        .withColumn("sum_before", F.col("_sum0") + F.col("_run") - F.col(value))
        .drop("_range", "_row", "_run", "_sum0", "_rows0")
    )


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component_id) for every node of ``links`` (a, b): the smallest node reachable.

    Alternates large-star and small-star steps. Each step is a minimum per node, which combines
    before the shuffle, and a join back, in which the rows of nodes with very many links are not
    shuffled; lineage is cut every round. Nodes are any ordered type. Raises RuntimeError if
    ``max_rounds`` rounds do not suffice.
    """
    # Written and not checkpointed: a checkpoint keeps what Spark has inferred of the rows, which grows round by round.
    edges = written(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    before, size = None, edges.count()
    for _ in range(max_rounds):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_hot(both.where("v > u"), least, "u", "n", size).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (
            join_hot(large, down, "hi", "n", size)
            .select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .where("hi <> lo")
            .distinct()
        )
        edges = written(small)
        stats = edges.agg(
            F.count(F.lit(1)), F.countDistinct("hi"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))
        ).first()
        if tuple(stats) == before:
            break
        before, size = tuple(stats), stats[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.groupBy("hi").agg(F.min("lo").alias("component_id")).withColumnRenamed("hi", "node")
    roots = stars.select(F.col("component_id").alias("node")).distinct().withColumn("component_id", F.col("node"))
    return stars.unionByName(roots)
