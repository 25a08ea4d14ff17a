"""Tables in files: loaders of CSV, sinks of results with their journal, and a cache of series that fetches only gaps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import transforms as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of its own only for a local master, as a cluster could not share it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewatch-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` worked out once, kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast: Spark sizes what an explode makes as the rows it is made of."""
    return df.hint("merge")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


# --- loaders -------------------------------------------------------------------------------------


def load_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Rows of CSV files by a given schema; quotes may hold line breaks; a row that does not fit raises when it is read."""
    return spark.read.csv(path, schema=schema, header=header, multiLine=True, escape='"', mode="FAILFAST")


def load_workload(spark: SparkSession, path: str) -> DataFrame:
    """(sql, duration) of a training or prediction file: the duration is the last column, and NULL where there is none."""
    return load_csv(spark, path, "sql string, duration double", header=False).where(F.trim("sql") != "")


# --- sinks ---------------------------------------------------------------------------------------

#: What the tables of results are keyed by, and by what they are dealt in folders.
TABLES = {
    "history_alarms": (("instance", "type", "start_at", "metric"), "instance"),
    "future_alarms": (("instance", "metric", "start_at"), "instance"),
    "slow_queries": (("hash1", "hash2"), None),
    "slow_queries_journal": (("statement_id", "start_at", "instance"), "instance"),
    "killed_queries": (("instance", "start_at", "query"), "instance"),
    "index_recommendations": (("instance", "db", "table_name", "columns"), "instance"),
    "knob_recommendations": (("instance", "name"), "instance"),
    "metric_forecasts": (("instance", "metric", "ts_ms"), "instance"),
    "regular_inspections": (("instance", "kind", "start_at"), "instance"),
}


def append(df: DataFrame, folder: str, table: str) -> None:
    """Rows added to a table; its files are dealt by the column that reads filter on."""
    _, by = TABLES[table]
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by and by in df.columns else writer).parquet(f"{folder}/{table}")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}")


def missing(df: DataFrame, folder: str, table: str) -> DataFrame:
    """The rows whose key the table does not have yet, each key once, so that a repeated write adds nothing."""
    keys = [k for k in TABLES[table][0] if k in df.columns]
    fresh = df.dropDuplicates(keys)
    spark = df.sparkSession
    if not exists(spark, f"{folder}/{table}"):
        return fresh
    return fresh.join(read(spark, folder, table).select(*keys), keys, "left_anti")


def record(df: DataFrame, folder: str, table: str) -> None:
    append(missing(df, folder, table), folder, table)


def retain(spark: SparkSession, folder: str, table: str, time: str, since: int) -> str:
    """A new version of a table without rows older than ``since``; returns its folder, for the caller to swap in."""
    kept = f"{folder}/{table}-{uuid.uuid4().hex}"
    read(spark, folder, table).where(F.col(time) >= since).write.parquet(kept)
    return kept


# --- samples ---------------------------------------------------------------------------------------

#: Labels that stored samples have as columns of their own, besides the map of all.
PROMOTED = ("from_instance", "instance")


def write_samples(samples: DataFrame, folder: str, promoted: tuple[str, ...] = PROMOTED, mode: str = "append") -> None:
    """Samples (name, labels, ts_ms, value) in a folder for each metric, in files by series and time.

    Rows are dealt into ranges of (metric, series, time), so a file's row groups have narrow bounds of
    time and of the promoted labels, and a reader skips those that a selection cannot meet.
    """
    from tidewatch.sources.series import series_key

    keyed = samples.select("name", "labels", series_key().alias("series"), "ts_ms", "value", *(F.col("labels")[k].alias(f"label_{k}") for k in promoted))
    order = ["name", "series", "ts_ms"]
    width = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed.repartitionByRange(width, *order).sortWithinPartitions(*order).write.mode(mode).partitionBy("name").parquet(folder)


def metric_names(spark: SparkSession, folder: str) -> list[str]:
    """The metrics that a folder of samples has, by the names of its parts; no file is opened."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    plain = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    names = [x.getPath().getName() for x in found if x.isDirectory()]
    return sorted(plain(n.removeprefix("name=")) for n in names if n.startswith("name="))


# --- series cache --------------------------------------------------------------------------------


class SeriesCache:
    """Samples on a grid of ``step`` in files, with the ranges that they cover; only what is not covered is fetched.

    ``fetch`` takes a DataFrame of (keys, start_ms, end_ms) and returns (keys, ts_ms, value). Keys are
    compared by equality; a range that was fetched counts as covered also where it has no samples.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], step: int, fetch: Callable[[DataFrame], DataFrame]):
        self.spark, self.folder, self.keys, self.step, self.fetch = spark, folder, keys, step, fetch

    def _read(self, name: str) -> DataFrame | None:
        path = f"{self.folder}/{name}"
        return self.spark.read.parquet(path) if exists(self.spark, path) else None

    def gaps(self, asked: DataFrame, start: int, end: int) -> DataFrame:
        """(keys, start_ms, end_ms): what of the asked series' range is not covered."""
        asked = asked.select(*self.keys).distinct()
        whole = (F.lit(start).cast("long").alias("start_ms"), F.lit(end).cast("long").alias("end_ms"))
        known = self._read("covers")
        if known is None:
            return asked.select(*self.keys, *whole)
        covers = known.where((F.col("end_ms") >= start) & (F.col("start_ms") <= end)).join(asked, self.keys, "left_semi").select(*self.keys, "start_ms", "end_ms")
        return T.find_gaps(covers, self.keys, start, end, self.step).unionByName(asked.join(covers, self.keys, "left_anti").select(*self.keys, *whole))

    def get(self, asked: DataFrame, start: int, end: int, now: int = 0) -> DataFrame:
        """(keys, ts_ms, value) from start to end, rounded outward to the grid, of every series in ``asked`` (keys)."""
        start, end = start - start % self.step, end + -end % self.step
        asked = asked.select(*self.keys).distinct()
        gaps = self.gaps(asked, start, end).withColumn("fetched_at", F.lit(now).cast("long"))
        path = scratch(self.spark)  # written, so that what is fetched is what is then covered
        gaps.write.parquet(path)
        gaps = self.spark.read.parquet(path)
        if not gaps.isEmpty():
            self.fetch(gaps.drop("fetched_at")).select(*self.keys, "ts_ms", "value").withColumn("fetched_at", F.lit(now).cast("long")).write.mode("append").parquet(f"{self.folder}/samples")
            gaps.write.mode("append").parquet(f"{self.folder}/covers")
        stored = self._read("samples").join(asked, self.keys, "left_semi").where(F.col("ts_ms").between(start, end))
        return stored.groupBy(*self.keys, "ts_ms").agg(F.max_by("value", "fetched_at").alias("value"))

    def prune(self, since: int) -> SeriesCache:
        """A cache in a new folder with what was fetched at or after ``since``."""
        fresh = SeriesCache(self.spark, f"{self.folder}-{uuid.uuid4().hex}", self.keys, self.step, self.fetch)
        for name in ("samples", "covers"):
            if (old := self._read(name)) is not None:
                old.where(F.col("fetched_at") >= since).write.parquet(f"{fresh.folder}/{name}")
        return fresh
