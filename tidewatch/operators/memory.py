"""Checks of an instance's memory and directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import detectors

#: Name of a check, what is used, of what, and the share from which it warns.
RATIOS = (
    ("os_memory", "os_used", "os_total", 0.8),
    ("process_memory", "process_used", "process_max", 0.8),
    ("shared_context", "shared_used", "shared_max", 0.8),
    ("dynamic_memory", "dynamic_used", "dynamic_max", 0.8),
    ("other_memory", "other_used", "process_max", 0.2),
)
#: The figures that must not grow all the time.
GROWING = ("os_used", "process_used", "shared_used", "dynamic_used", "dynamic_peak", "other_used", "session_used")


def memory_ratios(df: DataFrame, key: str) -> DataFrame:
    """(key, check, ratio, warned) for each of RATIOS; without a total the ratio is NULL and nothing is warned."""
    parts = F.array(*(F.struct(F.lit(n).alias("check"), (F.col(used) / F.nullif(F.col(total), F.lit(0))).alias("ratio"), F.lit(limit).alias("limit")) for n, used, total, limit in RATIOS))
    each = df.select(key, F.explode(parts).alias("c"))
    return each.select(key, "c.check", "c.ratio", F.coalesce(F.col("c.ratio") >= F.col("c.limit"), F.lit(False)).alias("warned"))


def continuous_increase(samples: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """(keys, increasing, n): whether each series of at least ``least`` samples increases by Cox and Stuart's test."""
    enough = samples.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_n") >= least).drop("_n")
    return detectors.increase(enough, keys).groupBy(*keys).agg(F.bool_and("is_anomaly").alias("increasing"), F.count(F.lit(1)).alias("n"))


def directory_status(directories: DataFrame, requests: DataFrame, seconds: float, limit: float = 0.7) -> DataFrame:
    """(directory, total, used, free, warned, iops) from (directory, total, used) and (directory, requests) in ``seconds``."""
    load = requests.groupBy("directory").agg((F.sum("requests") / seconds).alias("iops"))
    status = directories.join(load, "directory", "left")
    return status.select("directory", "total", "used", (F.col("total") - F.col("used")).alias("free"), (F.col("used") / F.nullif(F.col("total"), F.lit(0)) >= limit).alias("warned"), F.coalesce("iops", F.lit(0.0)).alias("iops"))


def exporter_health(samples: DataFrame, expected: int, now: int, silence_ms: int) -> DataFrame:
    """(name, instances, state, suggestion) for each metric's exporter: silent, single, partial or normal."""
    n = F.col("instances")
    seen = samples.groupBy("name").agg(F.count_distinct("instance").alias("instances"), F.max("ts_ms").alias("_last"))
    state = F.when(F.col("_last") < now - silence_ms, "silent").when(n >= expected, "normal").when(n > 1, "partial").otherwise("single")
    told = seen.withColumn("state", state)
    advice = F.when(F.col("state") == "silent", "start the exporter or check its address").when(F.col("state").isin("partial", "single"), "deploy the exporter on the other instances")
    return told.select("name", "instances", "state", advice.alias("suggestion"))


def healing_actions(alarms: DataFrame, actions: DataFrame) -> DataFrame:
    """Each alarm with the actions that its cause asks for, in order; ``actions`` has (action, causes array)."""
    by_cause = actions.select(F.explode("causes").alias("cause"), "action").groupBy("cause").agg(F.sort_array(F.collect_set("action")).alias("actions"))
    return alarms.join(by_cause, "cause", "left").withColumn("actions", F.coalesce("actions", F.array().cast("array<string>")))
