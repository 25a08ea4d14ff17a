"""The forms of the metric query language, over (keys..., ts_ms, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _series(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("ts_ms")


def irate(samples: DataFrame, keys: list[str], window_ms: int) -> DataFrame:
    """Per second, from the last two samples within the window; after a reset the new value is the growth."""
    w = _series(keys)
    before, at = F.lag("value").over(w), F.lag("ts_ms").over(w)
    return (
        samples.withColumn("_v", before)
        .withColumn("_t", at)
        .where(F.col("_t") > F.col("ts_ms") - window_ms)
        .withColumn("value", F.when(F.col("value") < F.col("_v"), F.col("value")).otherwise(F.col("value") - F.col("_v")) / ((F.col("ts_ms") - F.col("_t")) / 1000))
        .drop("_v", "_t")
    )


def increase(samples: DataFrame, keys: list[str], window_ms: int) -> DataFrame:
    """Reset-corrected growth between the samples of (ts - window, ts], without extrapolation to its ends."""
    w = _series(keys)
    before = F.lag("value").over(w)
    growth = F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    grown = samples.withColumn("_grown", F.sum(growth).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    span = w.rangeBetween(-window_ms + 1, 0)
    return (
        grown.withColumn("_first", F.min("_grown").over(span))
        .withColumn("_n", F.count(F.lit(1)).over(span))
        .where("_n > 1")
        .withColumn("value", F.col("_grown") - F.col("_first"))
        .drop("_grown", "_first", "_n")
    )


def extrapolated_increase(samples: DataFrame, keys: list[str], window_ms: int) -> DataFrame:
    """Reset-corrected growth of (ts - window, ts], carried on to the ends of the window.

    The gap to an end counts in full while it is below 1.1 mean gaps between samples, else as half a
    mean gap; at its start a counter is not carried on below zero.
    """
    w = _series(keys)
    span = w.rangeBetween(-window_ms + 1, 0)
    before = F.lag("value").over(w)
    growth = F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    summed = samples.withColumn("_grown", F.sum(growth).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seen = summed.withColumns({"_g0": F.min("_grown").over(span), "_n": F.count(F.lit(1)).over(span), "_t0": F.min("ts_ms").over(span), "_v0": F.first("value").over(span)}).where("_n > 1")
    grown, sampled = F.col("_grown") - F.col("_g0"), F.col("ts_ms") - F.col("_t0")
    mean = sampled / (F.col("_n") - 1)
    start = F.col("_t0") - (F.col("ts_ms") - window_ms)
    to_zero = F.when((grown > 0) & (F.col("_v0") >= 0), sampled * F.col("_v0") / grown)
    carried = F.least(F.when(start < 1.1 * mean, start).otherwise(mean / 2), F.coalesce(to_zero, start))
    # The window ends at its last sample, so there is no gap at its end.
    return seen.withColumn("value", grown * (sampled + carried) / sampled).drop("_grown", "_g0", "_n", "_t0", "_v0")


def rate(samples: DataFrame, keys: list[str], window_ms: int, extrapolated: bool = False) -> DataFrame:
    grown = extrapolated_increase if extrapolated else increase
    return grown(samples, keys, window_ms).withColumn("value", F.col("value") / (window_ms / 1000))


def aggregate_by(samples: DataFrame, how: str, by: list[str]) -> DataFrame:
    """sum, avg, min, max or count of all series at each time, by labels."""
    f = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[how]
    return samples.groupBy(*by, "ts_ms").agg(f("value").cast("double").alias("value"))


def binary(left: DataFrame, right: DataFrame, keys: list[str], op) -> DataFrame:
    """One-to-one arithmetic on equal labels and times; unmatched samples are dropped."""
    r = right.select(*keys, "ts_ms", F.col("value").alias("_right"))
    return left.join(r, [*keys, "ts_ms"]).select(*keys, "ts_ms", op(F.col("value"), F.col("_right")).alias("value"))


def scale(samples: DataFrame, factor: float = 1.0, guard: float = 0.0) -> DataFrame:
    """value * factor / (1 or value + guard): unit scaling."""
    return samples.withColumn("value", F.col("value") * factor if not guard else F.lit(factor) / (F.col("value") + guard))


def compare(samples: DataFrame, condition: Column) -> DataFrame:
    """A comparison drops samples; it makes no booleans."""
    return samples.where(condition)


def topk(samples: DataFrame, k: int, labels: list[str]) -> DataFrame:
    """The k largest at each time; labels break ties."""
    rank = F.row_number().over(Window.partitionBy("ts_ms").orderBy(F.col("value").desc(), *labels))
    return samples.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def strip_port(instance: str = "instance") -> Column:
    """The label without its last :port."""
    return F.regexp_replace(instance, "^(.*):.*$", "$1")


def ratio_left(part: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """1 - part / whole."""
    return binary(part, whole, keys, lambda a, b: 1 - a / b)
