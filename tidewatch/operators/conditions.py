"""Detections over several metrics at once, with their forecasts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import detectors as D
from tidewatch.operators import statistics as K


@dataclass(frozen=True)
class Condition:
    """A metric, the detector that judges its series by its arguments, and the step of their grid."""

    metric: str
    detector: str
    step_ms: int
    arguments: dict = field(default_factory=dict)


def judged(samples: DataFrame, condition: Condition, link: str, ahead_ms: int = 0, method: str = "line") -> DataFrame:
    """(link, series, ts_ms, hit, ahead) of a condition's metric.

    Samples are put on the metric's own grid (of a step the last one); the series is carried on by
    ``ahead_ms``, by its line or by season, and the detector sees both as one series. A
    series that has no line (one sample, or all at one time) is judged without a forecast.
    """
    keys = [link, "series"]
    spot = F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(condition.step_ms))
    own = samples.where((F.col("metric") == condition.metric) & F.col("value").isNotNull()).groupBy(*keys, spot.alias("_spot")).agg(F.max_by("value", "ts_ms").alias("value")).withColumnRenamed("_spot", "ts_ms")
    whole = own.withColumn("ahead", F.lit(False))
    steps = ahead_ms // condition.step_ms
    if steps:
        carry = {"line": K.linear_forecast, "season": K.forecast}[method]
        whole = whole.unionByName(carry(own, keys, condition.step_ms, steps).where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("ahead", F.lit(True)))
    found = D.REGISTRY[condition.detector](whole.drop("ahead"), keys, **condition.arguments).select(*keys, "ts_ms", F.coalesce("is_anomaly", F.lit(False)).alias("hit"))
    return found.join(whole.select(*keys, "ts_ms", "ahead"), [*keys, "ts_ms"])


def together(samples: DataFrame, conditions: list[Condition], link: str, tolerance_ms: int, ahead_ms: int = 0, method: str = "line") -> DataFrame:
    """(link, series, others, ts_ms, hit, ahead): at which times of the first condition's series all conditions hold.

    ``samples`` has (metric, link, series, ts_ms, value). Each series of the first metric is set against every combination of
    series of the other metrics that has its ``link`` (an instance, a host); ``others`` names them.
    Another metric's verdict at a time is its last one, if that is no older than ``tolerance_ms``; a
    series whose link has no series of some metric has no rows. Verdicts meet by a window
    over both series in time order, so a combination is sorted once and no pair of samples is made.
    """
    now = judged(samples, conditions[0], link, ahead_ms, method).withColumn("others", F.array().cast("array<string>"))
    for condition in conditions[1:]:
        other = judged(samples, condition, link, ahead_ms, method)
        pairs = now.select(link, "series", "others").distinct().join(other.select(link, F.col("series").alias("other")).distinct(), link)
        asked = now.join(pairs, [link, "series", "others"]).withColumn("verdict", F.lit(None).cast("struct<at:bigint,hit:boolean>"))
        told = other.withColumnRenamed("series", "other").join(pairs, [link, "other"]).select(
            link, "series", "others", "other", "ts_ms", F.lit(None).cast("boolean").alias("hit"), F.lit(None).cast("boolean").alias("ahead"), F.struct(F.col("ts_ms").alias("at"), "hit").alias("verdict")
        )
        # At the same time the other metric's verdict comes first.
        in_time = Window.partitionBy(link, "series", "others", "other").orderBy("ts_ms", F.col("hit").isNotNull())
        met = asked.unionByName(told).withColumn("verdict", F.last("verdict", ignorenulls=True).over(in_time)).where("hit is not null")
        holds = F.col("hit") & F.coalesce(F.col("verdict.hit") & (F.col("ts_ms") - F.col("verdict.at") <= tolerance_ms), F.lit(False))
        now = met.select(link, "series", F.concat("others", F.array("other")).alias("others"), "ts_ms", holds.alias("hit"), "ahead")
    return now.select(link, "series", "others", "ts_ms", "hit", "ahead")


def joint_alarms(found: DataFrame, link: str, level: int, content: str) -> DataFrame:
    """(link, series, others, start_ms, end_ms, n, foreseen, level, content): one alarm for each combination that all conditions hold for at some time.

    It lasts from the first such time to the last; one that begins in the forecast is ``foreseen``.
    """
    hits = found.where("hit").groupBy(link, "series", "others").agg(
        F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count(F.lit(1)).alias("n"), F.min_by("ahead", "ts_ms").alias("foreseen")
    )
    return hits.withColumns({"level": F.lit(level), "content": F.lit(content)})
