"""Queries of detections over several metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import conditions as C
from tidewatch.plans.metrics import DAY, START
from tidewatch.plans.registry import query
from tidewatch.sources.series import epoch_ms, table

HOUR = 3_600_000
#: Two metrics of each instance that grow by about one a day, every hour and every three hours; the second has a series for each of two devices.
_LOAD = f"SELECT 'load' AS metric, user_id % 10 AS instance, 'load' AS series, epoch_us(ts) // 1000 AS ts_ms, event_id, value / 40 + (epoch_us(ts) // 1000 - {START}) / {DAY} AS value FROM events WHERE event_type IN ('click', 'view')"
_DISK = f"SELECT 'disk' AS metric, user_id % 10 AS instance, 'sd' || event_id % 2 AS series, epoch_us(ts) // 1000 AS ts_ms, event_id, value / 20 + (epoch_us(ts) // 1000 - {START}) / {DAY} AS value FROM events WHERE event_type IN ('purchase', 'error')"
_AHEAD, _TOLERANCE = 3 * DAY, 6 * HOUR


def _judged(name: str, raw: str, step: int, high: float) -> str:
    return f"""{name}_raw AS ({raw}), {name}_own AS (SELECT instance, series, ts_ms - ts_ms % {step} AS spot, arg_max(value, ts_ms * 1000000 + event_id) AS value FROM {name}_raw GROUP BY 1, 2, 3),
 {name}_line AS (SELECT instance, series, regr_slope(value, CAST(spot AS DOUBLE)) AS a, regr_intercept(value, CAST(spot AS DOUBLE)) AS b, max(spot) AS l FROM {name}_own GROUP BY 1, 2),
 {name} AS (SELECT instance, series, spot, value > {high} AS hit, false AS ahead FROM {name}_own UNION ALL SELECT instance, series, l + k * {step}, b + a * (l + k * {step}) > {high}, true FROM {name}_line, range(1, {_AHEAD // step + 1}) t(k) WHERE a IS NOT NULL)"""


@query("d14_joint_forecast", f"""WITH {_judged('x', _LOAD, HOUR, 31.5)}, {_judged('y', _DISK, 3 * HOUR, 32.0)},
 c AS (SELECT DISTINCT x.instance, x.series, y.series AS other FROM x JOIN y ON x.instance = y.instance),
 m AS (SELECT x.instance, x.series, c.other, x.spot, any_value(x.ahead) AS ahead, any_value(x.hit) AS hit, arg_max(y.hit, y.spot) AS told FROM x JOIN c ON c.instance = x.instance AND c.series = x.series
  JOIN y ON y.instance = x.instance AND y.series = c.other AND y.spot BETWEEN x.spot - {_TOLERANCE} AND x.spot GROUP BY 1, 2, 3, 4)
 SELECT instance, series, other AS others, min(spot) AS start_ms, max(spot) AS end_ms, count(*) AS n, arg_min(ahead, spot) AS foreseen, 30 AS level, 'load and disk' AS content FROM m WHERE hit AND told GROUP BY instance, series, other""")
def d14_joint(spark, d):
    """Load and disk above their bounds at the same time, on grids of one and three hours, three days of forecast appended."""
    e = table(spark, d, "events").select("event_type", "event_id", F.col("user_id"), epoch_ms("ts").alias("at"), "value")
    grown = lambda share: F.col("value") / share + (F.col("at") - START) / DAY
    # Of samples at the same time the one with the larger number is the last.
    last = lambda df: df.groupBy("metric", "instance", "series", "ts_ms").agg(F.max_by("value", "event_id").alias("value"))
    load = e.where(F.col("event_type").isin("click", "view")).select(F.lit("load").alias("metric"), (F.col("user_id") % 10).alias("instance"), F.lit("load").alias("series"), F.col("at").alias("ts_ms"), "event_id", grown(40).alias("value"))
    disk = e.where(F.col("event_type").isin("purchase", "error")).select(F.lit("disk").alias("metric"), (F.col("user_id") % 10).alias("instance"), F.concat(F.lit("sd"), (F.col("event_id") % 2).cast("string")).alias("series"), F.col("at").alias("ts_ms"), "event_id", grown(20).alias("value"))
    conditions = [C.Condition("load", "threshold", HOUR, {"high": 31.5}), C.Condition("disk", "threshold", 3 * HOUR, {"high": 32.0})]
    found = C.together(last(load.unionByName(disk)), conditions, "instance", _TOLERANCE, _AHEAD)
    return C.joint_alarms(found, "instance", 30, "load and disk").withColumn("others", F.array_join("others", ","))
