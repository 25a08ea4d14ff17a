"""Correlation, line fits, significance, scaling and forecasts over series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import numerics
from tidewatch.operators import recurrence


def correlate_with(target: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, coefficient) of each other series with the target at shared times; constant series give 0."""
    t = target.select("ts_ms", F.col("value").alias("_target"))
    both = others.join(t, "ts_ms")
    return both.groupBy(*keys).agg(F.coalesce(F.corr("value", "_target"), F.lit(0.0)).alias("coefficient"))


def _positions(df: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("ts_ms") if keys else Window.orderBy("ts_ms")
    return df.withColumn("_i", F.row_number().over(w) - 1)


def shifted_correlation(target: DataFrame, others: DataFrame, keys: list[str], reach: int, kind: str = "pearson") -> DataFrame:
    """(keys, shift, coefficient): the best of all shifts in [-reach, reach] by absolute value, the first of equal ones.

    The other series is moved by whole positions, with zeros moved in. ``kind`` is pearson, or
    coflux: the normalised inner product without half of each end.
    """
    near = others.join(target.select("ts_ms", F.col("value").alias("_x")), "ts_ms")
    w = Window.partitionBy(*keys).orderBy("ts_ms")
    shifts = F.array(*(F.struct(F.lit(s).alias("shift"), (F.lag("value", s, 0.0) if s >= 0 else F.lead("value", -s, 0.0)).over(w).alias("y")) for s in range(-reach, reach + 1)))
    moved = near.withColumn("_s", shifts).select(*keys, "ts_ms", "_x", F.explode("_s").alias("_p")).select(*keys, "ts_ms", "_x", "_p.shift", F.col("_p.y").alias("_y"))
    if kind == "pearson":
        c = moved.groupBy(*keys, "shift").agg(F.coalesce(F.corr("_x", "_y"), F.lit(0.0)).alias("coefficient"))
    else:
        inner = lambda a, b: 2 * F.sum(F.col(a) * F.col(b)) - F.min_by(F.col(a) * F.col(b), "ts_ms") - F.max_by(F.col(a) * F.col(b), "ts_ms")
        c = moved.groupBy(*keys, "shift").agg(F.coalesce(inner("_x", "_y") / F.nullif(F.sqrt(F.greatest(inner("_x", "_x") * inner("_y", "_y"), F.lit(0.0))), F.lit(0.0)), F.lit(0.0)).alias("coefficient"))
    best = F.max_by(F.struct("shift", "coefficient"), F.struct(F.abs("coefficient"), -F.col("shift")))
    return c.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.shift", "_b.coefficient")


def _line(x: str) -> dict:
    """Aggregates of a line through (x, value)."""
    flat, xs = F.min("value") == F.max("value"), F.col(x).cast("double")
    return {
        "slope": F.when(flat, 0.0).otherwise(F.regr_slope("value", xs)),
        "intercept": F.when(flat, F.min("value")).otherwise(F.regr_intercept("value", xs)),
        "r2": F.when(flat, 1.0).otherwise(F.regr_r2("value", xs)),
    }


def line_fit(df: DataFrame, keys: list[str], x: str = "ts_ms") -> DataFrame:
    """(keys, slope, intercept, r2); a constant series is a flat line that explains everything."""
    return df.groupBy(*keys).agg(*(c.alias(n) for n, c in _line(x).items()))


def change_significance(df: DataFrame, keys: list[str], current: str, how: str = "mean", least: float = 0.5) -> DataFrame:
    """(keys, magnitude, significant): by how much the rows where ``current`` holds exceed the others in sum or mean.

    One-sided: a fall has magnitude 0. It is significant if the current figure, less its ``least``
    share, is still above the other; no rows count as zero.
    """
    fold = F.sum if how == "sum" else F.avg
    c = F.coalesce(fold(F.when(F.col(current), F.col("value"))), F.lit(0.0))
    h = F.coalesce(fold(F.when(~F.col(current), F.col("value"))), F.lit(0.0))
    sized = df.groupBy(*keys).agg(c.alias("_c"), h.alias("_h"))
    magnitude = F.when(F.col("_c") < F.col("_h"), 0.0).otherwise((F.col("_c") - F.col("_h")) / (F.col("_c") + 1e-10))
    return sized.select(*keys, magnitude.alias("magnitude"), (F.col("_c") * (1 - least) > F.col("_h")).alias("significant"))


def ks_test(df: DataFrame, keys: list[str], current: str, p_value: float = 0.05) -> DataFrame:
    """(keys, d, p, alike): the two-sample statistic, its asymptotic p-value, and whether that is ``p_value`` or more."""
    sizes = df.groupBy(*keys).agg(F.count_if(F.col(current)).alias("_n1"), F.count_if(~F.col(current)).alias("_n0"))
    both = ks_statistic(df, keys, current).join(sizes, keys)
    n = F.sqrt(F.col("_n1") * F.col("_n0") / (F.col("_n1") + F.col("_n0")))
    z = (n + 0.12 + 0.11 / n) * F.col("d")
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * z * z))
    p = F.when(z < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))))
    known = (F.col("_n1") > 0) & (F.col("_n0") > 0)
    return both.select(*keys, "d", F.when(known, p).alias("p"), (known & (p >= p_value)).alias("alike"))


def change_vote(df: DataFrame, keys: list[str], current: str, least: float = 0.01, p_value: float = 0.5) -> DataFrame:
    """(keys, votes, changed): the tests of sum, mean and distribution, and whether two of the three hold."""
    total = change_significance(df, keys, current, "sum", least).select(*keys, F.col("significant").cast("int").alias("_a"))
    mean = change_significance(df, keys, current, "mean", least).select(*keys, F.col("significant").cast("int").alias("_b"))
    alike = ks_test(df, keys, current, p_value).select(*keys, F.col("alike").cast("int").alias("_c"))
    votes = F.col("_a") + F.col("_b") + F.col("_c")
    return total.join(mean, keys).join(alike, keys).select(*keys, votes.alias("votes"), (votes >= 2).alias("changed"))


def ks_statistic(df: DataFrame, keys: list[str], current: str) -> DataFrame:
    """(keys, d): the largest distance between the two empirical distributions."""
    n1, n0 = F.count_if(F.col(current)), F.count_if(~F.col(current))
    by_value = df.groupBy(*keys, "value").agg(n1.alias("_a"), n0.alias("_b"))
    upto = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    gap = F.abs(F.sum("_a").over(upto) / F.nullif(F.sum("_a").over(whole), F.lit(0)) - F.sum("_b").over(upto) / F.nullif(F.sum("_b").over(whole), F.lit(0)))
    return by_value.select(*keys, gap.alias("_gap")).groupBy(*keys).agg(F.max("_gap").alias("d"))


def min_max(df: DataFrame, keys: list[str]) -> DataFrame:
    """Values scaled to [0, 1] in their series; a constant one gives zeros."""
    w = Window.partitionBy(*keys)
    span = F.max("value").over(w) - F.min("value").over(w)
    return df.withColumn("value", (F.col("value") - F.min("value").over(w)) / F.when(span == 0, 1.0).otherwise(span))


def amplify(df: DataFrame, keys: list[str]) -> DataFrame:
    """z-scores stretched: sign(z) (exp(min(abs z, 10) / 2) - 1)."""
    w = Window.partitionBy(*keys)
    z = (F.col("value") - F.avg("value").over(w)) / F.nullif(F.stddev_pop("value").over(w), F.lit(0.0))
    return df.withColumn("_z", F.coalesce(z, F.lit(0.0))).withColumn("value", F.signum("_z") * (F.exp(F.least(F.abs("_z"), F.lit(10.0)) / 2) - 1)).drop("_z")


def linear_forecast(df: DataFrame, keys: list[str], step: int, steps: int) -> DataFrame:
    """(keys, ts_ms, value): the series' line carried on from its last sample."""
    line = _line("ts_ms")
    fitted = df.groupBy(*keys).agg(F.max("ts_ms").alias("_last"), line["slope"].alias("_slope"), line["intercept"].alias("_base"))
    ahead = fitted.withColumn("ts_ms", F.explode(F.expr(f"sequence(_last + {step}, _last + {step * steps}, {step}L)")))
    return ahead.select(*keys, "ts_ms", (F.col("_base") + F.col("_slope") * F.col("ts_ms")).alias("value"))


def forecast(df: DataFrame, keys: list[str], step: int, steps: int, low: float = -math.inf, high: float = math.inf) -> DataFrame:
    """(keys, ts_ms, value) ahead, by season and a line or ARIMA; a series is one task's work."""
    schema = ", ".join(f"{c} {t}" for c, t in df.select(*keys).dtypes) + ", ts_ms long, value double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_ms")
        ahead = numerics.forecast(pdf["value"].to_numpy(dtype=float), steps, low, high)
        times = int(pdf["ts_ms"].iloc[-1]) + step * np.arange(1, steps + 1)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "ts_ms": times, "value": ahead})

    return df.select(*keys, "ts_ms", "value").groupBy(*keys).applyInPandas(run, schema)


def metric_forecast(df: DataFrame, keys: list[str], step: int, bounds: dict[str, tuple[float, float]], share: float = 0.33, method: str = "season", metric: str = "name") -> DataFrame:
    """(keys, ts_ms, value): each series carried on by ``share`` of its own range, within its metric's bounds (else from 0).

    ``method`` is season (forecast()) or line.
    """
    reach = df.groupBy(*keys).agg(F.min("ts_ms").alias("_first"), F.max("ts_ms").alias("_last"))
    reach = reach.select(*keys, "_last", F.expr(f"cast((_last - _first) * {share} as long) div {step}").alias("_steps"))
    longest = reach.agg(F.max("_steps")).first()[0] or 0
    if longest == 0:
        return df.select(*keys, "ts_ms", "value").limit(0)
    ahead = linear_forecast(df, keys, step, longest) if method == "line" else forecast(df, keys, step, longest)
    low, high = F.lit(0.0), F.lit(math.inf)
    for name, (a, b) in bounds.items():
        low, high = F.when(F.col(metric) == name, a).otherwise(low), F.when(F.col(metric) == name, b).otherwise(high)
    within = ahead.join(reach, keys).where(F.col("ts_ms") <= F.col("_last") + F.col("_steps") * step)
    return within.select(*keys, "ts_ms", F.least(F.greatest("value", low), high).alias("value"))


def early_warning(now: DataFrame, ahead: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """(keys, status, hours): upper or lower if a bound is passed now, future ones with the hours left, else normal."""
    last = now.groupBy(*keys).agg(F.max_by("value", "ts_ms").alias("_v"), F.max("ts_ms").alias("_t"))
    over = ahead.where((F.col("value") >= high) | (F.col("value") <= low)).groupBy(*keys).agg(F.min(F.struct("ts_ms", "value")).alias("_first"))
    both = last.join(over, keys, "left")
    status = (
        F.when(F.col("_v") >= high, "upper").when(F.col("_v") <= low, "lower")
        .when(F.col("_first").isNull(), "normal").when(F.col("_first.value") >= high, "future upper").otherwise("future lower")
    )
    hours = F.when(F.col("_v").between(low, high), (F.col("_first.ts_ms") - F.col("_t")) / 3_600_000)
    return both.select(*keys, status.alias("status"), hours.alias("hours"))


def residuals(df: DataFrame, keys: list[str], method: str, times: int = 1, window: int = 3, smoothing: tuple = (0.2, 0.2, 0.2, 7)) -> DataFrame:
    """(keys, ts_ms, value): what a prediction leaves of each series, for correlations.

    ``method`` is diff (``times`` times), historical_avg, historical_med, wavelet (the series' first
    ``window`` values as a filter), holt_winters (``smoothing``) or none. Shorter results start
    later or end earlier.
    """
    slim = df.select(*keys, "ts_ms", "value")
    in_time = Window.partitionBy(*keys).orderBy("ts_ms")
    whole = in_time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = F.col("value")
    if method == "none":
        return slim
    if method == "diff":
        for _ in range(times):
            slim = slim.withColumn("value", v - F.lag("value").over(in_time)).where("value is not null")
        return slim
    if method == "historical_avg":
        return slim.withColumn("value", v - F.avg("value").over(whole))
    if method == "historical_med":
        middle = slim.groupBy(*keys).agg(F.median("value").alias("_m"))
        return slim.join(middle, keys).withColumn("value", v - F.col("_m")).drop("_m")
    if method == "wavelet":
        before = (window - 1) // 2
        terms = [F.lead("value", window - 1 - before - k).over(in_time) * F.nth_value("value", k + 1).over(whole) for k in range(window)]
        return slim.withColumn("value", v - sum(terms[1:], terms[0])).where("value is not null")
    if method != "holt_winters":
        raise ValueError(f"no method {method}")
    return recurrence.holt_winters(slim, keys, *smoothing)
