"""Anomaly detectors: each adds ``is_anomaly`` to (keys..., ts_ms, value).

A missing value is never an anomaly. Bounds are worked out for each series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import numerics
from tidewatch.operators import transforms

SIDES = ("positive", "negative", "both", "neither")


def _side(diff: Column, side: str) -> Column:
    return {"positive": diff > 0, "negative": diff < 0, "both": diff.isNotNull(), "neither": F.lit(False)}[side]


def _flag(df: DataFrame, condition: Column) -> DataFrame:
    return df.withColumn("is_anomaly", F.coalesce(condition, F.lit(False)))


def threshold(df: DataFrame, keys: list[str], high: float = math.inf, low: float = -math.inf, share: float | None = None) -> DataFrame:
    """Outside [low, high]; with ``share`` the whole series, if that share of it is."""
    out = (F.col("value") > high) | (F.col("value") < low)
    if share is None:
        return _flag(df, out)
    whole = Window.partitionBy(*keys)
    return _flag(df, F.count_if(out).over(whole) >= share * F.count(F.lit(1)).over(whole))


def _quartiles(df: DataFrame, keys: list[str], column: str, low: float, high: float) -> DataFrame:
    whole = Window.partitionBy(*keys)
    return df.withColumn("_q1", F.percentile(column, F.lit(low)).over(whole)).withColumn("_q3", F.percentile(column, F.lit(high)).over(whole))


def _beyond(column: str, outliers: tuple[float | None, float | None]) -> Column:
    below, above = outliers
    spread = F.col("_q3") - F.col("_q1")
    parts = []
    if above is not None:
        parts.append(F.col(column) > F.col("_q3") + above * spread)
    if below is not None:
        parts.append(F.col(column) < F.col("_q1") - below * spread)
    return parts[0] if len(parts) == 1 else parts[0] | parts[1]


def iqr(df: DataFrame, keys: list[str], outliers: tuple[float | None, float | None] = (3, 3)) -> DataFrame:
    return _flag(_quartiles(df, keys, "value", 0.25, 0.75), _beyond("value", outliers)).drop("_q1", "_q3")


def quantile(df: DataFrame, keys: list[str], high: float = 1.0, low: float = 0.0) -> DataFrame:
    q = _quartiles(df, keys, "value", low, high)
    return _flag(q, (F.col("value") > F.col("_q3")) | (F.col("value") < F.col("_q1"))).drop("_q1", "_q3")


def mad(df: DataFrame, keys: list[str], limit: float = 3.0, scale: float = 1.4826) -> DataFrame:
    """Distance from the median in scaled median deviations; without any deviation all other values are anomalies."""
    whole = Window.partitionBy(*keys)
    off = df.withColumn("_off", F.abs(F.col("value") - F.percentile("value", F.lit(0.5)).over(whole)))
    typical = off.withColumn("_mad", F.percentile("_off", F.lit(0.5)).over(whole) * scale)
    return _flag(typical, F.when(F.col("_mad") == 0, F.col("_off") > 0).otherwise(F.col("_off") / F.nullif(F.col("_mad"), F.lit(0.0)) > limit)).drop("_off", "_mad")


def _shift_detector(df, keys, widths, how, modifier, outliers, side) -> DataFrame:
    changed = _quartiles(transforms.double_rolling(df, keys, widths, how, modifier), keys, "change", 0.25, 0.75)
    both = F.coalesce(_beyond("change", outliers), F.lit(False)) & F.coalesce(_side(F.col("diff"), side), F.lit(False))
    return _flag(changed, both).drop("_q1", "_q3", "diff", "change")


def spike(df: DataFrame, keys: list[str], outliers=(None, 3), side: str = "both", window: int = 1, how: str = "median") -> DataFrame:
    return _shift_detector(df, keys, (window, 1), how, "abs_diff", outliers, side)


def level_shift(df: DataFrame, keys: list[str], outliers=(None, 6), side: str = "both", window: int = 5, how: str = "median") -> DataFrame:
    return _shift_detector(df, keys, (window, window), how, "abs_diff", outliers, side)


def volatility_shift(df: DataFrame, keys: list[str], outliers=(None, 6), side: str = "both", window: int = 10, how: str = "std") -> DataFrame:
    return _shift_detector(df, keys, (window, window), how, "abs_rel_diff", outliers, side)


def remove_spikes(df: DataFrame, keys: list[str], side: str = "positive") -> DataFrame:
    """Flagged values become the original value before them; a flagged first one the first unflagged."""
    w = Window.partitionBy(*keys).orderBy("ts_ms")
    flagged = spike(df, keys, side=side)
    calm = F.first(F.when(~F.col("is_anomaly"), F.col("value")), True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return flagged.withColumn("value", F.when(F.col("is_anomaly"), F.coalesce(F.lag("value").over(w), calm)).otherwise(F.col("value"))).drop("is_anomaly")


def gradient(df: DataFrame, keys: list[str], side: str = "positive", max_coef: float = 1.0) -> DataFrame:
    """The whole series, if the slope of its line over milliseconds is beyond ``max_coef``."""
    calm = remove_spikes(df, keys)
    slopes = calm.groupBy(*keys).agg(F.regr_slope("value", F.col("ts_ms").cast("double")).alias("_slope"))
    over = {"positive": F.col("_slope") > abs(max_coef), "negative": F.col("_slope") < -abs(max_coef), "both": F.abs("_slope") > abs(max_coef), "neither": F.lit(False)}[side]
    return _flag(df.join(slopes, keys), over).drop("_slope")


def _kernel(df: DataFrame, keys: list[str], rule) -> DataFrame:
    """Run a numpy rule (values -> flags) on each series whole; a series is one task's work.

    A series that the rule fails on has NULL flags, and the others theirs; see failed().
    """
    columns = [*keys, "ts_ms", "value"]
    schema = ", ".join(f"{c} {t}" for c, t in df.select(*columns).dtypes) + ", is_anomaly boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_ms")
        try:
            flags = pd.array(rule(pdf["value"].to_numpy(dtype=float)), dtype="boolean")
        except (ValueError, ArithmeticError, IndexError, np.linalg.LinAlgError):
            flags = pd.array([None] * len(pdf), dtype="boolean")
        return pdf.assign(is_anomaly=flags)

    return df.select(*columns).groupBy(*keys).applyInPandas(run, schema)


def failed(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """The series that a detector could not judge."""
    return flagged.groupBy(*keys).agg(F.count("is_anomaly").alias("_n")).where("_n = 0").select(*keys)


def increase(df: DataFrame, keys: list[str], side: str = "positive", alpha: float | None = None) -> DataFrame:
    """Cox-Stuart: the whole series, if its second half lies above (below) its first by a sign test and by slope."""

    def rule(values: np.ndarray) -> np.ndarray:
        return np.full(len(values), numerics.cox_stuart(values, side, alpha))

    return _kernel(df, keys, rule)


def esd(df: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Generalised extreme studentised deviates."""
    return _kernel(df, keys, lambda values: numerics.esd(values, alpha))


def seasonal(df: DataFrame, keys: list[str], outliers=(None, 3), side: str = "positive", window: int = 10, period: int | None = None) -> DataFrame:
    """Outliers of what a period and a trend do not explain."""
    return _kernel(df, keys, lambda values: numerics.seasonal_outliers(values, outliers, side, window, period))


REGISTRY = {
    "threshold": threshold, "iqr": iqr, "quantile": quantile, "mad": mad, "spike": spike, "level_shift": level_shift,
    "volatility_shift": volatility_shift, "gradient": gradient, "increase": increase, "esd": esd, "seasonal": seasonal,
}


def combine(parts: list[DataFrame], keys: list[str], how: str = "and") -> DataFrame:
    """Flags of several detectors over the same samples, all or any of which must hold."""
    union = parts[0].select(*keys, "ts_ms", "is_anomaly")
    for p in parts[1:]:
        union = union.unionByName(p.select(*keys, "ts_ms", "is_anomaly"))
    hits = union.groupBy(*keys, "ts_ms").agg(F.count_if("is_anomaly").alias("_hits"), F.count(F.lit(1)).alias("_n"))
    needed = F.lit(len(parts)) if how == "and" else F.lit(1)
    return hits.select(*keys, "ts_ms", (F.col("_hits") >= needed).alias("is_anomaly"))


def overview(found: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(keys, detector, anomalies)."""
    parts = [d.groupBy(*keys).agg(F.count_if("is_anomaly").alias("anomalies")).withColumn("detector", F.lit(name)) for name, d in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def alarms(df: DataFrame, keys: list[str], level: int, content: str) -> DataFrame:
    """One alarm a series with anomalies, from its first to its last."""
    hits = df.where("is_anomaly").groupBy(*keys).agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count(F.lit(1)).alias("n"))
    return hits.withColumn("level", F.lit(level)).withColumn("content", F.lit(content))


#: Detections that run without configuration: (metric, detector, arguments).
PREDEFINED = {
    "high_disk_usage": (("os_disk_usage", "threshold", {"high": 0.8, "share": 0.8}),),
    "high_memory_usage": (("os_mem_usage", "threshold", {"high": 0.8, "share": 0.8}),),
    "high_cpu_usage": (("os_cpu_user_usage", "threshold", {"high": 0.8, "share": 0.8}),),
    "memory_leak": (("os_mem_usage", "spike", {"side": "positive"}), ("os_mem_usage", "threshold", {"high": 0.8})),
    "qps_spike": (("qps", "spike", {"side": "both"}),),
}


def run_predefined(name: str, samples: DataFrame, keys: list[str], metric: str = "name", rename: dict[str, str] | None = None) -> DataFrame:
    """A predefined detection over samples of all metrics; ``rename`` maps its metrics to those at hand."""
    parts = []
    for needed, kind, arguments in PREDEFINED[name]:
        chosen = samples.where(F.col(metric) == (rename or {}).get(needed, needed))
        parts.append(REGISTRY[kind](chosen, keys, **arguments))
    return combine(parts, keys)


def run_pool(pool: dict[str, tuple], samples: DataFrame, keys: list[str], metric: str = "name") -> DataFrame:
    """(detector, keys, start_ms, end_ms, n, level, content): the alarms of all detectors of a pool.

    ``pool`` names detectors: (metric, kind, arguments, level, content), as kept in a table of
    detector definitions; a paused one has level 0 and is not run.
    """
    out = None
    for name, (needed, kind, arguments, level, content) in sorted(pool.items()):
        if not level:
            continue
        found = alarms(REGISTRY[kind](samples.where(F.col(metric) == needed), keys, **arguments), keys, level, content).withColumn("detector", F.lit(name))
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("every detector of the pool is paused")
    return out
