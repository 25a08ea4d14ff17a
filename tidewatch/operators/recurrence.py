"""Recurrences over series of any length: ranges are run apart from a zero state and put together as affine maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.store import cut


def _run(values: np.ndarray, start: int, state: np.ndarray, alpha: float, beta: float, gamma: float) -> np.ndarray:
    """Additive triple smoothing from place ``start`` on; changes ``state`` (level, slope, a season for each phase), returns what is left of each value."""
    period, out = len(state) - 2, np.zeros(len(values))
    level, slope, seasons = float(state[0]), float(state[1]), state[2:].tolist()
    for i, v in enumerate(values.tolist()):
        k, before = (start + i) % period, level
        level = alpha * (v - seasons[k]) + (1 - alpha) * (level + slope)
        slope = beta * (level - before) + (1 - beta) * slope
        seasons[k] = gamma * (v - level) + (1 - gamma) * seasons[k]
        out[i] = v - level - seasons[k]
    state[:] = [level, slope, *seasons]
    return out


def _carried(start: int, length: int, period: int, alpha: float, beta: float, gamma: float) -> np.ndarray:
    """The matrix that takes a state over ``length`` places from ``start``, as far as it does not depend on the values."""

    def step(k: int) -> np.ndarray:
        m = np.eye(period + 2)
        m[0, :2], m[0, 2 + k] = 1 - alpha, -alpha
        m[1] = beta * (m[0] - np.eye(period + 2)[0])
        m[1, 1] += 1 - beta
        m[2 + k] = -gamma * m[0]
        m[2 + k, 2 + k] += 1 - gamma
        return m

    def over(first: int, count: int) -> np.ndarray:
        out = np.eye(period + 2)
        for k in range(first, first + count):
            out = step(k % period) @ out
        return out

    rounds, rest = divmod(length, period)
    return over(start, rest) @ np.linalg.matrix_power(over(start, period), rounds)


def holt_winters(df: DataFrame, keys: list[str], alpha: float = 0.2, beta: float = 0.2, gamma: float = 0.2, period: int = 7, parts: int | None = None) -> DataFrame:
    """(keys, ts_ms, value): what additive triple smoothing leaves of each value of a series, however long it is.

    A step is a linear map of level, slope and seasons, plus a share of the value. So rows are dealt
    into ranges of (keys, time); each range is run from a zero state, which gives what its values
    add; a series' ranges, a few numbers each, are then put together in order, a range's matrix being a power of a
    period's; and each range is run again from the state it really begins with. No task holds
    more than a range. Level and slope begin at the first value, seasons at zero. Times are distinct within a series.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    smoothing = (alpha, beta, gamma)
    slim = df.select(*keys, "ts_ms", F.col("value").cast("double").alias("value"))
    ranged = cut(slim.repartitionByRange(parts, *keys, "ts_ms").withColumn("_range", F.spark_partition_id()))
    named = ", ".join(f"{c} {t}" for c, t in df.select(*keys).dtypes)
    head = lambda pdf: {k: pdf[k].iloc[:1] for k in keys}
    phases = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min_by("value", "ts_ms").alias("_first"))

    def places(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_range")
        return pdf.assign(_start=pdf["_n"].cumsum() - pdf["_n"])

    placed = cut(phases.groupBy(*keys).applyInPandas(places, f"{named}, _range int, _n long, _first double, _start long"))

    def added(rows: pd.DataFrame, place: pd.DataFrame) -> pd.DataFrame:
        state = np.zeros(period + 2)
        _run(rows.sort_values("ts_ms")["value"].to_numpy(), int(place["_start"].iloc[0]), state, *smoothing)
        return pd.DataFrame({**head(place), "_range": place["_range"].iloc[:1], "_added": [state.tolist()]})

    by = [*keys, "_range"]
    sums = ranged.groupBy(*by).cogroup(placed.groupBy(*by)).applyInPandas(added, f"{named}, _range int, _added array<double>")

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, found = pdf.sort_values("_range"), []
        state = np.zeros(period + 2)
        state[:2] = pdf["_first"].iloc[0]
        for start, n, more in zip(pdf["_start"], pdf["_n"], pdf["_added"], strict=True):
            found.append(state.tolist())
            state = _carried(int(start), int(n), period, *smoothing) @ state + np.asarray(more)
        return pdf.assign(_state=found)[[*keys, "_range", "_start", "_state"]]

    # A row for each range of a series.
    begun = placed.join(sums, by).groupBy(*keys).applyInPandas(states, f"{named}, _range int, _start long, _state array<double>")

    def left(rows: pd.DataFrame, place: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts_ms")
        state = np.array(place["_state"].iloc[0], dtype=float)
        return rows.assign(value=_run(rows["value"].to_numpy(), int(place["_start"].iloc[0]), state, *smoothing))[[*keys, "ts_ms", "value"]]

    return ranged.groupBy(*by).cogroup(begun.groupBy(*by)).applyInPandas(left, f"{named}, ts_ms long, value double")
