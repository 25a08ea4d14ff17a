"""ARIMA models of many series: all candidates are rows, fitted side by side."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import numerics as N
from tidewatch.sources.store import cut

MODEL = "p int, q int, bic double, ar array<double>, ma array<double>, constant double, errors array<double>"


def stationary(df: DataFrame, keys: list[str], most: int = 2) -> DataFrame:
    """(keys, d, heads, series): each series differenced until the Dickey-Fuller test calls it stationary, ``most`` times at most.

    ``heads`` are the last values before each difference, which forecasts are summed up from again. A series is a row.
    """
    schema = ", ".join(f"{c} {t}" for c, t in df.select(*keys).dtypes) + ", d int, heads array<double>, series array<double>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        series, heads = pdf.sort_values("ts_ms")["value"].to_numpy(dtype=float), []
        while len(heads) < most and len(series) > 12 and np.ptp(series) > 0 and N.adf(series)[0] > N.adf_critical(len(series)):
            heads.append(float(series[-1]))
            series = np.diff(series)
        return pd.DataFrame({**{k: pdf[k].iloc[:1] for k in keys}, "d": [len(heads)], "heads": [heads], "series": [series.tolist()]})

    return df.select(*keys, "ts_ms", "value").groupBy(*keys).applyInPandas(run, schema)


def fitted(candidates: DataFrame) -> DataFrame:
    """``candidates`` (..., series, p, q) with the fit of each: bic, ar, ma, constant, errors; bic is NULL where the series is too short for the orders."""
    others = [c for c in candidates.columns if c not in ("p", "q")]
    schema = ", ".join(f"{c} {t}" for c, t in candidates.select(*others).dtypes) + ", " + MODEL

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for series, p, q in zip(pdf["series"], pdf["p"], pdf["q"], strict=True):
                values, p, q = np.asarray(series, float), int(p), int(q)
                if len(values) < 2 * (p + q + 2) + max(p, q) or np.ptp(values) == 0:
                    rows.append((p, q, None, [], [], float(values.mean()) if len(values) else 0.0, []))
                    continue
                ar, ma, constant, errors = N.free_fit(values, p, q)
                used = errors[p:]
                bic = len(used) * math.log(max(float(used @ used) / len(used), 1e-300)) + (p + q + 1) * math.log(len(used))
                rows.append((p, q, bic, ar.tolist(), ma.tolist(), constant, errors.tolist()))
            found = pd.DataFrame(rows, columns=["p", "q", "bic", "ar", "ma", "constant", "errors"])
            yield pd.concat([pdf[others].reset_index(drop=True), found], axis=1)

    return candidates.mapInPandas(run, schema)


def best_orders(df: DataFrame, keys: list[str], most: int = 4, step: int = 2, rounds: int = 8) -> DataFrame:
    """(keys, d, heads, series, p, q, bic, ar, ma, constant, errors): the model of each series of least BIC.

    Orders from 0 to ``most`` by ``step`` are a row each, dealt by series and orders, so that the candidates of
    one series are fitted in parallel; then the winners' neighbours (one order up or down) are, until none is
    better. Of equal ones the smaller orders win. A series too short or constant keeps its mean.
    """
    base = cut(stationary(df, keys))
    by = Window.partitionBy(*keys).orderBy(F.col("bic").asc_nulls_last(), F.col("p") + F.col("q"), "p")
    least = lambda rows: rows.withColumn("_place", F.row_number().over(by)).where("_place = 1").drop("_place")
    orders = F.sequence(F.lit(0), F.lit(most), F.lit(step))
    dealt = base.withColumn("p", F.explode(orders)).withColumn("q", F.explode(orders)).repartition(*keys, "p", "q")
    best = cut(least(fitted(dealt)))
    for _ in range(rounds):
        around = F.array(*(F.struct((F.col("p") + a).alias("p"), (F.col("q") + b).alias("q")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))))
        near = best.where("bic is not null").select(*keys, F.explode(around).alias("o")).where("o.p >= 0 and o.q >= 0").select(*keys, "o.p", "o.q")
        tried = fitted(base.join(near, keys).repartition(*keys, "p", "q"))
        now = cut(least(best.unionByName(tried)))
        moved = now.select(*keys, "p", "q").exceptAll(best.select(*keys, "p", "q"))
        best = now
        if moved.isEmpty():
            break
    return best


def forecast(models: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """(keys, step, value): each model carried on from the end of its series, its differences summed up again."""
    schema = ", ".join(f"{c} {t}" for c, t in models.select(*keys).dtypes) + ", step long, value double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                past, noise = list(r["series"]), list(r["errors"]) or [0.0]
                begin = len(past)
                for _ in range(steps):
                    past.append(r["constant"] + sum(a * past[-k - 1] for k, a in enumerate(r["ar"])) + sum(m * noise[-k - 1] for k, m in enumerate(r["ma"])))
                    noise.append(0.0)
                out = np.array(past[begin:])
                for head in reversed(list(r["heads"])):
                    out = head + np.cumsum(out)
                yield pd.DataFrame({**{k: [r[k]] * steps for k in keys}, "step": np.arange(1, steps + 1), "value": out})

    return models.select(*keys, "heads", "series", "errors", "ar", "ma", "constant").mapInPandas(run, schema)
