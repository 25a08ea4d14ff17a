import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import numerics as M
from tidewatch.operators import detectors as D
from tidewatch.operators import transforms as T
from tidewatch.sources.series import Selector, instant, on_grid

KEY = ["name"]


@pytest.fixture
def make(spark):
    def series(values, ts=None, name="a"):
        ts = ts or list(range(len(values)))
        return spark.createDataFrame([(name, int(t), None if v is None else float(v)) for t, v in zip(ts, values)], "name string, ts_ms long, value double")

    return series


def values(df, column="value"):
    return [r[column] for r in df.orderBy("name", "ts_ms").collect()]


def hits(df):
    return {i for i, r in enumerate(df.orderBy("ts_ms").collect()) if r["is_anomaly"]}


def test_rolling(make):
    assert values(T.rolling(make([0, 2, 4, 6, 8]), KEY, 3, "median")) == [1, 2, 4, 6, 7]
    assert values(T.rolling(make([1, 2, 3]), KEY, 2)) == [1.0, 1.5, 2.5]
    assert values(T.rolling(make([1, 2, 3, 4, 5, 6]), KEY, 1, "std")) == [0.0] * 6


def test_threshold(make):
    s = make([1, 1, 12, 2, 2, 2])
    assert hits(D.threshold(s, KEY, high=10)) == {2}
    assert hits(D.threshold(s, KEY, low=3)) == {0, 1, 3, 4, 5}
    assert hits(D.threshold(make([11, 11, 12, 12, 2, 2]), KEY, high=10, share=0.6)) == set(range(6))


def test_outliers(make):
    s = make([1, 1, 12, 2, 2, 2])
    assert hits(D.iqr(s, KEY)) == {2}
    assert hits(D.quantile(s, KEY, 0.9)) == {2}
    assert hits(D.esd(s, KEY)) == {2}
    assert hits(D.mad(s, KEY)) == {2}


def test_missing_values_are_no_anomalies(make):
    s = make([1, None, 50, 1, None, 1, 1, 1])
    for detect in (D.threshold, D.iqr, D.mad, D.spike):
        assert {1, 4}.isdisjoint(hits(detect(s, KEY)))


def test_shift_detectors(make):
    assert hits(D.level_shift(make([*range(10)] * 5 + [100] * 10), KEY, side="positive")) == {50}
    dip = [0, 1, 0, 1, 0, 0, 1, -15, -1, -2, 1, 1, 1, 0] + [1, 0] * 8
    assert hits(D.spike(make(dip), KEY, side="negative")) == {7}
    rng = random.Random(0)
    calm = [rng.uniform(-1, 1) for _ in range(20)]
    wild = [rng.uniform(-10, 10) + 1000 * (-1) ** i for i in range(20)]
    assert hits(D.volatility_shift(make(calm + wild), KEY, window=5)) == {18}


def test_trend_tests(make):
    rng = random.Random(1)
    rising = [0.05 * i + 0.7 * rng.randint(1, 5) for i in range(50)]
    assert len(hits(D.increase(make(rising), KEY))) == 50
    assert len(hits(D.increase(make(rising[::-1]), KEY, "negative", 0.05))) == 50
    assert not hits(D.increase(make([1.0] * 20), KEY))


def test_seasonal_outlier():
    x = np.array([10, 20, 30, 40] * 40, dtype=float)
    x[82] = 200.0
    out = M.seasonal_outliers(x, window=2, period=4)
    assert 82 in np.flatnonzero(out) and set(np.flatnonzero(out)) <= set(range(80, 85))
    assert M.season(np.sin(np.arange(240) * 2 * np.pi / 24)) == 24


def test_islands(make):
    s = make([1, 0, 1, 1], ts=[0, 1, 2, 5]).withColumn("is_anomaly", F.col("value") > 0)
    assert [(r["start_ms"], r["end_ms"]) for r in T.islands(s, KEY).orderBy("start_ms").collect()] == [(0, 0), (2, 5)]
    assert T.islands(s, KEY, drop_ends=True).count() == 0


def test_fill_and_interpolate(make):
    s = T.interpolate(T.fill_grid(make([1, 2, 4, 5, 7, 8, 12], ts=[1, 2, 4, 5, 7, 8, 12]), KEY, 1), KEY)
    assert values(s) == [float(x) for x in range(1, 13)]
    assert values(T.trim_ends(make([None, 1, None, 2, None]), KEY)) == [1, 1, None, 2, 2]
    assert values(T.trim_ends(make([None, None]), KEY)) == [0, 0]


def test_tidy_up():
    t = np.array([1, 2, 4, 5, 7, 8, 12])
    ts, v = M.tidy_up(t, t.astype(float), 1)
    assert ts == list(range(1, 13)) and [i + 1 for i, x in enumerate(v) if x != x] == [3, 6, 9, 10, 11]


def test_step_prefers_the_first_of_equal_gaps(make):
    assert T.step_of(make([0] * 5, ts=[0, 10, 20, 50, 80]), KEY).first()["step"] == 10


def test_gaps(spark):
    iv = spark.createDataFrame([("a", 10, 20), ("a", 15, 30), ("a", 60, 70)], "name string, start_ms long, end_ms long")
    got = sorted((r["start_ms"], r["end_ms"]) for r in T.find_gaps(iv, KEY, 0, 100, 10).collect())
    assert got == [(0, 0), (40, 50), (80, 100)]


def test_selectors(spark):
    s = spark.createDataFrame(
        [("m", {"from_instance": "h:5432"}, t, float(v)) for t, v in ((1, 0), (2, 5), (3, 9))] + [("m", {"from_instance": "g"}, 2, 7.0)],
        "name string, labels map<string,string>, ts_ms long, value double",
    )
    assert {(r["labels"]["from_instance"], r["value"]) for r in instant(s).collect()} == {("h:5432", 9.0), ("g", 7.0)}
    sel = Selector(s).metric("m")
    assert sel.from_server("h:5432").between(2, 3).fetchall().count() == 2
    assert sel.from_server_like("h").fetchall().count() == 3
    assert sel.values(5, 9).fetchall().count() == 2 and sel.values(5, 9).latest().count() == 1
    with pytest.raises(ValueError):
        sel.filter(a="x").filter_like(a="y")
    flat = s.withColumn("instance", F.col("labels")["from_instance"]).drop("labels")
    grid = on_grid(flat, ["name", "instance"], 0, 6, 2, lookback=3)
    assert {(r["instance"], r["ts_ms"], r["value"]) for r in grid.collect()} == {("h:5432", 2, 5.0), ("h:5432", 4, 9.0), ("h:5432", 6, 9.0), ("g", 2, 7.0), ("g", 4, 7.0)}


def test_forecasts():
    line = np.arange(1.0, 10)
    assert np.abs(M.forecast(line, 10) - np.arange(10, 20)).max() < 1
    wave = 10 + 3 * np.sin(np.arange(240) * 2 * np.pi / 24)
    ahead = M.forecast(wave, 24)
    assert np.abs(ahead - (10 + 3 * np.sin(np.arange(240, 264) * 2 * np.pi / 24))).max() < 1.5
    assert M.forecast(np.array([np.nan, 4.0, np.nan]), 2).tolist() == [4.0, 4.0]
    walk = np.cumsum(np.random.default_rng(0).standard_normal(200))
    assert np.isfinite(M.arima_forecast(walk, 12)).all()


def test_distributions():
    assert abs(M.t_ppf(0.975, 10) - 2.228139) < 1e-5
    assert abs(M.binom_cdf(3, 10) - 0.171875) < 1e-12
    d, p = M.ks_2samp(np.arange(50.0), np.arange(50.0) + 25)
    assert d == 0.5 and p < 1e-4
