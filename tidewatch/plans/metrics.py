"""Queries over metric series: selectors, the metric query language, transforms, detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import detectors as D
from tidewatch.operators import promql as P
from tidewatch.operators import transforms as T
from tidewatch.plans.registry import query
from tidewatch.sources import series as S

EV = "ev AS (SELECT event_type AS name, CAST(user_id % 10 AS VARCHAR) AS instance, epoch_us(ts) // 1000 AS ts_ms, value, event_id FROM events)"
SAMP = f"{EV}, samp AS (SELECT name, instance, ts_ms, arg_max(value, event_id) AS value FROM ev GROUP BY ALL)"
HR = f"{EV}, hr AS (SELECT name, ts_ms - ts_ms % 3600000 AS ts_ms, round(avg(value), 6) AS value, count(*) AS n FROM ev GROUP BY 1, 2)"
CNT = f"""{EV}, e1 AS (SELECT instance, ts_ms, event_id, sum(CASE WHEN event_id % 997 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY instance ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM ev),
e2 AS (SELECT *, CAST(row_number() OVER (PARTITION BY instance, epoch ORDER BY ts_ms, event_id) AS DOUBLE) AS value FROM e1),
cnt AS (SELECT instance, ts_ms, arg_max(value, event_id) AS value FROM e2 GROUP BY ALL)"""
DAY = 86_400_000
START = 1_704_067_200_000  # 2024-01-01
KEY = ["name"]


def _flat(df):
    return df.withColumn("instance", F.col("labels")["from_instance"]).drop("labels")


def _r(df, *columns, digits=6):
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


# --- selectors ---------------------------------------------------------------------------------


@query("s01_instant", f"WITH {SAMP} SELECT name, instance, max(ts_ms) AS ts_ms, arg_max(value, ts_ms) AS value FROM samp GROUP BY ALL")
def s01(spark, d):
    return _flat(S.instant(S.event_samples(spark, d)))


@query("s02_range_raw", f"WITH {SAMP} SELECT name, instance, ts_ms, value FROM samp WHERE name = 'click' AND ts_ms BETWEEN {START + 3 * DAY} AND {START + 5 * DAY}")
def s02(spark, d):
    return _flat(S.Selector(S.event_samples(spark, d)).metric("click").between(START + 3 * DAY, START + 5 * DAY).fetchall())


@query("s02_range_stepped", f"""WITH {SAMP}, g AS (SELECT unnest(range({START + 3 * DAY}, {START + 4 * DAY} + 1, 60000)) AS ts_ms),
 k AS (SELECT DISTINCT name, instance FROM samp), q AS (SELECT name, instance, ts_ms FROM k, g)
 SELECT q.name, q.instance, q.ts_ms, s.value FROM q ASOF JOIN samp s ON q.name = s.name AND q.instance = s.instance AND q.ts_ms >= s.ts_ms WHERE q.ts_ms - s.ts_ms <= 300000""")
def s02_stepped(spark, d):
    return S.on_grid(_flat(S.event_samples(spark, d)), ["name", "instance"], START + 3 * DAY, START + 4 * DAY, 60_000)


@query("s03_value_bounds", f"WITH {SAMP} SELECT name, instance, ts_ms, value FROM samp WHERE value >= 10 AND value < 50 AND name = 'purchase'")
def s03(spark, d):
    return _flat(S.Selector(S.event_samples(spark, d)).metric("purchase").values(10, 50).fetchall())


@query("s03_value_bounds_instant", f"WITH {SAMP}, s AS (SELECT * FROM samp WHERE value > 10 AND value < 50) SELECT name, instance, max(ts_ms) AS ts_ms, arg_max(value, ts_ms) AS value FROM s GROUP BY ALL")
def s03_instant(spark, d):
    return _flat(S.Selector(S.event_samples(spark, d)).values(10, 50).latest())


@query("s04_matchers", f"WITH {SAMP} SELECT name, instance, count(*) AS n FROM samp WHERE regexp_full_match(instance, '[1-3]') AND NOT regexp_full_match(name, 'view|err.*') GROUP BY ALL")
def s04(spark, d):
    s = S.Selector(S.event_samples(spark, d)).filter_like(from_instance="[1-3]").fetchall()
    s = s.where(~F.col("name").rlike("^(?:view|err.*)$"))
    return _flat(s).groupBy("name", "instance").agg(F.count(F.lit(1)).alias("n"))


@query("s08_metadata", f"""WITH {SAMP}, g AS (SELECT name, instance, ts_ms, ts_ms - lag(ts_ms) OVER (PARTITION BY name, instance ORDER BY ts_ms) AS step FROM samp),
 c AS (SELECT name, instance, step, count(*) AS n, min(ts_ms) AS t FROM g WHERE step IS NOT NULL GROUP BY ALL),
 s AS (SELECT *, row_number() OVER (PARTITION BY name, instance ORDER BY n DESC, t) AS r FROM c)
 SELECT s.name, s.instance, s.step, m.last_ms FROM s JOIN (SELECT name, instance, max(ts_ms) AS last_ms FROM samp GROUP BY ALL) m USING (name, instance) WHERE r = 1""")
def s08(spark, d):
    samples = _flat(S.event_samples(spark, d))
    last = samples.groupBy("name", "instance").agg(F.max("ts_ms").alias("last_ms"))
    return T.step_of(samples, ["name", "instance"]).join(last, ["name", "instance"])


@query("s09_negated_like", f"WITH {SAMP} SELECT name, count(*) AS n, round(sum(value), 4) AS total FROM samp WHERE NOT regexp_matches(instance, '^[0-4]$') GROUP BY name")
def s09(spark, d):
    s = S.event_samples(spark, d).where(S.matches("labels", "from_instance", "!~", "[0-4]"))
    return _r(s.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total", digits=4)


@query("s11_selector", f"WITH {SAMP} SELECT name, instance, ts_ms, value FROM samp WHERE name = 'error' AND instance = '7' AND ts_ms BETWEEN {START} AND {START + 10 * DAY}")
def s11(spark, d):
    return _flat(S.Selector(S.event_samples(spark, d)).metric("error").from_server("7").between(START, START + 10 * DAY).fetchone())


@query("s14_unpivot", """SELECT n_name AS nation, 'suppliers' AS metric, CAST(count(*) AS DOUBLE) AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL
 UNION ALL SELECT n_name, 'balance', round(sum(s_acctbal), 2) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def s14(spark, d):
    wide = S.table(spark, d, "supplier").join(S.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    wide = wide.groupBy(F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).cast("double").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
    return wide.unpivot(["nation"], ["suppliers", "balance"], "metric", "value")


@query("s16_derived_union", f"""WITH {EV} SELECT 'events_by_type' AS metric, name AS label, CAST(count(*) AS DOUBLE) AS value FROM ev GROUP BY name
 UNION ALL SELECT 'events_by_instance', instance, CAST(count(*) AS DOUBLE) FROM ev GROUP BY instance""")
def s16(spark, d):
    e = S.table(spark, d, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 10).cast("string").alias("instance"))
    one = lambda metric, label: e.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("metric", F.lit(metric))
    return one("events_by_type", "name").unionByName(one("events_by_instance", "instance")).select("metric", "label", "value")


@query("s24_retention", f"WITH {SAMP} SELECT name, count(*) AS n FROM samp WHERE ts_ms > {START + 20 * DAY} GROUP BY name")
def s24(spark, d):
    return S.event_samples(spark, d).where(F.col("ts_ms") > START + 20 * DAY).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("f08_coverage", f"""WITH {HR}, c AS (SELECT name, count(*) AS n FROM hr GROUP BY name HAVING count(*) >= 0.6 * floor((max(ts_ms) - min(ts_ms)) / 3600000)) SELECT * FROM c""")
def f08(spark, d):
    c = S.hourly(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.expr("0.6 * floor((max(ts_ms) - min(ts_ms)) / 3600000)").alias("_need"))
    return c.where("n >= _need").drop("_need")


@query("f11_label_subset", f"WITH {SAMP} SELECT name, count(*) AS n FROM samp WHERE instance = '3' GROUP BY name")
def f11(spark, d):
    wanted = F.create_map(F.lit("from_instance"), F.lit("3"))
    inside = F.forall(F.map_entries(wanted), lambda e: F.col("labels")[e["key"]] == e["value"])
    return S.event_samples(spark, d).where(inside).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


# --- the metric query language ------------------------------------------------------------------

INST = ["instance"]
_IRATE = f"""WITH {CNT}, l AS (SELECT *, lag(value) OVER w AS pv, lag(ts_ms) OVER w AS pt FROM cnt WINDOW w AS (PARTITION BY instance ORDER BY ts_ms)),
 ir AS (SELECT instance, ts_ms, (CASE WHEN value < pv THEN value ELSE value - pv END) / ((ts_ms - pt) / 1000) AS value FROM l WHERE pt > ts_ms - 600000)"""
_INC = f"""WITH {CNT}, l AS (SELECT *, lag(value) OVER w AS pv FROM cnt WINDOW w AS (PARTITION BY instance ORDER BY ts_ms)),
 g AS (SELECT instance, ts_ms, sum(CASE WHEN pv IS NULL THEN 0 WHEN value < pv THEN value ELSE value - pv END) OVER (PARTITION BY instance ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS grown FROM l),
 i AS (SELECT instance, ts_ms, grown - min(grown) OVER r AS value, count(*) OVER r AS n FROM g WINDOW r AS (PARTITION BY instance ORDER BY ts_ms RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW))"""


def _counter(spark, d):
    return S.counter(spark, d).drop("name")


@query("p02_irate", _IRATE + " SELECT instance, ts_ms, round(value, 6) AS value FROM ir")
def p02(spark, d):
    return _r(P.irate(_counter(spark, d), INST, 600_000), "value")


@query("p03_rate", _INC + " SELECT instance, ts_ms, round(value / 3600, 8) AS value FROM i WHERE n > 1")
def p03(spark, d):
    return _r(P.rate(_counter(spark, d), INST, 3_600_000), "value", digits=8)


@query("p03_extrapolated_rate", f"""WITH {CNT}, g AS (SELECT instance, ts_ms, value, sum(CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END) OVER (PARTITION BY instance ORDER BY ts_ms) AS c FROM (SELECT *, lag(value) OVER (PARTITION BY instance ORDER BY ts_ms) AS p FROM cnt)),
 r AS (SELECT b.instance, b.ts_ms, any_value(b.c) - min(a.c) AS grown, count(*) AS n, min(a.ts_ms) AS t0, arg_min(a.value, a.ts_ms) AS v0 FROM g b JOIN g a ON a.instance = b.instance AND a.ts_ms > b.ts_ms - 3600000 AND a.ts_ms <= b.ts_ms GROUP BY ALL HAVING count(*) > 1),
 m AS (SELECT *, ts_ms - t0 AS sampled, (ts_ms - t0) / (n - 1) AS mean, t0 - (ts_ms - 3600000) AS start FROM r)
 SELECT instance, ts_ms, round(grown * (sampled + least(CASE WHEN start < 1.1 * mean THEN start ELSE mean / 2 END, CASE WHEN grown > 0 AND v0 >= 0 THEN sampled * v0 / grown ELSE start END)) / sampled / 3600, 8) AS value FROM m""")
def p03_extrapolated(spark, d):
    return _r(P.rate(_counter(spark, d), INST, 3_600_000, extrapolated=True), "value", digits=8)


@query("p04_increase", _INC + " SELECT instance, ts_ms, value FROM i WHERE n > 1")
def p04(spark, d):
    return P.increase(_counter(spark, d), INST, 3_600_000)


@query("p05_sum_by", f"WITH {HR} SELECT ts_ms, round(sum(value), 5) AS value FROM hr GROUP BY ts_ms")
def p05(spark, d):
    return _r(P.aggregate_by(S.hourly(spark, d), "sum", []), "value", digits=5)


@query("p05_count_by", f"WITH {HR} SELECT ts_ms, CAST(count(*) AS DOUBLE) AS value FROM hr GROUP BY ts_ms")
def p05_count(spark, d):
    return P.aggregate_by(S.hourly(spark, d), "count", [])


def _named(spark, d, name):
    return S.hourly(spark, d).where(F.col("name") == name).select("ts_ms", "value")


@query("p06_binary", f"WITH {HR} SELECT a.ts_ms, round(a.value + b.value, 6) AS value FROM hr a JOIN hr b USING (ts_ms) WHERE a.name = 'click' AND b.name = 'view'")
def p06(spark, d):
    return _r(P.binary(_named(spark, d, "click"), _named(spark, d, "view"), [], lambda a, b: a + b), "value")


@query("p07_scale", f"WITH {HR} SELECT name, ts_ms, round(value / 1024, 9) AS value, n FROM hr")
def p07(spark, d):
    return _r(P.scale(S.hourly(spark, d), 1 / 1024), "value", digits=9)


@query("p08_compare", f"WITH {HR} SELECT name, ts_ms, value, n FROM hr WHERE value > 50")
def p08(spark, d):
    return P.compare(S.hourly(spark, d), F.col("value") > 50)


@query("p09_topk", f"WITH {HR}, r AS (SELECT *, row_number() OVER (PARTITION BY ts_ms ORDER BY value DESC, name) AS k FROM hr) SELECT name, ts_ms, value, n FROM r WHERE k <= 2")
def p09(spark, d):
    return P.topk(S.hourly(spark, d), 2, ["name"])


@query("p10_strip_port", f"WITH {SAMP} SELECT regexp_replace('10.0.0.' || instance || ':9100', '^(.*):.*$', '\\1') AS instance, count(*) AS n FROM samp GROUP BY 1")
def p10(spark, d):
    s = _flat(S.event_samples(spark, d)).withColumn("instance", F.concat(F.lit("10.0.0."), "instance", F.lit(":9100")))
    return s.select(P.strip_port().alias("instance")).groupBy("instance").agg(F.count(F.lit(1)).alias("n"))


@query("p11_ceil", f"WITH {HR} SELECT ts_ms, CAST(ceil(sum(value)) AS BIGINT) AS value FROM hr GROUP BY ts_ms")
def p11(spark, d):
    return P.aggregate_by(S.hourly(spark, d), "sum", []).withColumn("value", F.ceil("value"))


@query("p12_usage", f"WITH {HR} SELECT a.ts_ms, round(1 - a.value / b.value, 6) AS value FROM hr a JOIN hr b USING (ts_ms) WHERE a.name = 'click' AND b.name = 'view' AND b.value <> 0")
def p12(spark, d):
    return _r(P.ratio_left(_named(spark, d, "click"), _named(spark, d, "view").where("value <> 0"), []), "value")


@query("p13_sum_by_name", f"WITH {SAMP} SELECT name, round(sum(value), 4) AS value FROM samp GROUP BY name")
def p13(spark, d):
    return _r(S.event_samples(spark, d).groupBy("name").agg(F.sum("value").alias("value")), "value", digits=4)


# --- transforms ----------------------------------------------------------------------------------


@query("w02_shift", f"WITH {HR} SELECT name, ts_ms, lag(value, 3) OVER (PARTITION BY name ORDER BY ts_ms) AS value, n FROM hr")
def w02(spark, d):
    return T.shift(S.hourly(spark, d), KEY, 3)


for _how, _sql in (("median", "median(value)"), ("mean", "avg(value)"), ("std", "CASE WHEN count(*) {o} = 1 THEN 0.0 ELSE stddev_samp(value) {o} END")):
    _over = "OVER (PARTITION BY name ORDER BY ts_ms ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)"
    _expr = _sql.format(o=_over) if "{o}" in _sql else f"{_sql} {_over}"

    @query(f"w03_rolling_{_how}", f"WITH {HR} SELECT name, ts_ms, round({_expr}, 6) AS value, n FROM hr")
    def w03(spark, d, how=_how):
        return _r(T.rolling(S.hourly(spark, d), KEY, 6, how), "value")


def _changes(w1, w2, agg, change):
    l1, l2, w = w1 - 1 - (w1 - 1) // 2, w2 - 1 - (w2 - 1) // 2, max(w1, w2)
    fold = lambda v, a, b: {"median": f"median({v})", "mean": f"avg({v})", "std": f"stddev_samp({v})"}[agg] + f" OVER (PARTITION BY name ORDER BY ts_ms ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)"
    return f"""WITH {HR}, b AS (SELECT name, ts_ms, value AS v, lag(value) OVER s AS p, row_number() OVER s - 1 AS i, count(*) OVER (PARTITION BY name) AS m FROM hr WINDOW s AS (PARTITION BY name ORDER BY ts_ms)),
 c AS (SELECT *, {fold("p", l1, w1 - 1 - l1)} AS l, {fold("v", w2 - 1 - l2, l2)} AS r FROM b),
 e AS (SELECT name, ts_ms, i, m, v, r - l AS d, {change} AS a FROM c),
 f AS (SELECT x.name, x.ts_ms, x.v, y.d, y.a FROM e x JOIN e y ON x.name = y.name AND y.i = least(greatest(x.i, {w - 1 - (w - 1) // 2}), x.m - 1 - {(w - 1) // 2}))"""


@query("w05_double_rolling", _changes(5, 5, "median", "abs(r - l)") + " SELECT name, ts_ms, round(d, 6) AS diff, round(a, 6) AS change FROM f")
def w05(spark, d):
    return _r(T.double_rolling(S.hourly(spark, d), KEY, (5, 5), "median", "abs_diff"), "diff", "change").select("name", "ts_ms", "diff", "change")


@query("w06_difference", f"WITH {HR}, a AS (SELECT name, ts_ms, n, value - lag(value) OVER (PARTITION BY name ORDER BY ts_ms) AS value FROM hr) SELECT name, ts_ms, n, round(value - lag(value) OVER (PARTITION BY name ORDER BY ts_ms), 6) AS value FROM a")
def w06(spark, d):
    return _r(T.difference(S.hourly(spark, d), KEY, 2), "value")


@query("w07_zero_shift", f"WITH {HR} SELECT name, ts_ms, n, lead(value, 2, 0.0) OVER (PARTITION BY name ORDER BY ts_ms) AS value FROM hr")
def w07(spark, d):
    return T.shift(S.hourly(spark, d), KEY, -2, 0.0)


@query("w08_autocovariance", f"""WITH {HR}, i AS (SELECT name, value - avg(value) OVER (PARTITION BY name) AS x, row_number() OVER (PARTITION BY name ORDER BY ts_ms) AS i FROM hr),
 l AS (SELECT unnest(range(0, 25)) AS lag), s AS (SELECT a.name, l.lag, sum(a.x * b.x) AS c FROM i a, l, i b WHERE a.name = b.name AND b.i = a.i + l.lag GROUP BY ALL)
 SELECT s.name, s.lag, round(s.c / z.c, 6) AS acf FROM s JOIN s z ON s.name = z.name AND z.lag = 0""")
def w08(spark, d):
    from pyspark.sql import Window

    h = S.hourly(spark, d)
    i = h.withColumn("x", F.col("value") - F.avg("value").over(Window.partitionBy("name"))).withColumn("i", F.row_number().over(Window.partitionBy("name").orderBy("ts_ms")))
    lags = i.select("name", "x", F.col("i").alias("_i"), F.explode(F.expr("sequence(i, i + 24)")).alias("j"))
    pairs = lags.join(i.select("name", F.col("i").alias("j"), F.col("x").alias("y")), ["name", "j"])
    c = pairs.groupBy("name", (F.col("j") - F.col("_i")).cast("long").alias("lag")).agg(F.sum(F.col("x") * F.col("y")).alias("c"))
    zero = F.max(F.when(F.col("lag") == 0, F.col("c"))).over(Window.partitionBy("name"))
    return c.select("name", "lag", F.round(F.col("c") / zero, 6).alias("acf"))


@query("w09_trend", f"""WITH {HR}, t AS (SELECT *, count(*) OVER w AS k, (sum(value) OVER w - (lag(value, 12) OVER s + lead(value, 12) OVER s) / 2) / 24 AS trend FROM hr
 WINDOW w AS (PARTITION BY name ORDER BY ts_ms ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING), s AS (PARTITION BY name ORDER BY ts_ms)) SELECT name, ts_ms, round(CASE WHEN k = 25 THEN trend END, 5) AS trend FROM t""")
def w09(spark, d):
    return _r(T.trend(S.hourly(spark, d), KEY, 24), "trend", digits=5).select("name", "ts_ms", "trend")


@query("w10_seasonal_means", f"""WITH {HR}, p AS (SELECT *, (row_number() OVER (PARTITION BY name ORDER BY ts_ms) - 1) % 24 AS phase FROM hr),
 m AS (SELECT name, phase, avg(value) AS a FROM p GROUP BY ALL), c AS (SELECT name, phase, a - avg(a) OVER (PARTITION BY name) AS s FROM m)
 SELECT p.name, p.ts_ms, round(c.s, 5) AS seasonal FROM p JOIN c USING (name, phase)""")
def w10(spark, d):
    return _r(T.seasonal_means(S.hourly(spark, d), KEY, 24), "seasonal", digits=5).select("name", "ts_ms", "seasonal")


_HOT = f"WITH {HR}, h AS (SELECT *, value > 60 AS hot, row_number() OVER (PARTITION BY name ORDER BY ts_ms) AS i, count(*) OVER (PARTITION BY name) AS m FROM hr), "


@query("w12_islands", _HOT + """j AS (SELECT *, i - row_number() OVER (PARTITION BY name ORDER BY ts_ms) AS g FROM h WHERE hot)
 SELECT name, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS n FROM j GROUP BY name, g HAVING min(i) > 1 AND max(i) < max(m)""")
def w12(spark, d):
    return T.islands(D.threshold(S.hourly(spark, d).drop("n"), KEY, high=60.0), KEY, drop_ends=True)


_FILLED = f"""{HR}, b AS (SELECT name, min(ts_ms) AS a, max(ts_ms) AS z FROM hr GROUP BY name), g AS (SELECT name, unnest(range(a, z + 1, 3600000)) AS ts_ms FROM b),
 v AS (SELECT g.name, g.ts_ms, hr.value, CASE WHEN hr.value IS NOT NULL THEN g.ts_ms END AS t FROM g LEFT JOIN hr USING (name, ts_ms)),
 k AS (SELECT name, ts_ms, value, last_value(value IGNORE NULLS) OVER p AS v0, first_value(value IGNORE NULLS) OVER f AS v1, last_value(t IGNORE NULLS) OVER p AS t0, first_value(t IGNORE NULLS) OVER f AS t1 FROM v
  WINDOW p AS (PARTITION BY name ORDER BY ts_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY name ORDER BY ts_ms ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 fl AS (SELECT name, ts_ms, coalesce(value, v0 + (v1 - v0) * (ts_ms - t0) / nullif(t1 - t0, 0), v0, v1) AS value FROM k)"""

#: An additive decomposition by a period of 24, of dx (name, ts_ms, value, i from 0, n).
_DECOMPOSED = """dm AS (SELECT *, CASE WHEN i BETWEEN 12 AND n - 13 THEN (sum(value) OVER (PARTITION BY name ORDER BY i ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) - 0.5 * lag(value, 12) OVER (PARTITION BY name ORDER BY i) - 0.5 * lead(value, 12) OVER (PARTITION BY name ORDER BY i)) / 24 END AS m FROM dx),
 de AS (SELECT name, regr_slope(m, i) FILTER (i <= 36) AS s0, max(m) FILTER (i = 12) AS m0, regr_slope(m, i) FILTER (i >= n - 37) AS s1, max(m) FILTER (i = n - 13) AS m1 FROM dm WHERE m IS NOT NULL GROUP BY name),
 dt AS (SELECT dm.*, CASE WHEN i < 12 THEN m0 + s0 * (i - 12) WHEN i > n - 13 THEN m1 + s1 * (i - n + 13) ELSE m END AS trend FROM dm JOIN de USING (name)),
 dp AS (SELECT name, i % 24 AS phase, avg(value - trend) AS p FROM dt GROUP BY ALL), dc AS (SELECT name, phase, p - avg(p) OVER (PARTITION BY name) AS seasonal FROM dp),
 dd AS (SELECT dt.name, ts_ms, value, i, n, trend, seasonal, value - trend - seasonal AS residual FROM dt JOIN dc ON dc.name = dt.name AND dc.phase = dt.i % 24)"""
_PLACES = "row_number() OVER (PARTITION BY name ORDER BY ts_ms) - 1 AS i, count(*) OVER (PARTITION BY name) AS n"


@query("w13_interpolate", f"WITH {_FILLED} SELECT name, ts_ms, round(value, 5) AS value FROM fl")
def w13(spark, d):
    return _r(T.interpolate(T.fill_grid(S.hourly(spark, d).drop("n"), KEY, 3_600_000), KEY), "value", digits=5)


@query("t03_align", f"""WITH {HR}, g AS (SELECT name, ts_ms, ts_ms - lag(ts_ms) OVER w AS gap, first_value(ts_ms) OVER w AS f FROM hr WINDOW w AS (PARTITION BY name ORDER BY ts_ms))
 SELECT name, ts_ms, CAST(f + sum(CASE WHEN gap IS NULL THEN 0 ELSE greatest(gap // 7200000, 1) * 7200000 END) OVER (PARTITION BY name ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS aligned_ms FROM g""")
def t03(spark, d):
    return T.align(S.hourly(spark, d), KEY, 7_200_000).select("name", "ts_ms", F.col("aligned_ms").cast("long").alias("aligned_ms"))


@query("t05_trim_ends", f"""WITH {HR}, v AS (SELECT name, ts_ms, CASE WHEN n > 1 THEN value END AS value FROM hr),
 k AS (SELECT name, ts_ms, value, last_value(value IGNORE NULLS) OVER (PARTITION BY name ORDER BY ts_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b, first_value(value IGNORE NULLS) OVER (PARTITION BY name ORDER BY ts_ms ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM v)
 SELECT name, ts_ms, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN value ELSE coalesce(b, a, 0.0) END AS value FROM k""")
def t05(spark, d):
    return T.trim_ends(S.hourly(spark, d).select("name", "ts_ms", F.when(F.col("n") > 1, F.col("value")).alias("value")), KEY)


@query("t07_decimate", f"WITH {HR}, i AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts_ms) - 1 AS i FROM hr) SELECT name, ts_ms, value, n FROM i WHERE i % 6 = 0")
def t07(spark, d):
    return T.decimate(S.hourly(spark, d), KEY, 6)


@query("t12_sliding_window", f"""WITH {EV}, w AS (SELECT name, unnest([ts_ms - ts_ms % 1800000, ts_ms - ts_ms % 1800000 - 1800000]) AS start_ms, value FROM ev)
 SELECT name, start_ms, count(*) AS n, round(max(value), 6) AS top FROM w GROUP BY ALL""")
def t12(spark, d):
    e = S.table(spark, d, "events").select(F.col("event_type").alias("name"), S.epoch_ms("ts").alias("ts_ms"), "value")
    starts = F.explode(F.array(*(F.expr(f"ts_ms - ts_ms % 1800000 - {k}") for k in (0, 1_800_000))))
    return e.select("name", starts.alias("start_ms"), "value").groupBy("name", "start_ms").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 6).alias("top"))


@query("t16_tumbling_second", f"WITH {EV} SELECT ts_ms // 1000 * 1000 AS second_ms, count(*) AS n FROM ev GROUP BY 1")
def t16(spark, d):
    return S.table(spark, d, "events").select((F.floor(S.epoch_ms("ts") / 1000) * 1000).cast("long").alias("second_ms")).groupBy("second_ms").agg(F.count(F.lit(1)).alias("n"))


_IV = f"{HR}, iv AS (SELECT name, ts_ms AS start_ms, ts_ms + 3600000 * (n % 3) AS end_ms FROM hr WHERE value > 40)"


def _intervals(spark, d):
    return S.hourly(spark, d).where("value > 40").select("name", F.col("ts_ms").alias("start_ms"), F.expr("ts_ms + 3600000 * (n % 3)").alias("end_ms"))


_MERGE = """r AS (SELECT *, max(end_ms) OVER (PARTITION BY name ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
 g AS (SELECT *, sum(CASE WHEN start_ms <= reach + {slack} THEN 0 ELSE 1 END) OVER (PARTITION BY name ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS k FROM r),
 mg AS (SELECT name, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM g GROUP BY name, k)"""


@query("u03_merge_intervals", f"WITH {_IV}, {_MERGE.format(src='iv', slack=0)} SELECT * FROM mg")
def u03(spark, d):
    return T.merge_intervals(_intervals(spark, d), KEY)


@query("u04_overlap", f"WITH {_IV} SELECT a.name, a.start_ms AS s, greatest(a.start_ms, b.start_ms) AS start_ms, least(a.end_ms, b.end_ms) AS end_ms FROM iv a JOIN iv b ON a.name = b.name AND b.start_ms = a.start_ms + 3600000 WHERE greatest(a.start_ms, b.start_ms) < least(a.end_ms, b.end_ms)")
def u04(spark, d):
    a = _intervals(spark, d)
    b = a.select("name", F.col("start_ms").alias("bs"), F.col("end_ms").alias("be"), (F.col("start_ms") - 3_600_000).alias("start_ms"))
    o = a.join(b, ["name", "start_ms"]).withColumn("o", T.overlap(F.col("start_ms"), F.col("end_ms"), F.col("bs"), F.col("be"))).where("o is not null")
    return o.select("name", F.col("start_ms").alias("s"), "o.start_ms", "o.end_ms")


@query("u05_gaps", f"""WITH {_IV}, c AS (SELECT * FROM iv WHERE end_ms >= {START} AND start_ms <= {START + 29 * DAY}), {_MERGE.format(src='c', slack=3600000)},
 x AS (SELECT name, end_ms + 3600000 AS start_ms, lead(start_ms) OVER (PARTITION BY name ORDER BY start_ms) - 3600000 AS end_ms FROM mg),
 y AS (SELECT name, start_ms, end_ms FROM x WHERE end_ms IS NOT NULL UNION ALL SELECT name, {START}, min(start_ms) - 3600000 FROM mg GROUP BY name UNION ALL SELECT name, max(end_ms) + 3600000, {START + 29 * DAY} FROM mg GROUP BY name)
 SELECT * FROM y WHERE start_ms <= end_ms""")
def u05(spark, d):
    return T.find_gaps(_intervals(spark, d), KEY, START, START + 29 * DAY, 3_600_000)


@query("u02_concatenate", f"WITH {HR} SELECT name, ts_ms, CASE WHEN ts_ms >= {START + 10 * DAY} THEN value * 2 ELSE value END AS value FROM hr")
def u02(spark, d):
    h = S.hourly(spark, d).drop("n")
    return T.concatenate(h.where(F.col("ts_ms") < START + 12 * DAY), h.where(F.col("ts_ms") >= START + 10 * DAY).withColumn("value", F.col("value") * 2), KEY)


# --- detectors -----------------------------------------------------------------------------------


def _hits(df):
    return df.where("is_anomaly").select("name", "ts_ms", "value")


def _hr(spark, d):
    return S.hourly(spark, d).drop("n")


@query("d01_threshold", f"WITH {HR} SELECT name, ts_ms, value FROM hr WHERE value > 70 OR value < 10")
def d01(spark, d):
    return _hits(D.threshold(_hr(spark, d), KEY, 70.0, 10.0))


@query("d01_threshold_share", f"WITH {HR}, f AS (SELECT *, count(*) FILTER (value > 40) OVER (PARTITION BY name) >= 0.3 * count(*) OVER (PARTITION BY name) AS a FROM hr) SELECT name, ts_ms, value FROM f WHERE a")
def d01_share(spark, d):
    return _hits(D.threshold(_hr(spark, d), KEY, 40.0, share=0.3))


_Q = "q AS (SELECT name, quantile_cont(value, {a}) AS q1, quantile_cont(value, {b}) AS q3 FROM hr GROUP BY name)"


@query("d02_iqr", f"WITH {HR}, {_Q.format(a=0.25, b=0.75)} SELECT name, ts_ms, value FROM hr JOIN q USING (name) WHERE value > q3 + 1.5 * (q3 - q1) OR value < q1 - 1.5 * (q3 - q1)")
def d02(spark, d):
    return _hits(D.iqr(_hr(spark, d), KEY, (1.5, 1.5)))


@query("d03_quantile", f"WITH {HR}, {_Q.format(a=0.05, b=0.95)} SELECT name, ts_ms, value FROM hr JOIN q USING (name) WHERE value > q3 OR value < q1")
def d03(spark, d):
    return _hits(D.quantile(_hr(spark, d), KEY, 0.95, 0.05))


@query("d04_mad", f"WITH {HR}, m AS (SELECT *, abs(value - median(value) OVER (PARTITION BY name)) AS off FROM hr), s AS (SELECT *, median(off) OVER (PARTITION BY name) * 1.4826 AS mad FROM m) SELECT name, ts_ms, value FROM s WHERE off / nullif(mad, 0) > 2.5")
def d04(spark, d):
    return _hits(D.mad(_hr(spark, d), KEY, 2.5))


def _detector_sql(w1, w2, agg, change, k):
    return _changes(w1, w2, agg, change) + f""", q AS (SELECT name, quantile_cont(a, 0.25) AS q1, quantile_cont(a, 0.75) AS q3 FROM f GROUP BY name)
 SELECT name, ts_ms, v AS value FROM f JOIN q USING (name) WHERE a > q3 + {k} * (q3 - q1) AND d IS NOT NULL"""


@query("d05_spike", _detector_sql(3, 1, "median", "abs(r - l)", 1.5))
def d05(spark, d):
    return _hits(D.spike(_hr(spark, d), KEY, (None, 1.5), window=3))


@query("d06_level_shift", _detector_sql(5, 5, "median", "abs(r - l)", 1.5))
def d06(spark, d):
    return _hits(D.level_shift(_hr(spark, d), KEY, (None, 1.5)))


@query("d07_volatility_shift", _detector_sql(10, 10, "std", "abs(r - l) / nullif(l, 0)", 1.5))
def d07(spark, d):
    return _hits(D.volatility_shift(_hr(spark, d), KEY, (None, 1.5)))


@query("d08_seasonal", f"""WITH {HR}, x AS (SELECT name, ts_ms, value AS v, {_PLACES} FROM hr), r AS (SELECT *, avg(v) OVER (PARTITION BY name ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS w FROM x),
 dx AS (SELECT r.name, r.ts_ms, e.w AS value, r.i, r.n FROM r JOIN r e ON e.name = r.name AND e.i = least(greatest(r.i, 5), r.n - 5)), {_DECOMPOSED}, q AS (SELECT name, quantile_cont(residual, 0.25) AS q1, quantile_cont(residual, 0.75) AS q3 FROM dd GROUP BY name)
 SELECT name, ts_ms, residual > q3 + 3 * (q3 - q1) AND residual > 0 AND i BETWEEN 5 AND n - 6 AS is_anomaly FROM dd JOIN q USING (name)""")
def d08(spark, d):
    return D.seasonal(_hr(spark, d), KEY, period=24).select("name", "ts_ms", "is_anomaly")


@query("d09_gradient", _changes(1, 1, "median", "abs(r - l)") + """, q AS (SELECT name, quantile_cont(a, 0.25) AS q1, quantile_cont(a, 0.75) AS q3 FROM f GROUP BY name),
 s AS (SELECT f.name, ts_ms, v, a > q3 + 3 * (q3 - q1) AND d > 0 AS hot FROM f JOIN q USING (name)),
 calm AS (SELECT name, ts_ms, CASE WHEN hot THEN coalesce(lag(v) OVER w, first_value(CASE WHEN NOT hot THEN v END IGNORE NULLS) OVER (PARTITION BY name ORDER BY ts_ms ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) ELSE v END AS v FROM s WINDOW w AS (PARTITION BY name ORDER BY ts_ms))
 SELECT name, round(regr_slope(v, CAST(ts_ms AS DOUBLE)) * 1e9, 3) > 0 AS is_anomaly FROM calm GROUP BY name""")
def d09(spark, d):
    return D.gradient(_hr(spark, d), KEY, max_coef=0.0).groupBy("name").agg(F.bool_and("is_anomaly").alias("is_anomaly"))


_BINOM = """t AS (SELECT n, k, 2 * sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) OVER (PARTITION BY n ORDER BY k ROWS UNBOUNDED PRECEDING) AS p FROM (SELECT DISTINCT n FROM s), range(0, 100000) r(k) WHERE k <= n // 2),
 l AS (SELECT n, arg_min(p, k) AS level FROM (SELECT n, k, p, lead(p) OVER (PARTITION BY n ORDER BY k) - p AS step FROM t) WHERE step > 1e-5 GROUP BY n)"""


@query("d10_increase", f"""WITH {HR}, i AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY ts_ms) AS i, count(*) OVER (PARTITION BY name) AS n FROM hr),
 s AS (SELECT a.name, any_value(a.n) AS n, count(*) FILTER (b.value > a.value) AS up, count(*) FILTER (b.value < a.value) AS down FROM i a JOIN i b ON a.name = b.name AND b.i = a.i + a.n // 2 AND a.i <= a.n // 2 GROUP BY a.name),
 g AS (SELECT name, regr_slope(value, i) AS slope FROM i GROUP BY name), {_BINOM} SELECT s.name, up >= down AND slope > 0 AND p < level AS is_anomaly FROM s JOIN g USING (name) JOIN l ON l.n = s.n JOIN t ON t.n = s.n AND t.k = least(s.down, s.n // 2)""")
def d10(spark, d):
    return D.increase(_hr(spark, d), KEY).groupBy("name").agg(F.bool_and("is_anomaly").alias("is_anomaly"))


@query("d11_esd")
def d11(spark, d):
    return D.esd(_hr(spark, d), KEY).select("name", "ts_ms", "is_anomaly")


@query("d14_multi_condition", f"WITH {HR}, {_Q.format(a=0.25, b=0.75)}, f AS (SELECT name, ts_ms FROM hr JOIN q USING (name) WHERE value > 45 AND (value > q3 + 0.5 * (q3 - q1))) SELECT name, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS n, 30 AS level, 'high' AS content FROM f GROUP BY name")
def d14(spark, d):
    h = _hr(spark, d)
    both = D.combine([D.threshold(h, KEY, 45.0), D.iqr(h, KEY, (None, 0.5))], KEY)
    return D.alarms(both, KEY, 30, "high")


@query("d17_overview", f"WITH {HR}, {_Q.format(a=0.05, b=0.95)} SELECT name, 'threshold' AS detector, count(*) FILTER (value > 70) AS anomalies FROM hr GROUP BY name UNION ALL SELECT name, 'quantile', count(*) FILTER (value > q3 OR value < q1) FROM hr JOIN q USING (name) GROUP BY name")
def d17(spark, d):
    h = _hr(spark, d)
    return D.overview({"threshold": D.threshold(h, KEY, 70.0), "quantile": D.quantile(h, KEY, 0.95, 0.05)}, KEY).select("name", "detector", "anomalies")


@query("d18_bounds", f"""WITH {HR} SELECT name, round(quantile_cont(value, .25) - 1.5 * (quantile_cont(value, .75) - quantile_cont(value, .25)), 4) AS box_low, round(quantile_cont(value, .75) + 1.5 * (quantile_cont(value, .75) - quantile_cont(value, .25)), 4) AS box_high,
 round(avg(value) - 3 * stddev_pop(value), 4) AS sigma_low, round(avg(value) + 3 * stddev_pop(value), 4) AS sigma_high FROM hr GROUP BY name""")
def d18(spark, d):
    q = lambda p: F.percentile("value", F.lit(p))
    spread = q(0.75) - q(0.25)
    return _r(
        _hr(spark, d).groupBy("name").agg(
            (q(0.25) - 1.5 * spread).alias("box_low"), (q(0.75) + 1.5 * spread).alias("box_high"),
            (F.avg("value") - 3 * F.stddev_pop("value")).alias("sigma_low"), (F.avg("value") + 3 * F.stddev_pop("value")).alias("sigma_high"),
        ), "box_low", "box_high", "sigma_low", "sigma_high", digits=4,
    )


@query("u08_or_merge", f"WITH {HR}, {_Q.format(a=0.05, b=0.95)} SELECT name, ts_ms FROM hr JOIN q USING (name) WHERE value > 70 OR value > q3 OR value < q1")
def u08(spark, d):
    h = _hr(spark, d)
    return D.combine([D.threshold(h, KEY, 70.0), D.quantile(h, KEY, 0.95, 0.05)], KEY, "or").where("is_anomaly").select("name", "ts_ms")


# --- expressions of the language ----------------------------------------------------------------

_EXPR = f"""WITH {CNT}, g AS (SELECT unnest(range({START + 5 * DAY}, {START + 6 * DAY} + 1, 1800000)) AS t),
 l AS (SELECT instance, ts_ms, CASE WHEN lag(value) OVER w IS NULL THEN 0 WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS d FROM cnt WHERE ts_ms BETWEEN {START + 5 * DAY - 7200000} AND {START + 6 * DAY} WINDOW w AS (PARTITION BY instance ORDER BY ts_ms)),
 j AS (SELECT t, instance, ts_ms, d FROM g JOIN l ON ts_ms > t - 7200000 AND ts_ms <= t), i AS (SELECT t, instance, sum(d) - arg_min(d, ts_ms) AS v FROM j GROUP BY ALL HAVING count(*) > 1)"""


def _counters(spark, d):
    c = S.counter(spark, d)
    return c.select("name", F.create_map(F.lit("instance"), "instance", F.lit("job"), F.lit("j")).alias("labels"), "ts_ms", "value")


@query("s06_custom_query", _EXPR + " SELECT t AS ts_ms, CAST(ceil(sum(v)) AS DOUBLE) AS value FROM i WHERE regexp_full_match(instance, '[0-4]') GROUP BY t")
def s06(spark, d):
    from tidewatch.plans.language import evaluate

    return evaluate(_counters(spark, d), "ceil(sum(increase(events_total{instance=~'[0-4]'}[2h])) by (job))", START + 5 * DAY, START + 6 * DAY, 1_800_000).drop("labels")


@query("s16_derived_metric", _EXPR + ", r AS (SELECT t, instance, v / 7200 AS v, row_number() OVER (PARTITION BY t ORDER BY v DESC, instance) AS k FROM i) SELECT instance, t AS ts_ms, round(v, 8) AS value FROM r WHERE k <= 3")
def s16_expr(spark, d):
    from tidewatch.plans.language import evaluate

    top = evaluate(_counters(spark, d), "topk(3, sum(rate(events_total[2h])) by (instance))", START + 5 * DAY, START + 6 * DAY, 1_800_000)
    return top.select(F.col("labels")["instance"].alias("instance"), "ts_ms", F.round("value", 8).alias("value"))
