"""Queries of sources, reports and the remaining numeric operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions import numerics
from tidewatch.operators import advisor as A
from tidewatch.operators import arima as AR
from tidewatch.operators import detectors as D
from tidewatch.operators import memory as M
from tidewatch.operators import results as R
from tidewatch.operators import rewrite as W
from tidewatch.operators import sqltext as Q
from tidewatch.operators import statistics as K
from tidewatch.operators import transforms as T
from tidewatch.plans.metrics import _DECOMPOSED, _FILLED, _PLACES, DAY, EV, HR, SAMP, START, _changes
from tidewatch.plans.registry import query
from tidewatch.plans.results import SLOW, slow
from tidewatch.sources import series as S
from tidewatch.sources import texts as X
from tidewatch.sources.series import hourly, table

KEY = ["name"]


def _n(name="n"):
    return F.count(F.lit(1)).alias(name)


# --- sources -------------------------------------------------------------------------------------


@query("s05_answer", """WITH n AS (SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS k FROM nation) SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'm' ELSE 'other' END AS name, k AS instance, 1704067200500 + 15000 * i AS ts_ms,
 CASE WHEN (n_nationkey + i) % 3 > 0 THEN n_nationkey * 1.5 + i END AS value FROM n, range(0, 10) r(i) WHERE i < n_nationkey % 4""")
def s05(spark, d):
    k = "cast(n_nationkey as string)"
    points = "array_join(transform(filter(sequence(0, 9), i -> i < n_nationkey % 4), i -> concat('[', 1704067200.5 + 15 * i, ',\"', if((n_nationkey + i) % 3 = 0, 'NaN', cast(n_nationkey * 1.5 + i as string)), '\"]')), ',')"
    answer = f"concat('[{{\"metric\":{{\"__name__\":\"', if(n_nationkey % 2 = 0, 'm', 'other'), '\",\"instance\":\"', {k}, '\"}},\"values\":[', {points}, ']}}]')"
    got = X.from_answer(table(spark, d, "nation").selectExpr(f"{answer} AS a"), "a")
    return got.select("name", F.col("labels")["instance"].alias("instance"), "ts_ms", "value")


@query("s07_delete_range", f"WITH {SAMP} SELECT name, count(*) AS n FROM samp WHERE NOT (name = 'click' AND instance = '1' AND ts_ms BETWEEN {START} AND {START + 9 * DAY}) GROUP BY name")
def s07(spark, d):
    s = S.event_samples(spark, d)
    gone = (F.col("name") == "click") & S.matches("labels", "from_instance", "=", "1") & F.col("ts_ms").between(START, START + 9 * DAY)
    return s.where(~gone).groupBy("name").agg(_n())


@query("s12_latest_minutes", f"WITH {SAMP} SELECT name, count(*) AS n FROM samp WHERE ts_ms BETWEEN {START + 20 * DAY} - 600 * 60000 AND {START + 20 * DAY} GROUP BY name")
def s12(spark, d):
    now = START + 20 * DAY
    return S.Selector(S.event_samples(spark, d)).between(now - 600 * 60_000, now).fetchall().groupBy("name").agg(_n())


@query("s15_zip_columns", "SELECT n_nationkey, unnest([0, 1, 2]) AS a, unnest([n_name, 'x', NULL]) AS b FROM nation")
def s15(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return X.zip_columns(n, a=F.array(F.lit(0), F.lit(1), F.lit(2)), b=F.array("n_name", F.lit("x"))).select("n_nationkey", "a", "b")


@query("s18_log_statements", """SELECT c_custkey AS session, 'update t set a = ' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN ' where b = ' || c_custkey ELSE '' END || ';select 1;' AS statement FROM customer WHERE c_custkey % 2 = 0
 UNION ALL SELECT c_custkey, 'update t set a = ' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN ' where b = ' || c_custkey ELSE '' END || ';' FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT c_custkey, 'select 1;' FROM customer WHERE c_custkey % 2 = 1
 UNION ALL SELECT c_custkey, 'select ' || c_custkey || ' from t;' FROM customer""")
def s18(spark, d):
    """Sessions with and without a transaction, one or two parameters, a statement over two lines; ten sessions to a file, interleaved."""
    k, two, tx = "cast(c_custkey as string)", "c_custkey % 3 = 0", "c_custkey % 2 = 0"
    lines = (
        f"if({tx}, 'statement: begin', 'connection received')", f"concat('execute p: update t set a = $1', if({two}, ' where b = $2', ''))", f"concat('DETAIL:  parameters: $1 = ', c_nationkey, if({two}, concat(', $2 = ', c_custkey), ''))",
        "'statement: select 1'", f"if({tx}, 'statement: commit', 'disconnection')", f"concat('statement: select ', {k})", "'from t'",
    )
    head = f"concat('2024-01-01 00:00:00.000 ', {k}, ' db LOG:  ')"
    texts = [line if line == "'from t'" else f"concat({head}, {line})" for line in lines]
    c = table(spark, d, "customer").selectExpr("c_custkey div 10 AS file", "c_custkey", f"posexplode(array({', '.join(texts)})) AS (i, value)")
    # Sessions take turns by line, but for the last two lines, which are one record.
    placed = c.withColumn("line_no", F.expr("if(i < 5, i * 100 + c_custkey % 10, 500 + c_custkey % 10 * 2 + i - 5)"))
    return X.log_statements(X.log_records(placed, "%m %c %d"), "c").select(F.col("c").cast("int").alias("session"), "statement")


@query("s19_valid_statements", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def s19(spark, d):
    o = table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, "select a from t").when(F.col("o_orderkey") % 3 == 1, "select * from pg_class").otherwise("set x = 1")
    return o.where(X.is_worth_keeping(text)).select("o_orderkey")


@query("s20_workloads", f"WITH {SLOW} SELECT DISTINCT s.template, s.db FROM slow s JOIN customer c ON s.template = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE s.duration >= 200000 AND n.n_name LIKE '%1%'")
def s20(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    s = R.select(slow(spark, d), since=("duration", 200000)).join(c, F.col("template") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return s.where(F.col("n_name").contains("1")).select("template", "db").distinct()


@query("s21_load_report", "SELECT 'SELECT ? FROM T' AS template, round(o_totalprice / 1e6, 8) AS seconds FROM orders WHERE o_orderkey % 2 = 0")
def s21(spark, d):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("select "), F.col("o_orderkey").cast("string"), F.lit(" from t"))).otherwise("vacuum t")
    o = table(spark, d, "orders").select(text.alias("sql"), "o_totalprice")
    return X.data_statements(o, "sql", "o_totalprice").withColumn("seconds", F.round("seconds", 8))


@query("s26_terminal_and_dsn", """SELECT n_nationkey, CAST(i AS INT) AS row, i || ':' || n_name AS cell, 'h' || n_nationkey AS host, CASE WHEN n_nationkey % 2 = 0 THEN 'u' || n_regionkey END AS user FROM nation, range(0, 10) r(i) WHERE i < 1 + n_nationkey % 3""")
def s26(spark, d):
    body = "array_join(transform(sequence(0, n_nationkey % 3), i -> concat(' ', i, ' | ', i, ':', n_name)), char(10))"
    text = f"concat(' id | name ', char(10), '----+------', char(10), {body}, char(10), '(', 1 + n_nationkey % 3, ' rows)', char(10))"
    n = table(spark, d, "nation").selectExpr("n_nationkey", f"{text} AS text", "concat('host=h', n_nationkey, if(n_nationkey % 2 = 0, concat('  user=u', n_regionkey), ''), ' port=1') AS dsn")
    rows = X.table_output(n, "n_nationkey", "text").select("n_nationkey", F.col("row").cast("int").alias("row"), F.col("cells")[1].alias("cell"))
    parts = X.dsn_parts(F.col("dsn"))
    return rows.join(n.select("n_nationkey", parts["host"].alias("host"), parts["user"].alias("user")), "n_nationkey")


@query("f09_validity", f"WITH {SAMP} SELECT name, instance FROM samp GROUP BY ALL HAVING count(value) > 0")
def f09(spark, d):
    s = S.event_samples(spark, d).where(F.size("labels") > 0).withColumn("instance", F.col("labels")["from_instance"])
    return s.groupBy("name", "instance").agg(F.count("value").alias("_n")).where("_n > 0").drop("_n")


# --- joins and reports ---------------------------------------------------------------------------


@query("j10_condition_product", f"WITH {HR} SELECT a.name AS first, b.name AS second, count(*) AS n FROM hr a JOIN hr b ON a.ts_ms = b.ts_ms AND a.name < b.name WHERE a.value > 50 AND b.value > 50 GROUP BY ALL")
def j10(spark, d):
    hot = hourly(spark, d).where("value > 50")
    a, b = hot.select(F.col("name").alias("first"), "ts_ms"), hot.select(F.col("name").alias("second"), "ts_ms")
    return a.join(b, "ts_ms").where("first < second").groupBy("first", "second").agg(_n())


@query("a21_daily_report", f"WITH {EV} SELECT name, instance, round(avg(value), 4) AS avg, round(min(value), 4) AS min, round(max(value), 4) AS max, round(quantile_cont(value, 0.95), 4) AS p95 FROM ev WHERE ts_ms BETWEEN {START} AND {START + DAY} GROUP BY ALL")
def a21(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 10).cast("string").alias("instance"), S.epoch_ms("ts").alias("ts_ms"), "value")
    return R.profile(e.where(F.col("ts_ms").between(START, START + DAY)), ["name", "instance"], "value")


@query("w01_newest", f"WITH {SLOW}, r AS (SELECT instance, id, row_number() OVER (PARTITION BY instance ORDER BY start_ms DESC, id) AS k FROM slow) SELECT instance, id FROM r WHERE k = 1")
def w01(spark, d):
    return R.top_in_group(slow(spark, d), ["instance"], [F.col("start_ms").desc(), F.col("id")], 1).select("instance", "id")


@query("w04_edge_padding", f"WITH {HR}, n AS (SELECT name, ts_ms, value, row_number() OVER (PARTITION BY name ORDER BY ts_ms) - 1 AS i, count(*) OVER (PARTITION BY name) AS m FROM hr) SELECT x.name, x.ts_ms, y.value FROM n x JOIN n y ON x.name = y.name AND y.i = least(greatest(x.i, 3), x.m - 1 - 2)")
def w04(spark, d):
    return T.pad_edges(hourly(spark, d).drop("n"), KEY, 6, ["value"])


@query("w11_decomposition", f"WITH {_FILLED}, dx AS (SELECT name, ts_ms, value, {_PLACES} FROM fl), {_DECOMPOSED} SELECT name, ts_ms, round(value, 5) AS value, round(seasonal, 5) AS seasonal, round(residual, 5) AS residual FROM dd")
def w11(spark, d):
    filled = T.interpolate(T.fill_grid(hourly(spark, d).drop("n"), KEY, 3_600_000), KEY)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_ms")
        trend, seasonal, rest = numerics.decompose(pdf["value"].to_numpy(dtype=float), 24)
        return pdf.assign(trend=trend, seasonal=seasonal, residual=rest)

    found = filled.groupBy("name").applyInPandas(run, "name string, ts_ms long, value double, trend double, seasonal double, residual double")
    return found.select("name", "ts_ms", *(F.round(c, 5).alias(c) for c in ("value", "seasonal", "residual")))


@query("o02_active", f"WITH {SLOW} SELECT id, start_ms FROM slow WHERE kind = 'UPDATE' AND duration > 250000")
def o02(spark, d):
    return slow(spark, d).where("kind = 'UPDATE' AND duration > 250000").select("id", "start_ms").orderBy(F.col("start_ms").desc(), "id")


@query("o05_nearest_templates", "WITH s AS (SELECT p_partkey, n_name, 1.0 / levenshtein(p_name, n_name) AS sim FROM part, nation WHERE p_name <> n_name), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY sim DESC, n_name) AS k FROM s) SELECT p_partkey, n_name, round(CAST(sim AS DOUBLE), 6) AS sim FROM r WHERE k <= 2")
def o05(spark, d):
    names = table(spark, d, "nation").select("n_name")
    near = Q.nearest_templates(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", names, "n_name", 2)
    return near.select("p_partkey", "n_name", F.round("similarity", 6).alias("sim"))


# --- texts ---------------------------------------------------------------------------------------


@query("c09_identity", """WITH i AS (SELECT p_partkey, upper(p_name) || '/' || upper(p_brand) AS identity FROM part), c AS (SELECT *, list_transform(string_split(identity, ''), lambda c: CAST(ascii(c) AS BIGINT)) AS codes FROM i)
 SELECT p_partkey, identity, list_reduce(list_prepend(CAST(length(identity) AS BIGINT), codes), lambda h, c: xor(xor(h * 32, h >> 27), c) & 4294967295) AS hash1, list_reduce(list_prepend(CAST(5381 AS BIGINT), codes), lambda h, c: (h * 33 + c) & 4294967295) AS hash2 FROM c""")
def c09(spark, d):
    text = F.concat(F.upper("p_name"), F.lit("/"), F.upper("p_brand"))
    return table(spark, d, "part").select("p_partkey", text.alias("identity"), Q.dek_hash(text).alias("hash1"), Q.djb_hash(text).alias("hash2"))


@query("c12_epoch", "SELECT n_nationkey, 1704067200 + n_nationkey AS seconds FROM nation")
def c12(spark, d):
    text = F.concat(F.lit("2024-01-01 00:00:"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit(".123"))
    return table(spark, d, "nation").select("n_nationkey", text.alias("text")).selectExpr("n_nationkey", "cast(timestampdiff(SECOND, timestamp '1970-01-01 00:00:00', cast(split_part(text, '.', 1) as timestamp)) as int) as seconds")


@query("c27_arithmetic", "SELECT o_orderkey, lower(trim('  X' || o_orderstatus)) AS s, coalesce(nullif(o_custkey % 5, 0), -1) AS c, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code, CAST(strpos(o_orderpriority, '-') AS INT) AS at FROM orders")
def c27(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", F.lower(F.trim(F.concat(F.lit("  X"), "o_orderstatus"))).alias("s"), F.coalesce(F.nullif(F.col("o_custkey") % 5, F.lit(0)), F.lit(-1)).alias("c"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(0).alias("code"), F.instr("o_orderpriority", "-").alias("at"),
    )


#: Statements by o_orderkey % 10, and what their rewriting gives, as SQL for both engines.
_WRITTEN = (
    ("'select a from t where b = ' || k || ' or b = ' || c", "CASE WHEN k = c THEN 'select a from t where b IN (' || k || ')' ELSE 'select a from t where b IN (' || k || ', ' || c || ')' END"),
    ("'select a from t where b + 3 < ' || k", "'select a from t where b < ' || k || ' - 3'"),
    ("'delete from t' || c", "'TRUNCATE TABLE t' || c"),
    ("'select a from t where b in (select x from u where y = ' || k || ')'", "'select a from t where EXISTS (SELECT 1 FROM u WHERE y = ' || k || ' AND u.x = t.b)'"),
    ("'select count(distinct a) from t where b = ' || c", "'SELECT count(a) FROM (SELECT a FROM t where b = ' || c || ' GROUP BY a) AS x'"),
    ("'select a, sum(b) from t group by a having a > ' || k || ' and sum(b) > 2'", "'select a, sum(b) from t WHERE a > ' || k || ' GROUP BY a HAVING sum(b) > 2'"),
    ("'select a from t where b > ' || k || ' and b < ' || c", "CASE WHEN k >= c THEN 'select a from t WHERE 1 = 0' ELSE 'select a from t where b > ' || k || ' and b < ' || c END"),
    ("'select distinct * from t where a = ' || c", "'select a, b from t where a = ' || c"),
    ("'select a, b from t where 1 = 1 and a > ' || c || ' order by 2'", "'select a, b from t WHERE a > ' || c || ' order by b'"),
    ("'select a from t join v on t.x = v.x where lower(b) = c'", "'select a from t join v on t.x = v.x where lower(b) = c'"),
)
#: Statements whose meaning a rule would change if it overlooked an AND, a larger term, a subquery or a join; and after them those that it may change.
_CAREFUL = (
    ("'select a from t where a = 1 or a = ' || c || ' and b = 3'", None),
    ("'select a from t where b = ' || c || ' and a = 1 or a = 2'", None),
    ("'select a from t where a - b * 2 < ' || c", None),
    ("'select a from t where b in (select x from w where c = ' || c || ') or b = 1 order by c'", "'select a from t where EXISTS (SELECT 1 FROM w WHERE c = ' || c || ' AND w.x = t.b) or b = 1 order by c'"),
    ("'select a from t left join w on w.c = ' || c || ' order by c'", None),
    ("'select a from t where b = ' || c || ' and (a = 1 or a = 2)'", "'select a from t where b = ' || c || ' and (a IN (1, 2))'"),
    ("'select a from t where c = ' || c || ' and a - 2 < 10 order by c, a'", "'select a from t where c = ' || c || ' and a < 10 + 2 order by a'"),
)


def _written(spark, d):
    text = "CASE k % 10 " + " ".join(f"WHEN {i} THEN {t}" for i, (t, _) in enumerate(_WRITTEN)) + " END"
    return table(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c").selectExpr("k AS id", f"{text} AS sql")


@query("c15_tree_probes", """SELECT o_orderkey AS id, CASE o_orderkey % 10 WHEN 2 THEN 't' || o_custkey WHEN 3 THEN 't,u' WHEN 9 THEN 't,v' ELSE 't' END AS tables, CAST(o_orderkey % 10 = 9 AS INT) AS joins, CAST(o_orderkey % 10 = 3 AS INT) AS subqueries, 0 AS in_list, o_orderkey % 10 = 9 AS function_in_filter FROM orders""")
def c15(spark, d):
    found = W.text_probes(F.col("sql"))
    return _written(spark, d).select("id", F.array_join(found.pop("tables"), ",").alias("tables"), *(c.alias(n) for n, c in found.items()))


@query("r01_rewrites", "SELECT k AS id, CASE k % 10 " + " ".join(f"WHEN {i} THEN {t}" for i, (_, t) in enumerate(_WRITTEN)) + " END AS rewritten FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders)")
def r01(spark, d):
    return W.rewrite_texts(_written(spark, d), "sql", {"t"}, {"t": ["a", "b"]}).select("id", "rewritten")


@query("r02_careful_rewrites", "SELECT k AS id, CASE k % 7 " + " ".join(f"WHEN {i} THEN {t or u}" for i, (u, t) in enumerate(_CAREFUL)) + " END AS rewritten FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders)")
def r02(spark, d):
    text = "CASE k % 7 " + " ".join(f"WHEN {i} THEN {t}" for i, (t, _) in enumerate(_CAREFUL)) + " END"
    o = table(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c").selectExpr("k AS id", f"{text} AS sql")
    return W.rewrite_texts(o, "sql").select("id", "rewritten")


# --- series --------------------------------------------------------------------------------------


@query("t02_tidy_up", f"""WITH RECURSIVE {HR}, c AS (SELECT name, ts_ms + CASE WHEN n % 4 = 0 THEN 1200000 WHEN n % 4 = 1 THEN 0 ELSE 2400000 END AS ts_ms, value, row_number() OVER (PARTITION BY name ORDER BY ts_ms) AS i FROM hr),
 w AS (SELECT name, i, ts_ms AS spot, ts_ms AS first, value, true AS kept FROM c WHERE i = 1 UNION ALL SELECT c.name, c.i, CASE WHEN c.ts_ms - w.spot < 3600000 THEN w.spot ELSE w.spot + (c.ts_ms - w.spot) // 3600000 * 3600000 END, w.first, c.value, c.ts_ms - w.spot >= 3600000 FROM w JOIN c ON c.name = w.name AND c.i = w.i + 1),
 k AS (SELECT name, spot, value FROM w WHERE kept), e AS (SELECT name, min(spot) AS a, max(spot) AS z FROM k GROUP BY name), g AS (SELECT name, unnest(range(a, z + 1, 3600000)) AS ts_ms FROM e) SELECT g.name, g.ts_ms, k.value FROM g LEFT JOIN k ON k.name = g.name AND k.spot = g.ts_ms""")
def t02(spark, d):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_ms")
        ts, values = numerics.tidy_up(pdf["ts_ms"].to_numpy(), pdf["value"].to_numpy(dtype=float), 3_600_000)
        return pd.DataFrame({"name": pdf["name"].iloc[0], "ts_ms": ts, "value": values})

    late = F.when(F.col("n") % 4 == 0, 1_200_000).when(F.col("n") % 4 == 1, 0).otherwise(2_400_000)
    tidy = hourly(spark, d).select("name", (F.col("ts_ms") + late).alias("ts_ms"), "value").groupBy("name").applyInPandas(run, "name string, ts_ms long, value double")
    return tidy.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


@query("t06_approximate_merge", f"WITH {HR}, m AS (SELECT name, max(ts_ms) AS l FROM hr GROUP BY name) SELECT name, ts_ms, value FROM hr UNION ALL SELECT name, l + ts_ms - {START} + 3600000, value FROM hr JOIN m USING (name) WHERE ts_ms < {START} + 36000000")
def t06(spark, d):
    h = hourly(spark, d).drop("n")
    last = h.groupBy("name").agg(F.max("ts_ms").alias("_last"))
    ahead = h.where(F.col("ts_ms") < START + 36_000_000).join(last, "name").select("name", (F.col("_last") + F.col("ts_ms") - START + 3_600_000).alias("ts_ms"), "value")
    return T.concatenate(h, ahead, KEY)


@query("t08_round_bounds", f"WITH {HR} SELECT name, ts_ms - ts_ms % 7000000 AS low, ts_ms + (7000000 - ts_ms % 7000000) % 7000000 AS high FROM hr")
def t08(spark, d):
    return hourly(spark, d).select("name", F.expr("ts_ms - ts_ms % 7000000").alias("low"), F.expr("ts_ms + (7000000 - ts_ms % 7000000) % 7000000").alias("high"))


@query("d12_remove_spikes", _changes(1, 1, "median", "abs(r - l)") + """, q AS (SELECT name, quantile_cont(a, 0.25) AS q1, quantile_cont(a, 0.75) AS q3 FROM f GROUP BY name),
 s AS (SELECT f.name, ts_ms, v, a > q3 + 3 * (q3 - q1) AND d > 0 AS hot FROM f JOIN q USING (name))
 SELECT name, ts_ms, CASE WHEN hot THEN coalesce(lag(v) OVER w, first_value(CASE WHEN NOT hot THEN v END IGNORE NULLS) OVER (PARTITION BY name ORDER BY ts_ms ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) ELSE v END AS value FROM s WINDOW w AS (PARTITION BY name ORDER BY ts_ms)""")
def d12(spark, d):
    return D.remove_spikes(hourly(spark, d).drop("n"), KEY)


@query("x01_periods")
def x01(spark, d):
    filled = T.interpolate(T.fill_grid(hourly(spark, d).drop("n"), KEY, 3_600_000), KEY)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("ts_ms")["value"].to_numpy(dtype=float)
        statistic, lags = numerics.adf(values)
        p = numerics.adf_p_value(statistic)
        return pd.DataFrame({"name": [pdf["name"].iloc[0]], "period": [numerics.season(values) or 0], "adf": [statistic], "lags": [lags], "p": [p]})

    return filled.groupBy("name").applyInPandas(run, "name string, period long, adf double, lags long, p double")


@query("x02_model_choice", f"WITH {HR} SELECT name, CASE WHEN regr_r2(value, CAST(ts_ms AS DOUBLE)) >= 0.9 THEN 'linear' ELSE 'arima' END AS model FROM hr GROUP BY name")
def x02(spark, d):
    return K.line_fit(hourly(spark, d), KEY).select("name", F.when(F.col("r2") >= 0.9, "linear").otherwise("arima").alias("model"))


@query("x04_arima")
def x04(spark, d):
    """Forecasts of each series by its best model, all candidates of all series being fitted side by side."""
    filled = T.interpolate(T.fill_grid(hourly(spark, d).drop("n"), KEY, 3_600_000), KEY)
    return AR.forecast(AR.best_orders(filled, KEY), KEY, 12)


# --- advice --------------------------------------------------------------------------------------


@query("i08_tree_search")
def i08(spark, d):
    worth = {r["p_size"]: r["w"] for r in table(spark, d, "part").where("p_size IS NOT NULL").groupBy("p_size").agg(F.sum("p_retailprice").alias("w")).collect()}
    # 371 sets of different sizes from 1 fit the room of 20; twice as many rounds see them all.
    chosen, value = A.tree_search(lambda s: sum(worth[i] for i in s), sorted(worth), {i: float(i) for i in worth}, 20.0, rounds=1000)
    return spark.createDataFrame([(i, value) for i in chosen], "index_id int, benefit double")


@query("m03_directories", "SELECT p_partkey, p_size * 100 AS total, p_partkey % 90 * p_size AS used, p_size * 100 - p_partkey % 90 * p_size AS free, p_partkey % 90 / 100.0 >= 0.7 AS warned, round(coalesce(iops, 0), 4) AS iops FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) / 60 AS iops FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE p_size > 0")
def m03(spark, d):
    p = table(spark, d, "part").where("p_size > 0").selectExpr("p_partkey AS directory", "p_size * 100 AS total", "p_partkey % 90 * p_size AS used")
    requests = table(spark, d, "lineitem").select(F.col("l_partkey").alias("directory"), F.col("l_quantity").alias("requests"))
    return M.directory_status(p, requests, 60).select(F.col("directory").alias("p_partkey"), "total", "used", "free", "warned", F.round("iops", 4).alias("iops"))


@query("c16_formatted", "SELECT n_nationkey, 'SELECT a' || chr(10) || 'FROM t' || n_nationkey || chr(10) || 'WHERE b = 1' AS sql FROM nation")
def c16(spark, d):
    text = F.concat(F.lit("select  a from t"), F.col("n_nationkey").cast("string"), F.lit("\n where b = 1"))
    return table(spark, d, "nation").select("n_nationkey", Q.formatted(text).alias("sql"))


@query("c17_placeholders", "SELECT n_nationkey, 'select $1 from t' || n_nationkey || ' where a = $2' AS sql FROM nation")
def c17(spark, d):
    text = F.concat(F.lit("select ? from t"), F.col("n_nationkey").cast("string"), F.lit(" where a = ?"))
    return table(spark, d, "nation").select("n_nationkey", Q.placeholders(text).alias("sql"))


@query("c02_fine_template", """SELECT CASE p_size % 4 WHEN 0 THEN 'SELECT col FROM tab WHERE col = ? ORDER BY col' WHEN 1 THEN 'UPDATE tab SET col = ? WHERE col = ?' WHEN 2 THEN 'DELETE FROM tab WHERE col = ?'
 ELSE 'SELECT col FROM tab JOIN tab ON col = col' END AS template, count(*) AS n FROM part GROUP BY 1""")
def c02(spark, d):
    texts = ("'select a from t' || x || ' where b = ' || p_size || ' order by c'", "'update t' || x || ' set a = ' || p_size || ' where c= ' || p_partkey", "'delete from t' || x || ' where a=' || p_partkey", "'select b from t' || x || ' join t1 on a = c'")
    text = "CASE p_size % 4 " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(texts)) + " END"
    p = table(spark, d, "part").selectExpr("*", "p_partkey % 7 AS x").selectExpr(f"{text} AS sql")
    return p.select(Q.fine_template(F.col("sql"), [f"t{k}" for k in range(7)], ["a", "b", "c"]).alias("template")).groupBy("template").agg(_n())


#: Templates of a workload by the number of their statement's customer, and statements of parts that are known, like known ones, of a kind without model, or no SQL.
_HISTORY = "CASE k % 3 WHEN 0 THEN 'SELECT C' || k % 7 || ', D' || k % 11 || ' FROM T' || k % 53 || '_X WHERE A' || k % 5 || ' = ?' WHEN 1 THEN 'UPDATE T' || k % 53 || '_X SET C' || k % 7 || ' = ? WHERE B' || k % 11 || ' = ?' ELSE 'DELETE FROM T' || k % 101 || '_X WHERE E' || k % 13 || ' = ?' END"
_ASKED = """CASE k % 7 WHEN 0 THEN 'selec c from t' || k % 40 WHEN 1 THEN 'insert into t' || k % 9 || ' values (' || k || ')' WHEN 2 THEN 'select c9z, d' || k % 11 || ' from t' || k % 53 || '_x where a' || k % 5 || ' = 1 and f = ' || k
 WHEN 3 THEN 'update t' || k % 53 || '_x set c = ' || k || ' where b' || k % 11 || ' = 3' WHEN 4 THEN 'delete from t' || k % 101 || '_x where e = 4' WHEN 5 THEN 'select c' || k % 7 || ', d' || k % 11 || ' from t' || k % 53 || '_x where a' || k % 5 || ' = ' || k
 ELSE 'update nothing_like_it set some_column = other_column + ' || k END"""
_ASKED_TEMPLATE = "regexp_replace(regexp_replace(upper(regexp_replace(sql, 'values.*', 'values')), '\\b[0-9]+\\b', '?', 'g'), ' +', ' ', 'g')"


@query("g02_predicted_durations", f"""WITH h AS (SELECT o_orderkey AS id, o_custkey AS k, o_totalprice AS duration FROM orders), t AS (SELECT id, {_HISTORY} AS template, duration FROM h),
 r AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY id DESC) AS n FROM t), l AS (SELECT template, avg(duration) AS mean, list(duration ORDER BY id) AS d FROM r WHERE n <= 5 GROUP BY template),
 model AS (SELECT template, mean, list_reduce(d, lambda a, x: (a + x) / 2) AS expected, string_split(template, ' ')[1] AS head FROM l),
 a AS (SELECT DISTINCT {_ASKED} AS sql FROM (SELECT p_partkey AS k FROM part)), q AS (SELECT sql, {_ASKED_TEMPLATE} AS template FROM a), z AS (SELECT *, string_split(template, ' ')[1] AS head FROM q WHERE head IN ('SELECT', 'INSERT', 'UPDATE', 'DELETE')),
 u AS (SELECT DISTINCT template, head FROM z WHERE template NOT IN (SELECT template FROM model)),
 n AS (SELECT u.template, m.mean, 1.0 / levenshtein(u.template, m.template) AS s, row_number() OVER (PARTITION BY u.template ORDER BY levenshtein(u.template, m.template), m.mean DESC, m.template DESC) AS k FROM u JOIN model m ON u.head = m.head),
 g AS (SELECT template, sum(s * mean) / sum(s) AS seconds FROM n WHERE k <= 3 GROUP BY template)
 SELECT sql, CASE WHEN z.sql IS NULL THEN NULL ELSE round(coalesce(m.expected, g.seconds), 4) END AS seconds,
  CASE WHEN z.sql IS NULL THEN 'Suspect illegal sql' WHEN m.template IS NOT NULL THEN 'Fine match' WHEN g.template IS NOT NULL THEN 'No SQL template found' ELSE 'No SQL information' END AS status
 FROM a LEFT JOIN z USING (sql) LEFT JOIN model m ON m.template = z.template LEFT JOIN g ON g.template = z.template""")
def g02(spark, d):
    """All four answers: illegal texts, known templates, similar ones by edit distance, and kinds without a model."""
    history = table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_custkey AS k", "o_totalprice AS duration").selectExpr("id", f"{_HISTORY} AS template", "duration")
    model = Q.duration_model(history, "template", "id", "duration", 5)
    asked = table(spark, d, "part").selectExpr("p_partkey AS k").selectExpr(f"{_ASKED} AS sql")
    return Q.predict_duration(asked, model, "sql").withColumn("seconds", F.round("seconds", 4))


@query("n06_swarm", "WITH x AS (SELECT l_quantity / 50 AS u, l_extendedprice / (SELECT max(l_extendedprice) FROM lineitem) AS v FROM lineitem), f AS (SELECT regr_slope(v, u) AS a, regr_intercept(v, u) AS b FROM x) SELECT round(a, 2) AS setting, round(b, 2) AS base, round(avg((v - a * u - b) ** 2), 5) AS cost FROM x, f GROUP BY a, b")
def n06(spark, d):
    """The setting and base that explain the load of all rows best, found by a swarm; the SQL has them in closed form."""
    l = table(spark, d, "lineitem")
    most = l.agg(F.max("l_extendedprice").alias("most"))
    load = l.crossJoin(F.broadcast(most)).select((F.col("l_quantity") / 50).alias("u"), (F.col("l_extendedprice") / F.col("most")).alias("v"))
    (setting, base), cost = A.swarm(load, lambda x: (F.col("v") - x[0] * F.col("u") - x[1]) ** 2, [-1.0, -1.0], [2.0, 2.0], particles=16, rounds=45)
    return spark.createDataFrame([(round(setting, 2) + 0.0, round(base, 2) + 0.0, round(cost, 5))], "setting double, base double, cost double")


@query("q36_summary", f"WITH {SLOW} SELECT instance, count(*) AS n, count(DISTINCT template) AS templates, count(*) FILTER (kind = 'SELECT') AS reads, round(avg(duration), 4) AS mean, round(max(duration), 4) AS longest FROM slow GROUP BY instance")
def q36(spark, d):
    return slow(spark, d).groupBy("instance").agg(_n(), F.count_distinct("template").alias("templates"), F.count_if(F.col("kind") == "SELECT").alias("reads"), F.round(F.avg("duration"), 4).alias("mean"), F.round(F.max("duration"), 4).alias("longest"))


@query("g03_word_vectors")
def g03(spark, d):
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.regression import LinearRegression

    texts = slow(spark, d).select(F.split(F.concat_ws(" ", F.lower("kind"), "db", F.concat(F.lit("t"), "instance")), " ").alias("words"), F.col("duration").alias("label"))
    vectors = Word2Vec(vectorSize=4, minCount=0, inputCol="words", outputCol="features", seed=1, maxIter=1).fit(texts).transform(texts)
    model = LinearRegression(maxIter=20).fit(vectors)
    return model.transform(vectors).select("label", F.col("prediction").alias("predicted"))
