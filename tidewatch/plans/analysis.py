"""Queries of statistics, forecasts, statement texts, plans, causes, advice, configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import advisor as A
from tidewatch.operators import knobs as N
from tidewatch.operators import results as R
from tidewatch.operators import sqltext as Q
from tidewatch.operators import statistics as K
from tidewatch.operators import transforms as T
from tidewatch.plans.metrics import HR
from tidewatch.plans.registry import query
from tidewatch.plans.results import SLOW, slow
from tidewatch.sources.series import hourly, table

KEY = ["name"]


def _round(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _parts(spark, d):
    h = hourly(spark, d).drop("n")
    return h.where("name = 'click'"), h.where("name <> 'click'")


# --- statistics ----------------------------------------------------------------------------------


@query("k01_correlate_with", f"WITH {HR} SELECT o.name, round(coalesce(corr(o.value, t.value), 0), 6) AS coefficient FROM hr o JOIN hr t ON o.ts_ms = t.ts_ms AND t.name = 'click' WHERE o.name <> 'click' GROUP BY o.name")
def k01(spark, d):
    return _round(K.correlate_with(*_parts(spark, d), KEY), "coefficient")


_SHIFT = f"""WITH {HR}, n AS (SELECT o.name, o.ts_ms, o.value AS v, t.value AS x, row_number() OVER (PARTITION BY o.name ORDER BY o.ts_ms) AS i FROM hr o JOIN hr t ON o.ts_ms = t.ts_ms AND t.name = 'click' WHERE o.name <> 'click'),
 s AS (SELECT unnest(range(-3, 4)) AS shift), m AS (SELECT a.name, s.shift, a.i, a.x, coalesce(b.v, 0.0) AS y FROM n a JOIN s ON true LEFT JOIN n b ON b.name = a.name AND b.i = a.i - s.shift)"""


@query("k02_shifted_pearson", _SHIFT + """, c AS (SELECT name, shift, coalesce(corr(x, y), 0) AS c FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY abs(c) DESC, shift) AS k FROM c)
 SELECT name, CAST(shift AS INT) AS shift, round(c, 6) AS coefficient FROM r WHERE k = 1""")
def k02(spark, d):
    return _round(K.shifted_correlation(*_parts(spark, d), KEY, 3), "coefficient")


@query("k03_coflux", _SHIFT + """, p AS (SELECT name, shift, 2 * sum(x * y) - arg_min(x * y, i) - arg_max(x * y, i) AS xy, 2 * sum(x * x) - arg_min(x * x, i) - arg_max(x * x, i) AS xx, 2 * sum(y * y) - arg_min(y * y, i) - arg_max(y * y, i) AS yy FROM m GROUP BY ALL),
 c AS (SELECT name, shift, xy / sqrt(xx * yy) AS c FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY abs(c) DESC, shift) AS k FROM c) SELECT name, CAST(shift AS INT) AS shift, round(c, 6) AS coefficient FROM r WHERE k = 1""")
def k03(spark, d):
    return _round(K.shifted_correlation(*_parts(spark, d), KEY, 3, "coflux"), "coefficient")


@query("k04_holt_winters", f"""WITH RECURSIVE {HR}, h AS (SELECT name, ts_ms, value, row_number() OVER (PARTITION BY name ORDER BY ts_ms) - 1 AS i FROM hr),
 w AS (SELECT name, CAST(-1 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS ts_ms, value AS level, value AS slope, list_transform(range(0, 24), lambda x: CAST(0 AS DOUBLE)) AS s, CAST(NULL AS DOUBLE) AS rest FROM h WHERE i = 0
  UNION ALL SELECT name, i, ts_ms, now, grown, list_transform(range(0, 24), lambda x: CASE WHEN x = k THEN 0.2 * (value - now) + 0.8 * season ELSE s[x + 1] END), value - now - (0.2 * (value - now) + 0.8 * season)
   FROM (SELECT *, 0.2 * (now - level) + 0.8 * slope AS grown FROM (SELECT h.name, h.i, h.ts_ms, h.value, h.i % 24 AS k, w.s, w.level, w.slope, w.s[h.i % 24 + 1] AS season, 0.2 * (h.value - w.s[h.i % 24 + 1]) + 0.8 * (w.level + w.slope) AS now FROM w JOIN h ON h.name = w.name AND h.i = w.i + 1)))
 SELECT name, ts_ms, round(rest, 6) AS value FROM w WHERE i >= 0""")
def k04(spark, d):
    return _round(K.residuals(hourly(spark, d), KEY, "holt_winters", smoothing=(0.2, 0.2, 0.2, 24)), "value")


@query("k04_differences", f"WITH {HR}, a AS (SELECT name, ts_ms, value - lag(value) OVER w AS v FROM hr WINDOW w AS (PARTITION BY name ORDER BY ts_ms)), b AS (SELECT name, ts_ms, v - lag(v) OVER w AS value FROM a WHERE v IS NOT NULL WINDOW w AS (PARTITION BY name ORDER BY ts_ms)) SELECT name, ts_ms, round(value, 6) AS value FROM b WHERE value IS NOT NULL")
def k04_diff(spark, d):
    return _round(K.residuals(hourly(spark, d), KEY, "diff", times=2), "value")


@query("k04_historical", f"WITH {HR} SELECT name, ts_ms, round(value - avg(value) OVER w, 6) AS from_mean, round(value - median(value) OVER w, 6) AS from_median FROM hr WINDOW w AS (PARTITION BY name)")
def k04_history(spark, d):
    h = hourly(spark, d)
    both = K.residuals(h, KEY, "historical_avg").withColumnRenamed("value", "from_mean").join(K.residuals(h, KEY, "historical_med").withColumnRenamed("value", "from_median"), ["name", "ts_ms"])
    return _round(both, "from_mean", "from_median")


@query("k04_wavelet", f"""WITH {HR}, n AS (SELECT name, ts_ms, value, row_number() OVER (PARTITION BY name ORDER BY ts_ms) AS i FROM hr), f AS (SELECT name, max(value) FILTER (i = 1) AS a, max(value) FILTER (i = 2) AS b, max(value) FILTER (i = 3) AS c FROM n GROUP BY name)
 SELECT n.name, n.ts_ms, round(n.value - (y.value * a + n.value * b + x.value * c), 6) AS value FROM n JOIN f USING (name) JOIN n x ON x.name = n.name AND x.i = n.i - 1 JOIN n y ON y.name = n.name AND y.i = n.i + 1""")
def k04_wavelet(spark, d):
    return _round(K.residuals(hourly(spark, d), KEY, "wavelet"), "value")


@query("k05_top_correlated", f"WITH {HR}, c AS (SELECT o.name, coalesce(corr(o.value, t.value), 0) AS c FROM hr o JOIN hr t ON o.ts_ms = t.ts_ms AND t.name = 'click' WHERE o.name <> 'click' GROUP BY o.name) SELECT name, round(c, 6) AS coefficient FROM c ORDER BY c DESC, name LIMIT 2")
def k05(spark, d):
    return _round(K.correlate_with(*_parts(spark, d), KEY).orderBy(F.col("coefficient").desc(), "name").limit(2), "coefficient")


@query("k06_line_fit", f"WITH {HR} SELECT name, round(regr_slope(value, n), 6) AS slope, round(regr_intercept(value, n), 6) AS intercept, round(regr_r2(value, n), 6) AS r2 FROM hr GROUP BY name")
def k06(spark, d):
    return _round(K.line_fit(hourly(spark, d), KEY, "n"), "slope", "intercept", "r2")


_HALF = "ts_ms >= 1705363200000"


_CHANGE = f"g AS (SELECT name, avg(value) FILTER ({_HALF}) AS c, avg(value) FILTER (NOT {_HALF}) AS h, coalesce(sum(value) FILTER ({_HALF}), 0) AS sc, coalesce(sum(value) FILTER (NOT {_HALF}), 0) AS sh FROM hr GROUP BY name)"


@query("k07_mean_change", f"WITH {HR}, {_CHANGE} SELECT name, round(CASE WHEN c < h THEN 0 ELSE (c - h) / (c + 1e-10) END, 6) AS magnitude, c * 0.98 > h AS significant FROM g")
def k07(spark, d):
    h = hourly(spark, d).withColumn("recent", F.expr(_HALF))
    return _round(K.change_significance(h, KEY, "recent", "mean", 0.02), "magnitude")


@query("k07_sum_change", f"WITH {HR}, {_CHANGE} SELECT name, round(CASE WHEN sc < sh THEN 0 ELSE (sc - sh) / (sc + 1e-10) END, 6) AS magnitude, sc * 0.98 > sh AS significant FROM g")
def k07_sum(spark, d):
    h = hourly(spark, d).withColumn("recent", F.expr(_HALF))
    return _round(K.change_significance(h, KEY, "recent", "sum", 0.02), "magnitude")


_KS = f"""b AS (SELECT name, value, count(*) FILTER ({_HALF}) AS a, count(*) FILTER (NOT {_HALF}) AS b FROM hr GROUP BY ALL),
 u AS (SELECT name, abs(sum(a) OVER u / sum(a) OVER w - sum(b) OVER u / sum(b) OVER w) AS g FROM b WINDOW u AS (PARTITION BY name ORDER BY value ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY name)), d AS (SELECT name, max(g) AS d FROM u GROUP BY name),
 m AS (SELECT name, sqrt(count(*) FILTER ({_HALF}) * count(*) FILTER (NOT {_HALF}) / count(*)) AS m FROM hr GROUP BY name), z AS (SELECT name, d, (m + 0.12 + 0.11 / m) * d AS z FROM d JOIN m USING (name)),
 p AS (SELECT name, d, CASE WHEN z < 0.2 THEN 1 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0 * k * k * z * z))))) END AS p FROM z)"""


@query("k08_ks_test", f"WITH {HR}, {_KS} SELECT name, round(d, 6) AS d, round(p, 6) AS p, p >= 0.05 AS alike FROM p")
def k08_test(spark, d):
    return _round(K.ks_test(hourly(spark, d).withColumn("recent", F.expr(_HALF)), KEY, "recent"), "d", "p")


@query("k09_vote", f"WITH {HR}, {_CHANGE}, {_KS} SELECT name, CAST(c * 0.98 > h AS INT) + CAST(sc * 0.98 > sh AS INT) + CAST(p >= 0.5 AS INT) AS votes, CAST(c * 0.98 > h AS INT) + CAST(sc * 0.98 > sh AS INT) + CAST(p >= 0.5 AS INT) >= 2 AS changed FROM g JOIN p USING (name)")
def k09(spark, d):
    return K.change_vote(hourly(spark, d).withColumn("recent", F.expr(_HALF)), KEY, "recent", least=0.02)


@query("k08_ks_statistic", f"""WITH {HR}, b AS (SELECT name, value, count(*) FILTER ({_HALF}) AS a, count(*) FILTER (NOT {_HALF}) AS b FROM hr GROUP BY ALL),
 c AS (SELECT name, abs(sum(a) OVER u / sum(a) OVER w - sum(b) OVER u / sum(b) OVER w) AS g FROM b WINDOW u AS (PARTITION BY name ORDER BY value ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY name)) SELECT name, round(max(g), 6) AS d FROM c GROUP BY name""")
def k08(spark, d):
    return _round(K.ks_statistic(hourly(spark, d).withColumn("recent", F.expr(_HALF)), KEY, "recent"), "d")


@query("c23_min_max", f"WITH {HR} SELECT name, ts_ms, n, round((value - min(value) OVER w) / CASE WHEN max(value) OVER w = min(value) OVER w THEN 1 ELSE max(value) OVER w - min(value) OVER w END, 6) AS value FROM hr WINDOW w AS (PARTITION BY name)")
def c23(spark, d):
    return _round(K.min_max(hourly(spark, d), KEY), "value")


@query("c24_amplify", f"WITH {HR}, z AS (SELECT *, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM hr WINDOW w AS (PARTITION BY name)) SELECT name, ts_ms, n, round(sign(z) * (exp(least(abs(z), 10) / 2) - 1), 5) AS value FROM z")
def c24(spark, d):
    return _round(K.amplify(hourly(spark, d), KEY), "value", digits=5)


@query("c25_counts_beyond", f"WITH {HR} SELECT name, count(*) FILTER (value < 40) AS lesser, count(*) FILTER (value > 60) AS larger FROM hr GROUP BY name")
def c25(spark, d):
    return hourly(spark, d).groupBy("name").agg(F.count_if(F.col("value") < 40).alias("lesser"), F.count_if(F.col("value") > 60).alias("larger"))


# --- forecasts -----------------------------------------------------------------------------------


@query("x03_linear_forecast", f"""WITH {HR}, h AS (SELECT name, ts_ms, value * 1 AS value FROM hr), f AS (SELECT name, regr_slope(value, CAST(ts_ms AS DOUBLE)) AS a, regr_intercept(value, CAST(ts_ms AS DOUBLE)) AS b, max(ts_ms) AS l FROM h GROUP BY name)
 SELECT name, l + k * 3600000 AS ts_ms, round(b + a * (l + k * 3600000), 3) AS value FROM f, range(1, 25) t(k)""")
def x03(spark, d):
    return _round(K.linear_forecast(hourly(spark, d), KEY, 3_600_000, 24), "value", digits=3)


@query("x08_forecast")
def x08(spark, d):
    filled = T.interpolate(T.fill_grid(hourly(spark, d).drop("n"), KEY, 3_600_000), KEY)
    return K.forecast(filled, KEY, 3_600_000, 24, low=0.0)


# --- statement texts -----------------------------------------------------------------------------

_SQL = "'select * from t' || (o_custkey % 7) || ' where a=' || o_orderkey || ' and b = ''x' || o_custkey || ''' -- c'"


def _texts(spark, d):
    text = F.concat(F.lit("select * from t"), (F.col("o_custkey") % 7).cast("string"), F.lit(" where a="), F.col("o_orderkey").cast("string"), F.lit(" and b = 'x"), F.col("o_custkey").cast("string"), F.lit("' -- c"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("sql"), F.col("o_totalprice").alias("duration"))


@query("c01_templates", f"SELECT 'SELECT * FROM T' || (o_custkey % 7) || ' WHERE A = ? AND B = ?' AS template, count(*) AS n FROM orders GROUP BY 1")
def c01(spark, d):
    return _texts(spark, d).groupBy(Q.templatise(F.col("sql")).alias("template")).agg(F.count(F.lit(1)).alias("n"))


@query("c03_workload_template", f"SELECT regexp_replace(regexp_replace({_SQL}, '''[^'']*''', '@@@', 'g'), '\\b[0-9]+(\\.[0-9]+)?\\b', '@@@', 'g') AS template, count(*) AS n FROM orders GROUP BY 1")
def c03(spark, d):
    return _texts(spark, d).groupBy(Q.workload_template(F.col("sql")).alias("template")).agg(F.count(F.lit(1)).alias("n"))


@query("c04_split_script", "SELECT n_nationkey, trim(unnest(['select 1', 'update t set a = ' || n_nationkey])) AS statement FROM nation")
def c04(spark, d):
    script = F.concat(F.lit("select 1; update t set a = "), F.col("n_nationkey").cast("string"), F.lit(";"))
    return Q.statements(table(spark, d, "nation").select("n_nationkey", script.alias("script")), "script").select("n_nationkey", "statement")


#: Statements of many shapes, one for each order; @ stands for a quote.
_MIXED = """CASE o_orderkey % 7 WHEN 0 THEN '  select a from t' || o_custkey % 5 || ' where b like @%x' || o_custkey || '@' WHEN 1 THEN 'update t set a = (select 1) where b = ' || o_custkey
 WHEN 2 THEN 'DELETE from t where b like @y%@' WHEN 3 THEN 'insert into t values (' || o_custkey || ')' WHEN 4 THEN 'select count(*) from pg_class order by random()'
 WHEN 5 THEN 'with s as (select count( distinct a) from t) select count(*) from s' ELSE 'vacuum t' || o_custkey % 5 END"""


def _mixed(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey AS id", f"replace({_MIXED}, '@', chr(39)) AS sql")


@query("c05_kinds", """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'S' WHEN 1 THEN 'U' WHEN 2 THEN 'D' WHEN 3 THEN 'I' WHEN 4 THEN 'S' ELSE 'O' END AS letter,
 CASE o_orderkey % 7 WHEN 2 THEN 'DELETE' WHEN 3 THEN 'INSERT' WHEN 6 THEN 'OTHER' ELSE 'SELECT' END AS kind, o_orderkey % 7 = 4 AS system FROM orders""")
def c05(spark, d):
    s = F.col("sql")
    return _mixed(spark, d).select("id", Q.kind_letter(s).alias("letter"), Q.kind_contained(s).alias("kind"), Q.touches_system_table(s).alias("system"))


@query("c08_djb_hash", "SELECT p_partkey, list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 33 + c) & 4294967295) AS hash FROM part")
def c08(spark, d):
    return table(spark, d, "part").select("p_partkey", Q.djb_hash(F.col("p_name")).alias("hash"))


@query("c07_dek_hash", "SELECT p_partkey, list_reduce(list_prepend(CAST(length(p_name) AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: xor(xor(h * 32, h >> 27), c) & 4294967295) AS hash FROM part")
def c07(spark, d):
    return table(spark, d, "part").select("p_partkey", Q.dek_hash(F.col("p_name")).alias("hash"))


@query("c10_durations", "SELECT p_partkey, CAST(p_size AS BIGINT) * 86400 + 7 * 3600 + (CAST(p_partkey AS BIGINT) % 60) * 60 AS seconds FROM part")
def c10(spark, d):
    text = F.concat(F.col("p_size").cast("string"), F.lit("d7h"), (F.col("p_partkey") % 60).cast("string"), F.lit("m"))
    return table(spark, d, "part").select("p_partkey", Q.duration_seconds(text).alias("seconds"))


@query("c11_step", "SELECT p_partkey, CASE WHEN p_partkey * 10 > 3600 THEN CAST(floor(p_partkey * 10 * 15 / 3600 * 1000) AS BIGINT) END AS step FROM part")
def c11(spark, d):
    return table(spark, d, "part").select("p_partkey", Q.step_ms(F.col("p_partkey") * 10, 15).alias("step"))


@query("c13_parameters", "SELECT p_partkey, 'select ' || p_name || ' where a = ' || p_size || ' and b = ' || p_name || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' and c = ' || p_brand END AS filled FROM part")
def c13(spark, d):
    text = F.when(F.col("p_size") % 2 == 0, "select $1 where a = $2 and b = $1; parameters: $1 = 'x'").otherwise("select $1 where a = $2 and b = $1 and c = $3")
    values = F.array("p_name", F.col("p_size").cast("string"), "p_brand")
    return table(spark, d, "part").select("p_partkey", Q.fill_parameters(Q.strip_parameters(text), values).alias("filled"))


@query("c14_patterns", """SELECT o_orderkey AS id, o_orderkey % 7 = 0 AS leading_wildcard, o_orderkey % 7 = 2 AS trailing_wildcard, o_orderkey % 7 = 4 AS random_order, o_orderkey % 7 = 5 AS count_distinct, o_orderkey % 7 IN (4, 5) AS count_all FROM orders""")
def c14(spark, d):
    return _mixed(spark, d).select("id", *(c.alias(n) for n, c in Q.patterns(F.col("sql")).items()))


@query("c18_index_parts", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN lower(p_brand) WHEN 1 THEN lower(p_brand) || ',b' || p_size ELSE 'a,' || lower(p_brand) || ',c' END AS columns, p_partkey % 3 = 0 AS is_unique,
 CASE p_partkey % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'global' ELSE '' END AS scope FROM part""")
def c18(spark, d):
    columns = "CASE p_size % 3 WHEN 0 THEN lower(p_brand) WHEN 1 THEN lower(p_brand) || ', b' || p_size ELSE 'a ,' || lower(p_brand) || ',  c' END"
    text = f"'CREATE ' || if(p_partkey % 3 = 0, 'UNIQUE ', '') || 'INDEX i' || p_partkey || ' ON t USING btree (' || {columns} || ')' || CASE p_partkey % 4 WHEN 0 THEN ' LOCAL' WHEN 1 THEN ' GLOBAL' ELSE '' END"
    p = Q.index_parts(F.col("definition"))
    return table(spark, d, "part").selectExpr("p_partkey", f"{text} AS definition").select("p_partkey", F.array_join(p["columns"], ",").alias("columns"), p["is_unique"].alias("is_unique"), p["scope"].alias("scope"))


@query("c22_list_overlap", "WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lower(p_type), ' ') AS b FROM part) SELECT p_partkey, round(len(list_distinct(list_intersect(a, b))) / greatest(len(a), len(b)), 6) AS overlap FROM w")
def c22_overlap(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(Q.list_overlap(F.split("p_name", " "), F.split(F.lower("p_type"), " ")), 6).alias("overlap"))


@query("c22_similarity", "SELECT p_partkey, round(1.0 / nullif(levenshtein(p_name, p_type), 0), 6) AS inverse FROM part")
def c22(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(Q.inverse_levenshtein(F.col("p_name"), F.col("p_type")), 6).alias("inverse"))


@query("c22_char_cosine", """WITH a AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS c FROM part), b AS (SELECT p_partkey, unnest(string_split(p_type, '')) AS c FROM part),
 x AS (SELECT p_partkey, c, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT p_partkey, c, count(*) AS m FROM b GROUP BY ALL), j AS (SELECT p_partkey, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM x FULL JOIN y USING (p_partkey, c))
 SELECT p_partkey, round(sum(n * m) / (sqrt(sum(n * n)) * sqrt(sum(m * m))), 6) AS cosine FROM j GROUP BY p_partkey""")
def c22_cosine(spark, d):
    return _round(Q.char_cosine(table(spark, d, "part"), "p_name", "p_type", "p_partkey"), "cosine")


#: A chain of p_size % 4 sorts over a join of two scans, for each part; the costs depend on its size and price. Sorts of every third part wait for
#: all their rows, the others and the joins begin before what is below them ends, or after it.
_INDENT = "repeat(' ', 6 * (p_size % 4) - 4)"
_PLAN = f"""array_join(concat(
 transform(sequence(0, p_size % 4), k -> CASE WHEN k = 0 THEN '' ELSE repeat(' ', 6 * k - 4) || '->  ' END || CASE WHEN k < p_size % 4 THEN 'Sort' WHEN p_size % 2 = 0 THEN 'Nested Loop' ELSE 'Hash Join' END
  || '  (cost=' || CASE WHEN k = p_size % 4 THEN p_partkey % 700 || '.25' WHEN p_partkey % 3 = 0 THEN (3900 - 100 * k) || '.50' ELSE '0.00' END || '..' || (4000 - 100 * k) || '.50 rows=' || (1000 + k) || ' width=8)'),
 array(repeat(' ', 6 * (p_size % 4) + 2) || '->  Seq Scan on a' || p_size || '  (cost=0.00..' || p_size * 20 || '.25 rows=' || p_size * 1500 || ' width=8)',
       repeat(' ', 6 * (p_size % 4) + 2) || '->  Index Scan using i on b  (cost=' || p_partkey % 7 || '.00..' || p_partkey % 900 || '.75 rows=' || p_partkey % 97 * 1000 || ' width=8)')), char(10))"""
_NODES = """p AS (SELECT p_partkey, p_size AS s, p_partkey AS k, p_size % 4 AS m, greatest(p_size * 20 + 0.25, p_partkey % 900 + 0.75) AS most FROM part),
 n AS (SELECT p_partkey, s, k, m, i AS node, CASE WHEN i < m THEN 'Sort' WHEN i = m AND s % 2 = 0 THEN 'Nested Loop' WHEN i = m THEN 'Hash Join' WHEN i = m + 1 THEN 'Seq Scan on a' || s ELSE 'Index Scan using i on b' END AS name,
  CASE WHEN i = 0 THEN NULL WHEN i <= m THEN i - 1 ELSE m END AS parent,
  CASE WHEN i < m AND k % 3 = 0 THEN 100.0 WHEN i < m - 1 THEN 4000.5 - 100 * i WHEN i < m THEN 4000.5 - 100 * i - (k % 700 + 0.25)
   WHEN i = m AND k % 700 + 0.25 >= most THEN 4000.5 - 100 * m - most WHEN i = m THEN 4000.5 - 100 * m - k % 7 WHEN i = m + 1 THEN s * 20 + 0.25 ELSE k % 900 + 0.75 END AS own_cost
  FROM p, range(0, 6) r(i) WHERE i <= m + 2)"""


def _plan_tree(spark, d):
    p = table(spark, d, "part").withColumn("plan", F.expr(_PLAN))
    return Q.own_cost(Q.plan_tree(Q.plan_nodes(p, "p_partkey", "plan"), "p_partkey"), "p_partkey")


@query("c19_plan_nodes", f"WITH {_NODES} SELECT p_partkey, CAST(node AS INT) AS node, CAST(parent AS INT) AS parent, name, round(CAST(own_cost AS DOUBLE), 4) AS own_cost FROM n")
def c19(spark, d):
    nodes = _plan_tree(spark, d)
    return nodes.select("p_partkey", F.col("node").cast("int").alias("node"), F.col("parent").cast("int").alias("parent"), "name", F.round("own_cost", 4).alias("own_cost"))


@query("c20_scans", f"WITH {_NODES} SELECT p_partkey, count(*) AS scans, round(CAST(sum(own_cost) AS DOUBLE), 4) AS cost, max(name) AS last FROM n WHERE contains(name, 'Scan') GROUP BY p_partkey")
def c20(spark, d):
    scans = _plan_tree(spark, d).where(F.col("name").contains("Scan"))
    return scans.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("scans"), F.round(F.sum("total_cost"), 4).alias("cost"), F.max("name").alias("last"))


@query("o07_sorted_operators", f"WITH {_NODES} SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY contains(name, 'Sort') DESC, own_cost DESC, node) AS INT) AS place, name FROM n")
def o07(spark, d):
    return Q.sorted_operators(_plan_tree(spark, d), "p_partkey").select("p_partkey", "place", "name")


@query("q26_plan_complexity", f"WITH {_NODES} SELECT p_partkey, CAST(1 AS BIGINT) AS joins, CAST(any_value(m) + 2 AS BIGINT) AS height FROM n GROUP BY p_partkey")
def q26(spark, d):
    p = table(spark, d, "part").withColumn("plan", F.expr(_PLAN))
    return Q.plan_complexity(Q.plan_nodes(p, "p_partkey", "plan"), "p_partkey")


@query("q23_poor_joins", f"""WITH {_NODES}, j AS (SELECT p_partkey, node, name, s * 1500 AS a, k % 97 * 1000 AS b, own_cost >= 0.02 * 4000.5 AS costly FROM n WHERE node = m)
 SELECT p_partkey, node, CASE WHEN name = 'Nested Loop' AND least(a, b) >= 10000 THEN 'nested loop over large inputs' WHEN greatest(a, b) >= 50000 THEN 'large join' ELSE 'costly join' END AS reason FROM j WHERE costly""")
def q23(spark, d):
    return Q.poor_joins(_plan_tree(spark, d), "p_partkey")


@query("g01_duration_model", f"""WITH {SLOW}, r AS (SELECT template, id, duration, row_number() OVER (PARTITION BY template ORDER BY id DESC) AS k FROM slow), l AS (SELECT template, avg(duration) AS mean, list(duration ORDER BY id) AS d FROM r WHERE k <= 5 GROUP BY template)
 SELECT template, round(mean, 4) AS mean, round(list_reduce(d, lambda a, x: (a + x) / 2), 4) AS expected FROM l""")
def g01(spark, d):
    return _round(Q.duration_model(slow(spark, d), "template", "id", "duration", 5), "mean", "expected", digits=4)


@query("g04_illegal", "SELECT o_orderkey AS id, o_orderkey % 7 = 6 AS illegal FROM orders")
def g04(spark, d):
    return _mixed(spark, d).select("id", Q.illegal(F.col("sql")).alias("illegal"))


# --- causes, advice, configuration ---------------------------------------------------------------

_BITS = ("l_quantity > 25", "l_discount > 0.05", "l_tax > 0.04", "l_linenumber > 3")
_LIBRARY = ((1, (1, 1, 0, 0), (0.5, 0.5, 0.0, 0.0)), (2, (0, 0, 1, 1), (0.0, 0.0, 0.7, 0.3)), (3, (1, 0, 1, 0), (0.25, 0.0, 0.75, 0.0)))


@query("q32_nearest_causes", f"""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, {", ".join(f"CAST({b} AS INT) AS b{i}" for i, b in enumerate(_BITS))} FROM lineitem),
 s AS ({" UNION ALL ".join(f"SELECT id, {k} AS label, {' + '.join(f'b{i} * {p * w}' for i, (p, w) in enumerate(zip(pat, wt)))} AS s FROM x" for k, pat, wt in _LIBRARY)})
, m AS (SELECT id, label, max(s) AS s FROM s WHERE s > 0 GROUP BY ALL) SELECT id, label, round(s / sum(s) OVER (PARTITION BY id), 6) AS probability FROM m""")
def q32(spark, d):
    items = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array(*(F.expr(b).cast("int") for b in _BITS)).alias("features"))
    library = spark.createDataFrame([(k, list(p), list(w)) for k, p, w in _LIBRARY], "label int, pattern array<int>, weight array<double>")
    return _round(A.nearest_causes(items, "id", library), "probability")


@query("q37_killer", f"WITH {SLOW} SELECT id, duration FROM slow WHERE duration >= 300000")
def q37(spark, d):
    return slow(spark, d).where("duration >= 300000").select("id", "duration")


@query("i01_workload", f"WITH {SLOW} SELECT template, count(*) / least(count(*), 5) AS freq FROM slow GROUP BY template")
def i01(spark, d):
    return slow(spark, d).groupBy("template").agg((F.count(F.lit(1)) / F.least(F.count(F.lit(1)), F.lit(5))).alias("freq"))


_TYPED = "SELECT p_brand AS table_name, CASE p_size % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'a,b' WHEN 2 THEN 'a,b,c' WHEN 3 THEN 'a,c' ELSE 'b' END AS columns, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'global' ELSE 'local' END AS index_type, CAST(max(p_size) AS DOUBLE) AS benefit FROM part GROUP BY 1, 2, 3"


@query("i03_distinct_types", f"""WITH RECURSIVE x AS ({_TYPED}), o AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY columns, index_type, benefit) AS k FROM x),
 w AS (SELECT table_name, k, columns, index_type, benefit, NULL::BIGINT AS gone FROM o WHERE k = 1
  UNION ALL SELECT o.table_name, o.k, CASE WHEN m.meets AND m.stays THEN w.columns ELSE o.columns END, CASE WHEN m.meets AND m.stays THEN w.index_type ELSE o.index_type END, CASE WHEN m.meets AND m.stays THEN w.benefit ELSE o.benefit END, NULL
  FROM w JOIN o ON o.table_name = w.table_name AND o.k = w.k + 1, LATERAL (SELECT starts_with(o.columns || ',', w.columns || ',') AS meets, CASE WHEN w.benefit = o.benefit THEN w.index_type = 'global' ELSE w.benefit > o.benefit END AS stays) m),
 n AS (SELECT w.*, lead(columns) OVER (PARTITION BY table_name ORDER BY k) AS nc, lead(index_type) OVER (PARTITION BY table_name ORDER BY k) AS nt, (SELECT o.columns FROM o WHERE o.table_name = w.table_name AND o.k = w.k + 1) AS oc FROM w)
 SELECT table_name, columns, index_type, benefit FROM n WHERE nc IS NULL OR NOT starts_with(oc || ',', columns || ',')""")
def i03_types(spark, d):
    """Candidates of three types of which one covers another, the better or else the global one staying."""
    return A.distinct_types(spark.sql(_TYPED.replace("FROM part", "FROM {p}"), p=table(spark, d, "part")))


@query("i03_redundant", "WITH x AS (SELECT p_brand AS table_name, string_agg(DISTINCT substr(p_type, 1, 1), ',' ORDER BY substr(p_type, 1, 1)) AS columns FROM part GROUP BY p_brand UNION SELECT p_brand, 'E' FROM part UNION SELECT p_brand, 'E,L' FROM part), l AS (SELECT *, lead(columns) OVER (PARTITION BY table_name ORDER BY columns) AS covered_by FROM x) SELECT * FROM l WHERE starts_with(covered_by, columns || ',')")
def i03(spark, d):
    p = table(spark, d, "part")
    listed = p.groupBy(F.col("p_brand").alias("table_name")).agg(F.array_join(F.array_sort(F.collect_set(F.substring("p_type", 1, 1))), ",").alias("columns"))
    more = [p.select(F.col("p_brand").alias("table_name"), F.lit(c).alias("columns")) for c in ("E", "E,L")]
    return A.redundant_indexes(listed.unionByName(more[0]).unionByName(more[1]).distinct())


_COST = "cost AS (SELECT l_orderkey AS query_id, l_linenumber - 1 AS config_id, l_extendedprice AS cost, CAST(l_orderkey % 3 + 1 AS BIGINT) AS freq FROM lineitem)"


def _cost(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") - 1).alias("config_id"), F.col("l_extendedprice").alias("cost"), (F.col("l_orderkey") % 3 + 1).alias("freq"))


@query("i06_set_cost", f"WITH {_COST}, m AS (SELECT * FROM (VALUES (1, 1), (1, 2), (2, 3), (2, 4)) t(set_id, config_id)), p AS (SELECT query_id, freq, cost AS plain FROM cost WHERE config_id = 0), b AS (SELECT set_id, query_id, min(cost) AS best FROM cost JOIN m USING (config_id) GROUP BY ALL) SELECT set_id, round((SELECT sum(plain * freq) FROM p) - sum(greatest(plain - best, 0) * freq), 2) AS cost FROM b JOIN p USING (query_id) GROUP BY set_id")
def i06(spark, d):
    members = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4)], "set_id int, config_id int")
    return _round(A.infer_benefit(_cost(spark, d), members), "cost", digits=2)


def _rounds(n: int) -> str:
    """What each of n rounds adds to those before it, a round after the other."""
    parts, taken = ["n0 AS (SELECT query_id, cost AS now FROM cost WHERE config_id = 0)"], "0"
    for k in range(1, n + 1):
        parts.append(f"g{k} AS (SELECT c.config_id, sum(greatest(n.now - c.cost, 0) * c.freq) AS gain FROM cost c JOIN n{k - 1} n ON n.query_id = c.query_id WHERE c.config_id NOT IN ({taken}) GROUP BY 1)")
        parts.append(f"b{k} AS (SELECT config_id FROM g{k} WHERE gain > 0 ORDER BY gain DESC, config_id LIMIT 1)")
        parts.append(f"n{k} AS (SELECT n.query_id, least(n.now, coalesce(c.cost, n.now)) AS now FROM n{k - 1} n LEFT JOIN (SELECT query_id, cost FROM cost WHERE config_id = (SELECT config_id FROM b{k})) c ON c.query_id = n.query_id)")
        taken += f", coalesce((SELECT config_id FROM b{k}), 0)"
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT {k - 1} AS place, config_id FROM b{k}" for k in range(1, n + 1))


@query("i07_greedy", f"WITH {_COST}, {_rounds(3)}")
def i07(spark, d):
    chosen = A.greedy(_cost(spark, d), 3)
    return spark.createDataFrame(list(enumerate(chosen)), "place int, config_id int")


@query("i11_report", f"WITH {_COST}, p AS (SELECT query_id, cost AS plain FROM cost WHERE config_id = 0) SELECT config_id, CAST(coalesce(sum(freq) FILTER (cost < plain), 0) AS BIGINT) AS improved, CAST(coalesce(sum(freq) FILTER (cost > plain), 0) AS BIGINT) AS worsened, CAST(sum(freq) AS BIGINT) AS total, round(1 - sum(cost * freq) / sum(plain * freq), 6) AS improvement FROM cost JOIN p USING (query_id) WHERE config_id <> 0 GROUP BY config_id")
def i11(spark, d):
    return _round(A.index_report(_cost(spark, d)), "improvement")


def _instances(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    on = lambda c: F.when(c, "on").otherwise("off")
    return s.select(
        k.alias("instance"), (k % 64 * 1048576 + 4194304).alias("os_mem_total"), F.lit(1).alias("instances"), F.lit(8).alias("block_size"), (k * 100000).alias("database_size"),
        (k % 5 * 8192).alias("temp_file_size"), (k % 7 * 100 + 100).alias("max_connections"), (k % 300).alias("current_connections"), (k % 6).cast("double").alias("load1"), (k % 32 + 1).alias("cores"),
        F.lit(65536).alias("work_mem"), (k % 10 != 0).alias("is_64bit"), (k % 2 == 0).alias("is_hdd"), (k % 4).alias("io_concurrency"), (k % 5000).alias("wal_buffers"), (k % 2 * 100).alias("prepared"),
        on(k % 2 == 0).alias("nestloop"), on(k % 3 == 0).alias("mergejoin"), on(k % 5 != 0).alias("hashjoin"), (k % 100 / 100.0).alias("fetch_return"), (k % 8 / 100.0).alias("rollback_commit"),
        (k * 13.0).alias("search_modify"), (k * 7.0).alias("read_write"), (k % 20 / 20.0).alias("cache_hit"), (k % 10 / 10.0).alias("checkpoint_proactive"),
    )


_AP = """i AS (SELECT s_suppkey AS k, s_suppkey % 100 / 100.0 AS fr, s_suppkey % 8 / 100.0 AS rc, s_suppkey * 13.0 AS sm, s_suppkey * 7.0 AS rw, s_suppkey % 20 / 20.0 AS ch, s_suppkey % 10 / 10.0 AS cp, s_suppkey % 5 * 8192 AS tf, s_suppkey % 64 * 1048576 + 4194304 AS mem, s_suppkey % 2 = 0 AS hdd, s_suppkey * 100000 AS dbs, s_suppkey % 10 <> 0 AS b64 FROM supplier),
 a AS (SELECT *, CASE WHEN fr <= .01 THEN 2 WHEN fr <= .1 THEN 1 WHEN fr <= .5 THEN .5 ELSE 0 END + CASE WHEN rc <= .01 THEN 2.5 WHEN rc <= .02 THEN 2 WHEN rc <= .03 THEN 1.5 WHEN rc <= .04 THEN 1 WHEN rc <= .05 THEN .5 ELSE 0 END
 + CASE WHEN sm >= 1e5 THEN 2 WHEN sm >= 1e4 THEN 1.5 WHEN sm >= 1e3 THEN 1 ELSE sm / 100 END + CASE WHEN rw >= 1e5 THEN 1.5 WHEN rw >= 1e4 THEN 1 WHEN rw >= 1e2 THEN .5 ELSE 0 END
 + CASE WHEN tf > 0 THEN 1 ELSE 0 END + CASE WHEN ch < .9 THEN .5 ELSE 0 END + CASE WHEN cp <= .1 THEN .5 WHEN cp <= .3 THEN .2 ELSE 0 END AS ap FROM i)"""


@query("n03_ap_index", f"WITH {_AP} SELECT k AS instance, round(CAST(ap AS DOUBLE), 4) AS ap_index, CASE WHEN ap > 6 THEN 'ap' WHEN ap <= 3 THEN 'tp' ELSE 'htap' END AS workload FROM a")
def n03(spark, d):
    return _round(N.ap_index(_instances(spark, d)).select("instance", "ap_index", "workload"), "ap_index", digits=4)


@query("n04_memory_knobs", f"WITH {_AP}, m AS (SELECT *, round(mem * 0.8, 4) AS mpm FROM a), b AS (SELECT *, round(CASE WHEN mpm < 1048576 THEN .15 WHEN mpm > 8388608 THEN .4 ELSE .25 END * mpm / 8, 4) AS w FROM m) SELECT k AS instance, CAST(mpm AS DOUBLE) AS max_process_memory, round(CAST(CASE WHEN b64 THEN least(dbs / 8, w) ELSE w END AS DOUBLE), 2) AS shared_buffers, CASE WHEN hdd THEN 3 ELSE 1 END AS random_page_cost FROM b")
def n04(spark, d):
    k = N.recommend(_instances(spark, d))
    return k.select("instance", F.col("max_process_memory").cast("double").alias("max_process_memory"), F.round(F.col("shared_buffers").cast("double"), 2).alias("shared_buffers"), "random_page_cost")


@query("n02_busiest", f"WITH {SLOW}, c AS (SELECT instance, db, count(*) AS n FROM slow GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY n DESC, db) AS k FROM c) SELECT instance, db, n FROM r WHERE k = 1")
def n02(spark, d):
    return R.top_in_group(slow(spark, d).groupBy("instance", "db").agg(F.count(F.lit(1)).alias("n")), ["instance"], [F.col("n").desc(), F.col("db")], 1)


