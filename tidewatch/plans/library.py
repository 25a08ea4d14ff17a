"""Queries of stores, reports, detectors by name, index advice, configuration and memory checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import advisor as A
from tidewatch.operators import detectors as D
from tidewatch.operators import knobs as N
from tidewatch.operators import memory as M
from tidewatch.operators import predicates as P
from tidewatch.operators import results as R
from tidewatch.operators import statistics as K
from tidewatch.plans import diagnosis
from tidewatch.plans.analysis import _AP, _instances
from tidewatch.plans.language import families
from tidewatch.plans.metrics import DAY, EV, HR, SAMP, START
from tidewatch.plans.registry import query
from tidewatch.plans.results import SLOW, slow
from tidewatch.sources import series as S
from tidewatch.sources import store
from tidewatch.sources.series import hourly, table

KEY = ["name"]
HOUR = 3_600_000


def _n(name="n"):
    return F.count(F.lit(1)).alias(name)


def _round(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- stores --------------------------------------------------------------------------------------


@query("s22_csv_workload", "SELECT 'select a, b from t where c = \"' || o_orderkey || '\"' || chr(10) || ' and d = 1' AS sql, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_custkey AS DOUBLE) END AS duration FROM orders")
def s22(spark, d):
    """Statements with quotes, commas and line breaks, written as CSV and loaded again."""
    text = F.concat(F.lit('select a, b from t where c = "'), F.col("o_orderkey").cast("string"), F.lit('"\n and d = 1'))
    folder = store.scratch(spark)
    table(spark, d, "orders").select(text.alias("sql"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey").cast("double")).alias("duration")).write.csv(folder, escape='"')
    return store.load_workload(spark, folder)


@query("s23_sinks", f"WITH {SLOW}, s AS (SELECT db, kind, min(id) AS first_id FROM slow GROUP BY ALL) SELECT j.instance, s.db, s.kind, count(*) AS executions, count(DISTINCT s.first_id) AS statements FROM slow j JOIN s ON s.db = j.db AND s.kind = j.kind GROUP BY ALL")
def s23(spark, d):
    """Statements and their journal recorded twice: the second write adds nothing."""
    folder = store.scratch(spark)
    rows = slow(spark, d).withColumns({"hash1": F.xxhash64("db", "kind"), "hash2": F.crc32(F.concat_ws("/", "db", "kind"))})
    for _ in range(2):
        store.record(rows.groupBy("hash1", "hash2", "db", "kind").agg(F.min("id").alias("statement_id")), folder, "slow_queries")
        known = store.read(spark, folder, "slow_queries")
        journal = rows.join(known.select("hash1", "hash2", "statement_id"), ["hash1", "hash2"]).select("statement_id", F.col("id").alias("start_at"), "instance", "duration")
        store.record(journal, folder, "slow_queries_journal")
    both = store.read(spark, folder, "slow_queries_journal").join(store.read(spark, folder, "slow_queries"), "statement_id")
    return both.groupBy("instance", "db", "kind").agg(_n("executions"), F.count_distinct("statement_id").alias("statements"))


@query("t09_series_cache", f"WITH {HR} SELECT name, ts_ms, value FROM hr WHERE ts_ms BETWEEN {START + 2 * DAY} AND {START + 20 * DAY}")
def t09(spark, d):
    """Three reads of growing ranges: the last is served from the cache but for its gaps."""
    source = hourly(spark, d).drop("n")
    cache = store.SeriesCache(spark, store.scratch(spark), KEY, HOUR, lambda gaps: source.join(gaps, "name").where("ts_ms between start_ms and end_ms"))
    some = source.where("name < 'p'").select("name").distinct()
    cache.get(some, START + 5 * DAY, START + 8 * DAY, now=1)
    cache.get(some, START + 12 * DAY, START + 14 * DAY, now=2)
    return cache.get(source.select("name"), START + 2 * DAY, START + 20 * DAY, now=3)


@query("s17_families", f"WITH {SAMP} SELECT DISTINCT name || '_' || unit AS metric FROM samp, (VALUES ('1m'), ('10m'), ('60m'), ('24h')) t(unit)")
def s17(spark, d):
    """What is derived from each metric for each unit of time, of all metrics."""
    return families(S.event_samples(spark, d)).select("metric").distinct()


@query("s02_stored_samples", f"WITH {SAMP} SELECT name, instance, count(*) AS n, round(sum(value), 4) AS total, (SELECT count(DISTINCT name) FROM samp) AS metrics FROM samp WHERE name = 'click' AND instance = '3' AND ts_ms BETWEEN {START + 5 * DAY} AND {START + 20 * DAY} AND value >= 20 AND value < 80 GROUP BY name, instance")
def s02_stored(spark, d):
    """A range of one metric and instance from stored samples, where the scan compares all of it, and how many metrics there are, by the folders' names."""
    folder = store.scratch(spark)
    store.write_samples(S.event_samples(spark, d), folder)
    chosen = S.Selector.stored(spark, folder).metric("click").from_server("3").between(START + 5 * DAY, START + 20 * DAY).values(20.0, 80.0).fetchall()
    return chosen.groupBy("name", F.col("label_from_instance").alias("instance")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).withColumn("metrics", F.lit(len(store.metric_names(spark, folder))))


@query("q35_slow_queries", f"WITH {SLOW} SELECT id, db AS datname, kind AS query, start_ms, start_ms + CAST(floor(duration) AS BIGINT) AS finish_ms, round(duration / 7, 3) AS hit_rate, CAST(id % 9 AS BIGINT) AS n_returned_rows FROM slow")
def q35(spark, d):
    """Q35: slow queries read from the labels of samples, where every figure is text."""
    labels = F.create_map(
        F.lit("unique_query_id"), F.col("id").cast("string"), F.lit("datname"), "db", F.lit("query"), "kind", F.lit("start_time"), F.col("start_ms").cast("string"),
        F.lit("finish_time"), (F.col("start_ms") + F.col("duration").cast("long")).cast("string"), F.lit("hit_rate"), F.round(F.col("duration") / 7, 3).cast("string"), F.lit("n_returned_rows"), (F.col("id") % 9).cast("string"),
    )
    samples = slow(spark, d).select(F.lit("slow_sql").alias("name"), labels.alias("labels"))
    found = S.typed_labels(samples, {"unique_query_id": "long", "datname": "string", "query": "string", "start_time": "long", "finish_time": "long", "hit_rate": "double", "n_returned_rows": "long"})
    return found.withColumnsRenamed({"unique_query_id": "id", "start_time": "start_ms", "finish_time": "finish_ms"})


_CONTEXT = diagnosis._FEATURES.rpartition(",\n f AS")[0]


@query("q34_context", f"WITH {_CONTEXT} SELECT k AS id, CASE WHEN x < 20 THEN 1 ELSE 0 END AS known_tables, CASE WHEN x < 20 THEN x % 5 END AS most_indexes, round(click / 100, 6) AS db_cpu, round(error / 100, 6) AS io_utils, CAST(50 + c % 8 * 10 AS DOUBLE) AS max_connections, k % 5 = 0 AS recommended FROM b LEFT JOIN h USING (k)")
def q34(spark, d):
    found = diagnosis.context(spark, d)
    host = lambda n: F.round(F.col("host")[n], 6).alias(n)
    return found.select("id", F.coalesce("known_tables", F.lit(0)).alias("known_tables"), "most_indexes", host("db_cpu"), host("io_utils"), F.col("settings")["max_connections"].alias("max_connections"), "recommended")


# --- reports -------------------------------------------------------------------------------------

_SECTIONS = {"reads": ("click", "view"), "trade": ("purchase", "signup"), "faults": ("error", "view")}


@query("a25_inspection", f"""WITH {SAMP}, p AS (SELECT * FROM (VALUES ('reads', 'click'), ('reads', 'view'), ('trade', 'purchase'), ('trade', 'signup'), ('faults', 'error'), ('faults', 'view')) t(section, name))
 SELECT section, name, instance, arg_max(value, ts_ms) AS latest, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, count(value) AS n FROM samp JOIN p USING (name) WHERE ts_ms BETWEEN {START + 9 * DAY} AND {START + 10 * DAY} GROUP BY ALL""")
def a25(spark, d):
    samples = S.event_samples(spark, d).withColumn("instance", F.col("labels")["from_instance"])
    return _round(R.inspect(samples, START + 10 * DAY, 24 * 60, _SECTIONS), "avg")


@query("a29_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS near FROM lineitem GROUP BY 1")
def a29(spark, d):
    """Exact numbers beside whether the estimates lie within three times their error."""
    l = table(spark, d, "lineitem")
    exact = l.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"))
    near = R.distinct_estimates(l, ["l_returnflag"], ["l_partkey"], 0.02)
    return exact.join(near, "l_returnflag").select("l_returnflag", "parts", (F.abs(F.col("l_partkey") - F.col("parts")) <= 0.06 * F.col("parts")).alias("near"))


@query("a29_existing", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS present FROM customer")
def a29_exists(spark, d):
    asked = table(spark, d, "customer").select("c_custkey")
    rich = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return R.present_keys(rich, asked, "c_custkey")


@query("a31_grouping_sets", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(sum(l_quantity), 2) AS quantity, CAST(grouping_id(l_returnflag, l_linestatus, l_linenumber) AS BIGINT) AS level FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
def a31(spark, d):
    found = R.grouping_sets(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], [["l_returnflag", "l_linestatus"], ["l_linenumber"], []], _n(), F.sum("l_quantity").alias("quantity"))
    return _round(found, "quantity", digits=2)


@query("a31_rollup_and_cube", """SELECT 'rollup' AS kind, p_type, p_brand, CAST(NULL AS INT) AS p_size, count(*) AS n FROM part GROUP BY ROLLUP (p_type, p_brand) UNION ALL SELECT 'cube', p_type, NULL, CAST(p_size AS INT), count(*) FROM part GROUP BY CUBE (p_type, p_size)""")
def a31_more(spark, d):
    p = table(spark, d, "part")
    up = p.rollup("p_type", "p_brand").agg(_n()).select(F.lit("rollup").alias("kind"), "p_type", "p_brand", F.lit(None).cast("int").alias("p_size"), "n")
    return up.unionByName(p.cube("p_type", "p_size").agg(_n()).select(F.lit("cube").alias("kind"), "p_type", F.lit(None).cast("string").alias("p_brand"), F.col("p_size").cast("int").alias("p_size"), "n"))


@query("u07_power_set", "WITH m AS (SELECT l_suppkey, list_sort(list(DISTINCT l_returnflag)) AS s FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, s, unnest(range(0, CAST(pow(2, len(s)) AS BIGINT))) AS mask FROM m) SELECT l_suppkey, CAST(mask AS INT) AS mask, array_to_string([s[i + 1] FOR i IN range(0, len(s)) IF (mask >> i) % 2 = 1], ',') AS members FROM b")
def u07(spark, d):
    found = R.subsets(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", 4)
    return found.select("l_suppkey", "mask", F.array_join("members", ",").alias("members"))


_RANGES = "SELECT o_custkey AS rule, o_orderkey AS term, 'a' AS column, CASE o_orderkey % 4 WHEN 0 THEN '>=' WHEN 1 THEN '<' WHEN 2 THEN '=' ELSE '<>' END AS op, CAST(o_totalprice AS DOUBLE) AS value FROM orders"


@query("u09_predicate_algebra", f"""WITH t AS ({_RANGES}), g AS (SELECT rule, max(value) FILTER (op IN ('>=', '=')) AS low, min(value) FILTER (op IN ('<', '=')) AS high, min(value) FILTER (op = '<') AS below, count(DISTINCT value) FILTER (op = '=') AS fixed, min(value) FILTER (op = '=') AS v, max(value) FILTER (op = '>=') AS atleast, list(value) FILTER (op = '<>') AS gone FROM t GROUP BY rule)
 SELECT rule, 'a' AS column, CASE WHEN fixed > 1 OR (fixed = 1 AND (coalesce(v < atleast, false) OR coalesce(v >= below, false) OR coalesce(list_contains(gone, v), false))) OR (fixed = 0 AND coalesce(atleast >= below, false)) THEN false ELSE true END AS possible, low, high FROM g""")
def u09(spark, d):
    """The conjunction of all of a customer's conditions, as one interval, and whether any value meets it."""
    return P.conjunctions(table(spark, d, "orders").selectExpr(*(x for x in ("o_custkey AS rule", "'a' AS column", "CASE o_orderkey % 4 WHEN 0 THEN '>=' WHEN 1 THEN '<' WHEN 2 THEN '=' ELSE '<>' END AS op", "cast(o_totalprice as double) AS value")))).select("rule", "column", "possible", "low", "high")


@query("t13_widened_window", f"WITH {EV}, w AS (SELECT name, ts_ms, event_id FROM ev WHERE ts_ms BETWEEN {START + 10 * DAY - 2 * HOUR} AND {START + 10 * DAY} OR ts_ms BETWEEN {START + 10 * DAY - HOUR} AND {START + 10 * DAY + HOUR}) SELECT name, count(DISTINCT event_id) AS n FROM w GROUP BY name")
def t13(spark, d):
    """Two rounds an hour apart whose windows are twice the interval: what both fetch counts once."""
    e = table(spark, d, "events").select(F.col("event_type").alias("name"), S.epoch_ms("ts").alias("ts_ms"), "event_id")
    rounds = [S.fetch_window(e, START + 10 * DAY + k * HOUR, HOUR, 2.0) for k in range(2)]
    return rounds[0].unionByName(rounds[1]).dropDuplicates(["event_id"]).groupBy("name").agg(_n())


# --- detectors by name ---------------------------------------------------------------------------


@query("d13_registry")
def d13(spark, d):
    """All detectors of the registry over the same series; each has a query of its own with SQL or a test."""
    h = hourly(spark, d).drop("n")
    extra = {"threshold": {"high": 70.0}, "quantile": {"high": 0.95}, "seasonal": {"period": 24}}
    return D.overview({name: f(h, KEY, **extra.get(name, {})) for name, f in D.REGISTRY.items()}, KEY)


_POOL = {"high": ("click", "threshold", {"high": 60.0}, 20, "too high"), "low": ("view", "threshold", {"low": 20.0}, 30, "too low"), "off": ("error", "threshold", {"high": 1.0}, 0, "paused"), "outer": ("purchase", "iqr", {}, 40, "outlier")}


@query("d16_pool", f"""WITH {HR}, q AS (SELECT name, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM hr WHERE name = 'purchase' GROUP BY name),
 f AS (SELECT 'high' AS detector, name, ts_ms, 20 AS level, 'too high' AS content FROM hr WHERE name = 'click' AND value > 60 UNION ALL SELECT 'low', name, ts_ms, 30, 'too low' FROM hr WHERE name = 'view' AND value < 20
 UNION ALL SELECT 'outer', name, ts_ms, 40, 'outlier' FROM hr JOIN q USING (name) WHERE value > q3 + 3 * (q3 - q1) OR value < q1 - 3 * (q3 - q1))
 SELECT detector, name, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS n, CAST(level AS INT) AS level, content FROM f GROUP BY detector, name, level, content""")
def d16(spark, d):
    return D.run_pool(_POOL, hourly(spark, d).drop("n"), KEY)


@query("d15_predefined")
def d15(spark, d):
    """All predefined detections, on the metrics at hand."""
    rename = {"os_disk_usage": "click", "os_mem_usage": "view", "os_cpu_user_usage": "purchase", "qps": "signup"}
    h = hourly(spark, d).drop("n")
    return D.overview({name: D.run_predefined(name, h, KEY, rename=rename) for name in D.PREDEFINED}, KEY)


@query("t17_failing_series", f"WITH {HR} SELECT name, name = 'view' AS failed FROM hr GROUP BY name")
def t17(spark, d):
    """A rule that fails on one series leaves the others their flags."""

    def rule(values):
        if len(values) and values[0] < 0:
            raise ValueError("negative")
        return values > 50

    h = hourly(spark, d).drop("n").withColumn("value", F.when(F.col("name") == "view", -1 - F.col("value")).otherwise(F.col("value")))
    flagged = D._kernel(h, KEY, rule)
    bad = D.failed(flagged, KEY).withColumn("failed", F.lit(True))
    return h.select("name").distinct().join(bad, "name", "left").select("name", F.coalesce("failed", F.lit(False)).alias("failed"))


# --- forecasts -----------------------------------------------------------------------------------


@query("x09_metric_forecast", f"""WITH {HR}, f AS (SELECT name, regr_slope(value, CAST(ts_ms AS DOUBLE)) AS a, regr_intercept(value, CAST(ts_ms AS DOUBLE)) AS b, max(ts_ms) AS l, CAST((max(ts_ms) - min(ts_ms)) * 0.33 AS BIGINT) // 3600000 AS steps FROM hr GROUP BY name)
 SELECT name, l + k * 3600000 AS ts_ms, round(CASE WHEN name = 'click' THEN least(greatest(b + a * (l + k * 3600000), 49), 51) ELSE greatest(b + a * (l + k * 3600000), 0) END, 3) AS value FROM f, range(1, 1000) t(k) WHERE k <= steps""")
def x09(spark, d):
    """A third of the range ahead, within each metric's bounds; with lines, so that SQL can follow."""
    return _round(K.metric_forecast(hourly(spark, d), KEY, HOUR, {"click": (49.0, 51.0)}, method="line"), "value", digits=3)


@query("x10_early_warning", f"""WITH {HR}, h AS (SELECT name, ts_ms, n + (ts_ms - {START}) / 86400000 * CASE name WHEN 'click' THEN 1 WHEN 'view' THEN -1 WHEN 'error' THEN 3 ELSE 0 END AS value FROM hr),
 f AS (SELECT name, regr_slope(value, CAST(ts_ms AS DOUBLE)) AS a, regr_intercept(value, CAST(ts_ms AS DOUBLE)) AS b, max(ts_ms) AS l, arg_max(value, ts_ms) AS v FROM h GROUP BY name),
 s AS (SELECT name, l, v, k, b + a * (l + k * 3600000) AS y FROM f, range(1, 241) t(k)), c AS (SELECT name, min(k) AS k, arg_min(y, k) AS y FROM s WHERE y >= 40 OR y <= -30 GROUP BY name)
 SELECT f.name, CASE WHEN v >= 40 THEN 'upper' WHEN v <= -30 THEN 'lower' WHEN k IS NULL THEN 'normal' WHEN y >= 40 THEN 'future upper' ELSE 'future lower' END AS status, CASE WHEN v BETWEEN -30 AND 40 THEN CAST(k AS DOUBLE) END AS hours FROM f LEFT JOIN c USING (name)""")
def x10(spark, d):
    """The first crossing within ten days."""
    slope = F.when(F.col("name") == "click", 1).when(F.col("name") == "view", -1).when(F.col("name") == "error", 3).otherwise(0)
    h = hourly(spark, d).select("name", "ts_ms", (F.col("n") + (F.col("ts_ms") - START) / 86_400_000 * slope).alias("value"))
    return K.early_warning(h, K.linear_forecast(h, KEY, HOUR, 240), KEY, -30.0, 40.0)


# --- index advice --------------------------------------------------------------------------------

_QUERIES = """q AS (SELECT p_partkey AS query_id, 't' || p_partkey % 6 AS table_name, CAST(p_partkey % 3 + 1 AS BIGINT) AS freq, CAST(p_size AS DOUBLE) * 1000 AS rows, p_partkey % 4 = 0 AS writes FROM part),
 p AS (SELECT DISTINCT p_partkey AS query_id, 'c' || (p_partkey * (k + 3) + k) % 7 AS "column" FROM part, range(0, 3) r(k)), pr AS (SELECT query_id, "column", 0.1 + 0.1 * CAST(substr("column", 2) AS INT) AS share FROM p),
 m AS (SELECT query_id, map_from_entries(list((("column"), share))) AS shares FROM pr GROUP BY query_id), a AS (SELECT q.*, shares FROM q JOIN m USING (query_id))"""
_LEFT = "greatest(1, rows * abs(list_reduce(list_prepend(1.0, list_transform(cols, lambda c: coalesce(CAST(shares[c] AS DOUBLE), -1.0))), lambda s, x: CASE WHEN s < 0 THEN s WHEN x < 0 THEN -s ELSE s * x END)))"
_INDEXES = "i AS (SELECT n_nationkey + 1 AS config_id, 't' || n_nationkey % 6 AS table_name, CASE n_nationkey % 4 WHEN 0 THEN ['c' || n_nationkey % 7] WHEN 1 THEN ['c0', 'c' || 1 + n_nationkey % 5] WHEN 2 THEN ['c' || n_nationkey % 5, 'c6'] ELSE ['c1', 'c' || 2 + n_nationkey % 4, 'c0'] END AS cols FROM nation)"
_PRICED = f"""{_QUERIES}, {_INDEXES}, cost AS (SELECT query_id, 0 AS config_id, rows AS cost, freq FROM a UNION ALL SELECT query_id, config_id, {_LEFT} + CASE WHEN writes THEN rows * 0.1 ELSE 0 END, freq FROM a JOIN i USING (table_name))"""


def _workload(spark, d):
    p = table(spark, d, "part")
    queries = p.selectExpr("p_partkey AS query_id", "'t' || p_partkey % 6 AS table_name", "p_partkey % 3 + 1 AS freq", "cast(p_size as double) * 1000 AS rows", "p_partkey % 4 = 0 AS writes")
    named = p.select(F.col("p_partkey").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).selectExpr("query_id", "'c' || (query_id * (k + 3) + k) % 7 AS column").distinct()
    return queries, named.withColumn("share", F.lit(0.1) + F.lit(0.1) * F.substring("column", 2, 1).cast("int"))


def _indexes(spark, d):
    k = "n_nationkey"
    columns = f"CASE {k} % 4 WHEN 0 THEN array('c' || {k} % 7) WHEN 1 THEN array('c0', 'c' || (1 + {k} % 5)) WHEN 2 THEN array('c' || {k} % 5, 'c6') ELSE array('c1', 'c' || (2 + {k} % 4), 'c0') END"
    return table(spark, d, "nation").selectExpr(f"{k} + 1 AS config_id", f"'t' || {k} % 6 AS table_name", f"{columns} AS columns", f"cast({k} % 5 + 1 as double) AS storage", f"{k} % 3 = 0 AS unused", f"'i' || {k} AS index_name")


@query("i02_candidates", f"""WITH RECURSIVE {_QUERIES}, k AS (SELECT DISTINCT table_name, "column" AS c FROM q JOIN pr USING (query_id)), pl AS (SELECT table_name, sum(rows * freq) AS plain FROM a GROUP BY 1),
 g AS (SELECT table_name, cols, cost FROM (SELECT table_name, cols, sum({_LEFT} * freq) AS cost FROM (SELECT table_name, [c] AS cols FROM k) JOIN a USING (table_name) GROUP BY ALL) JOIN pl USING (table_name) WHERE cost < plain
  UNION ALL SELECT table_name, cols, cost FROM (SELECT w.table_name, w.cols, w.before, sum({_LEFT} * a.freq) AS cost FROM (SELECT g.table_name, list_append(g.cols, c) AS cols, g.cost AS before FROM g JOIN k ON k.table_name = g.table_name AND NOT list_contains(g.cols, c) WHERE len(g.cols) < 5) w JOIN a ON a.table_name = w.table_name GROUP BY ALL) WHERE cost <= before * 0.95)
 SELECT table_name, array_to_string(cols, ',') AS columns, round(cost, 4) AS cost, round(plain - cost, 4) AS gain FROM g JOIN pl USING (table_name)""")
def i02(spark, d):
    found = A.grown_candidates(*_workload(spark, d))
    return _round(found.withColumn("columns", F.array_join("columns", ",")), "cost", "gain", digits=4)


@query("i05_cost_table", f"WITH {_PRICED} SELECT query_id, CAST(config_id AS INT) AS config_id, round(cost, 6) AS cost, freq FROM cost")
def i05(spark, d):
    queries, predicates = _workload(spark, d)
    return _round(A.cost_table(queries, predicates, _indexes(spark, d)), "cost").withColumn("config_id", F.col("config_id").cast("int"))


@query("i08_best_set", f"""WITH RECURSIVE {_PRICED}, z AS (SELECT n_nationkey + 1 AS config_id, n_nationkey % 5 + 1 AS size FROM nation),
 s AS (SELECT CAST([] AS BIGINT[]) AS members, 0 AS used, 0 AS last UNION ALL SELECT list_append(members, config_id), used + size, config_id FROM s JOIN z ON config_id > last AND used + size <= 6),
 e AS (SELECT members, unnest(members) AS config_id FROM s), b AS (SELECT e.members, c.query_id, min(c.cost) AS best FROM e JOIN cost c ON c.config_id = e.config_id GROUP BY 1, 2),
 g AS (SELECT b.members, round(sum(greatest(o.cost - b.best, 0) * o.freq), 4) AS benefit FROM b JOIN cost o ON o.query_id = b.query_id AND o.config_id = 0 GROUP BY 1)
 SELECT array_to_string(members, ',') AS members, benefit FROM g ORDER BY benefit DESC, len(members), members LIMIT 1""")
def i08_best(spark, d):
    """The best set of indexes within a room of 6, of all that fit: several may help the same statement, which counts once."""
    queries, predicates = _workload(spark, d)
    indexes = _indexes(spark, d)
    cost = store.cut(A.cost_table(queries, predicates, indexes))
    size = {r["config_id"]: r["storage"] for r in indexes.select("config_id", "storage").collect()}
    chosen, benefit = A.search_sets(cost, size, 6.0)
    return spark.createDataFrame([(",".join(map(str, chosen)), round(benefit, 4))], "members string, benefit double")


_JUDGED = """x AS (SELECT c.config_id, c.freq, o.cost AS plain, o.cost - c.cost AS saved FROM cost c JOIN cost o ON o.query_id = c.query_id AND o.config_id = 0 WHERE c.config_id > 0),
 j AS (SELECT config_id, sum(saved * freq) AS gain, sum(saved) FILTER (saved > 0) AS benefit, sum(saved / plain * freq) FILTER (saved > 0) / sum(freq) FILTER (saved > 0) AS mean_rate, coalesce(sum(freq) FILTER (saved < 0), 0) / sum(freq) AS negative_share FROM x GROUP BY 1),
 good AS (SELECT * FROM j WHERE benefit > 0 AND gain > 0 AND mean_rate >= 0.4 AND NOT (mean_rate < 0.45 AND negative_share > 0.45))"""


@query("i09_post_filter", f"WITH {_PRICED}, {_JUDGED}, r AS (SELECT *, row_number() OVER (ORDER BY gain DESC, config_id) AS k FROM good) SELECT CAST(config_id AS INT) AS config_id, round(gain, 4) AS gain, round(mean_rate, 6) AS mean_rate, round(negative_share, 6) AS negative_share FROM r WHERE k <= 6")
def i09(spark, d):
    queries, predicates = _workload(spark, d)
    indexes = _indexes(spark, d)
    found = A.post_filter(A.cost_table(queries, predicates, indexes), indexes, improved=0.4, negative=0.45, count=6)
    return _round(_round(found, "gain", digits=4), "mean_rate", "negative_share").select(F.col("config_id").cast("int").alias("config_id"), "gain", "mean_rate", "negative_share")


@query("i09_same_columns", f"""WITH {_PRICED}, pairs AS (SELECT s.config_id AS s, l.config_id AS l FROM i s JOIN i l ON s.table_name = l.table_name AND s.config_id <> l.config_id AND list_has_all(l.cols, s.cols) AND (len(s.cols) < len(l.cols) OR (len(s.cols) = len(l.cols) AND s.config_id < l.config_id))),
 o AS (SELECT query_id, cost AS plain FROM cost WHERE config_id = 0), g AS (SELECT s, l, sum(greatest(plain - best, 0) * freq) AS pair FROM (SELECT s, l, query_id, min(cost) AS best, any_value(freq) AS freq FROM pairs JOIN cost ON config_id IN (s, l) GROUP BY ALL) JOIN o USING (query_id) GROUP BY ALL),
 e AS (SELECT config_id, sum(greatest(plain - cost, 0) * freq) AS gain FROM cost JOIN o USING (query_id) WHERE config_id > 0 GROUP BY 1)
 SELECT DISTINCT CAST(CASE WHEN a.gain / pair > 0.8 THEN l WHEN b.gain / pair > 0.8 THEN s END AS INT) AS config_id FROM g JOIN e a ON a.config_id = s JOIN e b ON b.config_id = l WHERE pair > 0 AND (a.gain / pair > 0.8 OR b.gain / pair > 0.8)""")
def i09_same(spark, d):
    queries, predicates = _workload(spark, d)
    indexes = _indexes(spark, d)
    return A.same_columns(A.cost_table(queries, predicates, indexes), indexes).select(F.col("config_id").cast("int").alias("config_id"))


@query("i10_redundant_existing", f"""WITH {_INDEXES}, e AS (SELECT *, (config_id - 1) % 3 = 0 AS unused, 'i' || config_id - 1 AS index_name FROM i)
 SELECT DISTINCT s.index_name FROM e s JOIN e l ON s.table_name = l.table_name AND list_slice(l.cols, 1, len(s.cols)) = s.cols AND (len(s.cols) < len(l.cols) OR (len(s.cols) = len(l.cols) AND s.index_name < l.index_name)) WHERE NOT l.unused OR s.unused""")
def i10(spark, d):
    return A.redundant_existing(_indexes(spark, d))


@query("i12_advice")
def i12(spark, d):
    """The whole of the advice, which a periodic task runs on each interval's workload; parts have SQL, and greedy choice a test."""
    queries, predicates = _workload(spark, d)
    return A.advise(queries, predicates, F.size("columns").cast("double"), most=3, choose=4, room=8.0).withColumn("columns", F.array_join("columns", ","))


# --- configuration and memory --------------------------------------------------------------------

_MORE = """z AS (SELECT *, CASE WHEN ap > 6 THEN 'ap' WHEN ap <= 3 THEN 'tp' ELSE 'htap' END AS w, round(mem * 0.8, 4) AS mpm, k % 7 * 100 + 100 AS mc, k % 300 AS cc, CAST(k % 6 AS DOUBLE) AS load1, k % 32 + 1 AS cores FROM a),
 y AS (SELECT *, round(CASE WHEN mpm < 1048576 THEN .15 WHEN mpm > 8388608 THEN .4 ELSE .25 END * mpm / 8, 4) AS wanted FROM z), x AS (SELECT *, CASE WHEN b64 THEN round(least(dbs / 8, wanted), 4) ELSE wanted END AS sb, mc * CASE WHEN cc / mc <= 0.7 OR load1 > 3 THEN 1 WHEN load1 > 1 THEN 2 ELSE 3 END AS grown FROM y),
 v AS (SELECT *, CAST(CASE WHEN w = 'tp' THEN greatest(greatest(200, cores * 5), least(greatest(400, cores * 12), grown)) ELSE greatest((mpm * CASE WHEN mpm > 16777216 THEN .85 WHEN mpm > 8388608 THEN .75 WHEN mpm < 4194304 THEN .6 ELSE .7 END - sb) / (greatest(65536, tf * 4) + 0.01), greatest(200, cores * 3)) END AS DOUBLE) AS conn FROM x),
 u AS (SELECT *, CASE WHEN tf < 16384 OR (w = 'tp' AND conn > 500) THEN NULL WHEN w = 'tp' THEN (mpm - sb) / (conn * 2) ELSE (mpm - sb) / conn END AS wm FROM v)"""


@query("n04_all_knobs", f"""WITH {_AP}, {_MORE} SELECT k AS instance, round(conn, 2) AS connections, round(CAST(wm AS DOUBLE), 2) AS work_memory, round(CAST(wm AS DOUBLE) * 10, 2) AS maintenance_work_mem, round(CAST(CASE WHEN w = 'tp' THEN sb ELSE greatest(mpm * 0.75, sb) END AS DOUBLE), 2) AS effective_cache_size,
 CAST(CASE WHEN NOT hdd THEN 200 WHEN k % 4 > 2 THEN 2 END AS INT) AS effective_io_concurrency, round(CAST(CASE WHEN k % 5000 = -1 THEN NULL WHEN k % 5000 >= 2048 THEN sb / 32 WHEN k % 5000 < sb / 64 THEN -1 END AS DOUBLE), 2) AS wal_buffer,
 CAST(CASE WHEN w = 'ap' THEN CASE WHEN sm > 20 THEN 1000 WHEN sm < 2 THEN 50 WHEN fr > 0.0005 THEN 200 WHEN fr > 0.0004 THEN 250 WHEN fr > 0.0003 THEN 350 WHEN fr > 0.0002 THEN 500 WHEN fr > 0.0001 THEN 600 ELSE 800 END
  WHEN w = 'tp' THEN CASE WHEN rw < 0.5 THEN 10 WHEN rw < 1 THEN 50 WHEN rw < 2 THEN 80 ELSE 100 END ELSE 100 END AS INT) AS statistics_target,
 CAST(CASE WHEN w <> 'tp' AND k % 2 = 0 THEN 0 END AS INT) AS enable_nestloop, CAST(CASE WHEN w <> 'tp' AND k % 3 = 0 THEN 0 END AS INT) AS enable_mergejoin, CAST(CASE WHEN k % 5 = 0 THEN 1 END AS INT) AS enable_hashjoin,
 round(CASE WHEN k % 2 * 100 > 0 AND k % 2 * 100 < conn THEN conn END, 2) AS prepared_transactions FROM u""")
def n04_all(spark, d):
    k = N.recommend(_instances(spark, d))
    figures = ("connections", "work_memory", "maintenance_work_mem", "effective_cache_size", "wal_buffer", "prepared_transactions")
    flags = ("effective_io_concurrency", "statistics_target", "enable_nestloop", "enable_mergejoin", "enable_hashjoin")
    return k.select("instance", *(F.round(F.col(c).cast("double"), 2).alias(c) for c in figures), *(F.col(c).cast("int").alias(c) for c in flags))


_COUNTERS = {"blks_hit": "l_quantity * 10", "blks_read": "l_quantity", "tup_fetched": "l_extendedprice", "tup_returned": "l_extendedprice + l_quantity * 100", "tup_inserted": "l_linenumber", "tup_updated": "l_linenumber * 2", "tup_deleted": "l_discount * 100", "xact_commit": "l_quantity * 3", "xact_rollback": "l_tax * 100", "temp_bytes": "l_discount * 4096", "checkpoints_timed": "l_linenumber", "checkpoints_req": "l_discount * 10"}


@query("n01_ratios", f"""WITH c AS (SELECT l_suppkey % 10 AS instance, {', '.join(f'sum({e}) AS {n}' for n, e in _COUNTERS.items())} FROM lineitem GROUP BY 1)
 SELECT instance, round(blks_hit / (blks_hit + blks_read), 6) AS cache_hit, round(tup_fetched / (tup_inserted + tup_updated + tup_deleted), 6) AS read_write, round(tup_returned / (tup_inserted + tup_updated + tup_deleted), 6) AS search_modify, round(tup_fetched / tup_returned, 6) AS fetch_return,
 round(xact_rollback / xact_commit, 6) AS rollback_commit, round(temp_bytes / 1024, 4) AS temp_file_size, round(checkpoints_timed / (checkpoints_timed + checkpoints_req), 6) AS checkpoint_proactive, round(tup_inserted / (tup_inserted + tup_updated + tup_deleted), 6) AS insert_share,
 round(tup_updated / (tup_inserted + tup_updated + tup_deleted), 6) AS update_share, round(tup_deleted / (tup_inserted + tup_updated + tup_deleted), 6) AS delete_share FROM c""")
def n01(spark, d):
    sums = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("instance")).agg(*(F.expr(f"sum({e})").alias(n) for n, e in _COUNTERS.items()))
    found = N.workload_ratios(sums)
    return _round(_round(found, *(c for c in N.RATIOS if c != "temp_file_size")), "temp_file_size", digits=4).select("instance", *N.RATIOS)


@query("n05_notes", """SELECT s_suppkey AS instance, concat_ws('; ', CASE WHEN (s_suppkey % 300) / (s_suppkey % 7 * 100 + 100) > 0.7 THEN 'connections: over 70% in use' END, CASE WHEN s_suppkey % 32 + 1 <= 8 THEN 'cores: few for high concurrency' END,
 CASE WHEN s_suppkey % 2 = 0 THEN 'prepared transactions: two-phase commit is off' END, CASE WHEN s_suppkey % 5 = 0 THEN 'hash join: switched off' END) AS notes FROM supplier""")
def n05(spark, d):
    return N.warnings(_instances(spark, d)).select("instance", F.array_join("notes", "; ").alias("notes"))


_FIGURES = {"os_used": "s_suppkey % 97", "os_total": "100", "process_used": "s_suppkey % 61", "process_max": "s_suppkey % 3 * 35", "shared_used": "s_suppkey % 13", "shared_max": "15", "dynamic_used": "s_suppkey % 50", "dynamic_max": "55", "other_used": "s_suppkey % 11"}


@query("m01_memory_ratios", f"WITH f AS (SELECT s_suppkey AS instance, {', '.join(f'{e} AS {n}' for n, e in _FIGURES.items())} FROM supplier) " + " UNION ALL ".join(f"SELECT instance, '{n}' AS \"check\", round({u} / nullif({t}, 0), 6) AS ratio, coalesce({u} / nullif({t}, 0) >= {limit}, false) AS warned FROM f" for n, u, t, limit in M.RATIOS))
def m01(spark, d):
    figures = table(spark, d, "supplier").selectExpr("s_suppkey AS instance", *(f"{e} AS {n}" for n, e in _FIGURES.items()))
    return _round(M.memory_ratios(figures, "instance"), "ratio")


_DAILY = f"s0 AS (SELECT name, instance, ts_ms // {DAY} AS day, sum(value) AS v FROM ev GROUP BY ALL), d AS (SELECT name, instance, day, v + day * (CAST(instance AS INT) % 3 - 1) * 40 AS value FROM s0)"


@query("m02_continuous_increase", f"""WITH {EV}, {_DAILY}, i AS (SELECT name, instance, value, row_number() OVER (PARTITION BY name, instance ORDER BY day) AS i, count(*) OVER (PARTITION BY name, instance) AS n FROM d),
 s AS (SELECT a.name, a.instance, any_value(a.n) AS n, count(*) FILTER (b.value > a.value) AS up, count(*) FILTER (b.value < a.value) AS down FROM i a JOIN i b ON a.name = b.name AND a.instance = b.instance AND b.i = a.i + a.n // 2 AND a.i <= a.n // 2 WHERE a.n >= 5 GROUP BY ALL),
 g AS (SELECT name, instance, regr_slope(value, i) AS slope FROM i GROUP BY ALL),
 t AS (SELECT n, k, 2 * sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) OVER (PARTITION BY n ORDER BY k ROWS UNBOUNDED PRECEDING) AS p FROM (SELECT DISTINCT n FROM s), range(0, 1000) r(k) WHERE k <= n // 2),
 l AS (SELECT n, arg_min(p, k) AS level FROM (SELECT n, k, p, lead(p) OVER (PARTITION BY n ORDER BY k) - p AS step FROM t) WHERE step > 1e-5 GROUP BY n)
 SELECT name, instance, up >= down AND slope > 0 AND t.p < level AS increasing, s.n FROM s JOIN g USING (name, instance) JOIN l ON l.n = s.n JOIN t ON t.n = s.n AND t.k = s.down""")
def m02(spark, d):
    """Growth of every figure of every instance, by days."""
    e = table(spark, d, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 10).cast("string").alias("instance"), F.expr(f"unix_millis(cast(ts as timestamp)) div {DAY}").alias("day"), "value")
    daily = e.groupBy("name", "instance", "day").agg((F.sum("value") + F.col("day") * (F.col("instance").cast("int") % 3 - 1) * 40).alias("value"))
    return M.continuous_increase(daily.withColumnRenamed("day", "ts_ms"), ["name", "instance"])


@query("m04_exporters", f"""WITH {SAMP}, s AS (SELECT name, count(DISTINCT instance) AS instances, max(ts_ms) AS last_ms FROM samp GROUP BY name), x AS (SELECT *, CASE WHEN last_ms < {START + 29 * DAY + 20 * HOUR} THEN 'silent' WHEN instances >= 10 THEN 'normal' WHEN instances > 1 THEN 'partial' ELSE 'single' END AS state FROM s)
 SELECT name, instances, state, CASE state WHEN 'silent' THEN 'start the exporter or check its address' WHEN 'partial' THEN 'deploy the exporter on the other instances' WHEN 'single' THEN 'deploy the exporter on the other instances' END AS suggestion FROM x""")
def m04(spark, d):
    samples = S.event_samples(spark, d).withColumn("instance", F.col("labels")["from_instance"])
    return M.exporter_health(samples, expected=10, now=START + 29 * DAY + 21 * HOUR, silence_ms=HOUR)


@query("m05_actions", """WITH a AS (SELECT * FROM (VALUES ('kill session', ['lock', 'memory']), ('add disk', ['disk']), ('restart', ['memory', 'hang'])) t(action, causes)), x AS (SELECT unnest(causes) AS cause, action FROM a), o AS (SELECT o_orderkey AS alarm, CASE o_orderkey % 5 WHEN 0 THEN 'lock' WHEN 1 THEN 'disk' WHEN 2 THEN 'memory' WHEN 3 THEN 'hang' ELSE 'network' END AS cause FROM orders)
 SELECT alarm, cause, coalesce(string_agg(action, ', ' ORDER BY action), '') AS actions FROM o LEFT JOIN x USING (cause) GROUP BY ALL""")
def m05(spark, d):
    actions = spark.createDataFrame([("kill session", ["lock", "memory"]), ("add disk", ["disk"]), ("restart", ["memory", "hang"])], "action string, causes array<string>")
    cause = F.element_at(F.array(*map(F.lit, ("lock", "disk", "memory", "hang", "network"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    alarms = table(spark, d, "orders").select(F.col("o_orderkey").alias("alarm"), cause.alias("cause"))
    return M.healing_actions(alarms, actions).select("alarm", "cause", F.array_join("actions", ", ").alias("actions"))
