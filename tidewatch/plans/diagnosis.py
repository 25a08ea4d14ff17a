"""Queries of causes of slow statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import advisor as A
from tidewatch.operators import causes as C
from tidewatch.plans.registry import query
from tidewatch.sources.series import epoch_ms, table
from tidewatch.sources.store import cut

START = 1704067200000

#: Statement texts by o_orderkey % 8, on table t<o_orderkey % 25>; @ stands for a quote.
_TEXTS = (
    "'select count(distinct a) from t' || x || ' where b = 1'",
    "'update t' || x || ' set a = 1 where b = 2'",
    "'delete from t' || x || ' where lower(b) = @x@'",
    "'insert into t' || x || ' values (1)'",
    "'select a from t' || x || ' where b like @%x@'",
    "'select a from t' || x || ' where b in (' || array_join(transform(sequence(1, 60), v -> cast(v as string)), ', ') || ')'",
    "'select a from t' || x || ' where b in (select c from t' || x || ' where d = 1)'",
    "'select a from t' || x || ' order by random()'",
)
_ROOT = "CASE k % 8 WHEN 1 THEN 'Update on t' || x WHEN 2 THEN 'Delete on t' || x WHEN 3 THEN 'Insert on t' || x ELSE 'Hash Join' END"
_FILTER = "CASE k % 8 WHEN 2 THEN '(lower(b) = @x@)' WHEN 4 THEN '(b ~~ @%x@)' ELSE '(b = 1)' END"
#: Plan texts by o_orderkey % 3.
_PLANS = (
    "cast(null as string)",
    rf"{_ROOT} || '  (cost=0.00..1000.00 rows=' || k % 1800 || ' width=8)\n  ->  Seq Scan on t' || x || '  (cost=0.00..' || c % 500 || '.00 rows=60000 width=8)\n        Filter: ' || {_FILTER}"
    r" || '\n  ->  Hash  (cost=0.00..' || k % 521 || '.00 rows=100 width=8)' || CASE WHEN k % 8 = 6 AND k % 5 = 0 THEN '\n  SubPlan 1' ELSE '' END",
    r"'GroupAggregate  (cost=' || (200 + c % 700) || '.00..900.00 rows=10 width=8)\n  ->  Sort  (cost=200.00..' || (200 + c % 700) || '.00 rows=100 width=8)\n        ->  Nested Loop  (cost=0.00..200.00 rows=100 width=8)"
    r"\n              ->  Merge Join  (cost=0.00..150.00 rows=100 width=8)'",
)


def _case(by: str, values: tuple[str, ...]) -> str:
    quoted = [v.replace("@", "\\'") for v in values]
    return f"CASE {by} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted)) + " END"


def statements(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c", "o_orderkey % 25 AS x")
    return o.selectExpr(
        "k AS id", "c % 8 AS instance", "'d' || x % 2 AS db", f"{_case('k % 8', _TEXTS)} AS query", f"{_case('k % 3', _PLANS)} AS plan",
        f"{START} + (k * 7919 % 2500000) * 1000 AS start_ms", "60000 + (k % 60) * 60000 AS duration_ms", "CASE WHEN k % 9 = 0 THEN k END AS blocker", "CASE WHEN k % 7 = 0 THEN 5 ELSE 0 END AS lock_wait",
        "0 AS lwlock_wait", "CASE WHEN k % 11 = 0 THEN 'lock manager' END AS wait_event", "k % 1500 AS fetched", "c % 300 AS returned", "k % 1100 AS returned_rows",
        "CASE WHEN k % 8 = 1 THEN k % 2000 ELSE 0 END AS n_updated", "CASE WHEN k % 8 = 3 THEN k % 1900 ELSE 0 END AS n_inserted", "CASE WHEN k % 8 = 2 THEN k % 1700 ELSE 0 END AS n_deleted",
        "(60000 + (k % 60) * 60000) * (k % 10) / 10 AS plan_time", "k % 3 AS hard_parse", "k % 2 AS soft_parse", "CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS sort_spills", "CASE WHEN k % 6 = 0 THEN 2 ELSE 0 END AS hash_spills",
    )


#: Event types as samples: (name, divisor) twice.
_SAMPLES = {
    "click": ("db_cpu", 100, "tps", 0.1), "view": ("user_cpu", 100, "connections", 1), "purchase": ("system_mem", 100, "process_fds", 100),
    "error": ("io_utils", 100, "bandwidth", 100), "signup": ("receive_drop", 10000, "disk_usage", 100),
}
_SETTINGS = {
    "process_used_memory": "n * 12", "max_process_memory": "100", "dynamic_used_memory": "n * 10", "max_dynamic_memory": "100", "other_used_memory": "n * 800",
    "max_connections": "50 + n * 10", "enable_thread_pool": "n % 2",
}


def context(spark, d):
    n = table(spark, d, "nation").selectExpr("n_nationkey AS n")
    tables = n.where("n < 20").selectExpr(
        "'d' || n % 2 AS db", "'t' || n AS table_name", "n * 90 AS live_tuples", "n * 20 AS dead_tuples", "n % 10 / 100 AS dead_rate", "n * 3 AS size_mb", "n % 5 AS indexes",
        f"{START} + n * 100000000 AS vacuum_ms", f"{START} + n * 90000000 + 50000000 AS analyze_ms", "CASE WHEN n % 6 = 0 THEN -1 ELSE n END AS changed_delay", "n * 120 AS tuples_diff",
    )
    pairs = "CASE event_type " + " ".join(f"WHEN '{t}' THEN array(struct('{a}' AS name, value / {f} AS value), struct('{b}' AS name, value / {g} AS value))" for t, (a, f, b, g) in _SAMPLES.items()) + " END"
    samples = table(spark, d, "events").select((F.col("user_id") % 8).alias("instance"), epoch_ms("ts").alias("ts_ms"), F.explode(F.expr(pairs)).alias("s")).select("instance", "ts_ms", "s.name", "s.value")
    figures = F.array(*(F.struct(F.lit(a).alias("name"), F.expr(e).cast("double").alias("setting")) for a, e in _SETTINGS.items()))
    settings = n.where("n < 8").select(F.col("n").alias("instance"), F.explode(figures).alias("s")).select("instance", "s.name", "s.setting")
    advice = table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderkey % 5 = 0 AS recommended", "o_orderkey % 4 = 1 AS unused", "o_orderkey % 6 = 1 AS redundant", "o_orderkey % 10 = 3 AS rewritten")
    return C.gather(statements(spark, d), tables, samples, settings, advice)


_VACUUM, _ANALYZE = f"{START} + x * 100000000", f"{START} + x * 90000000 + 50000000"

#: The same rules over the numbers that the texts and plans are made of.
_RULES = {
    "lock_contention": "k % 9 = 0 OR k % 7 = 0",
    "many_dead_tuples": "k % 8 <> 3 AND k % 3 < 2 AND x BETWEEN 10 AND 19 AND x % 10 >= 2",
    "heavy_scan_operator": "NOT updated AND NOT deleted AND CASE k % 3 WHEN 0 THEN k % 1500 + c % 300 >= 1000 OR k % 1100 >= 1000 WHEN 1 THEN c % 500 >= 20 ELSE false END",
    "abnormal_plan_time": "k % 10 >= 6 AND k % 3 > k % 2",
    "unused_and_redundant_index": "x BETWEEN 10 AND 19 AND (k % 4 = 1 OR k % 6 = 1) AND k % 8 IN (1, 2, 3)",
    "update_large_data": "updated",
    "insert_large_data": "k % 8 = 3 AND (k % 1900 >= 1000 OR (k % 3 = 1 AND k % 1800 > 1000))",
    "delete_large_data": "deleted",
    "too_many_index": "k % 8 IN (1, 2, 3) AND x < 20 AND x % 5 >= 3",
    "disk_spill": "(k % 4 = 0 OR k % 6 = 0) AND CASE k % 3 WHEN 0 THEN true WHEN 1 THEN k % 521 >= 15 ELSE round((c % 700) / 900.0, 2) >= 0.02 END",
    "vacuum_event": f"x < 20 AND ({_VACUUM} BETWEEN s AND e OR s BETWEEN {_VACUUM} AND {_VACUUM} + 6000)",
    "analyze_event": f"x < 20 AND ({_ANALYZE} BETWEEN s AND e OR s BETWEEN {_ANALYZE} AND {_ANALYZE} + 6000)",
    "workload_contention": "c % 8 >= 7 OR coalesce(click * 10 >= (50 + c % 8 * 10) * 10, false) OR coalesce(click >= 60, false) OR coalesce(signup >= 70, false) OR coalesce(seen / (50 + c % 8 * 10) >= 0.9, false)",
    "cpu_resource_contention": "coalesce(seen >= 60, false)",
    "io_resource_contention": "coalesce(error >= 70, false)",
    "memory_resource_contention": "coalesce(purchase >= 60, false)",
    "abnormal_network_status": "coalesce(signup >= 100, false) OR coalesce(error >= 80, false)",
    "os_resource_contention": "coalesce(purchase >= 70, false)",
    "database_wait_event": "k % 11 = 0",
    "lack_of_statistics": "x < 20 AND x % 6 <> 0 AND x * 120 > 1000",
    "missing_index": "k % 5 = 0",
    "poor_join_performance": "k % 3 = 2 OR (k % 3 = 1 AND k % 8 NOT IN (1, 2, 3))",
    "complex_boolean_expression": "k % 8 = 5",
    "string_matching": "CASE k % 3 WHEN 2 THEN k % 8 = 7 ELSE k % 8 IN (2, 4) END",
    "complex_execution_plan": "k % 3 = 2 AND k % 8 <> 5",
    "correlated_subquery": "k % 3 = 1 AND k % 8 = 6 AND k % 5 = 0",
    "poor_aggregation_performance": "k % 3 = 2 AND (200 + c % 700 <= 882 OR k % 8 = 0)",
    "abnormal_sql_structure": "k % 10 = 3",
    "timed_task_conflict": "false",
}
_FEATURES = f"""b AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 25 AS x, {START} + (o_orderkey * 7919 % 2500000) * 1000 AS s, {START} + (o_orderkey * 7919 % 2500000) * 1000 + 60000 + (o_orderkey % 60) * 60000 AS e FROM orders),
 h AS (SELECT k, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS seen, max(value) FILTER (event_type = 'purchase') AS purchase, max(value) FILTER (event_type = 'error') AS error, max(value) FILTER (event_type = 'signup') AS signup
  FROM b JOIN events ON user_id % 8 = c % 8 AND epoch_us(ts) // 1000 BETWEEN s AND e GROUP BY k),
 f AS (SELECT b.*, click, seen, purchase, error, signup, k % 8 = 1 AND (k % 2000 >= 1000 OR (k % 3 = 1 AND k % 1800 > 1000)) AS updated, k % 8 = 2 AND (k % 1700 >= 1000 OR (k % 3 = 1 AND k % 1800 > 1000)) AS deleted FROM b LEFT JOIN h USING (k))"""


@query("q30_features", f"WITH {_FEATURES} SELECT k AS id, {', '.join(f'CAST({_RULES[n]} AS INT) AS {n}' for n in C.FEATURES)} FROM f")
def q30(spark, d):
    """All features, Q01 to Q29, over every statement, from context tables."""
    return C.features(context(spark, d)).select("id", *C.FEATURES)


_BITS = ("l_quantity > 25", "l_discount > 0.05", "l_tax > 0.04", "l_linenumber > 3")


@query("q33_label_weights", f"""WITH i AS (SELECT l_returnflag AS label, unnest([{", ".join(f"CAST({b} AS INT)" for b in _BITS)}]) AS x, unnest([0, 1, 2, 3]) AS i FROM lineitem),
 s AS (SELECT label, i, CAST(sum(x) AS DOUBLE) AS v FROM i GROUP BY ALL), d AS (SELECT a.label AS a, b.label AS b, sum((a.v - b.v) ** 2) AS d FROM s a JOIN s b ON a.i = b.i AND a.label <> b.label GROUP BY ALL),
 n AS (SELECT a, sum(d) AS n FROM d GROUP BY a), w AS (SELECT d.a, s.i, sum(s.v / d.d) / any_value(n.n) AS w FROM d JOIN s ON s.label = d.b JOIN n ON n.a = d.a GROUP BY d.a, s.i),
 r AS (SELECT s.label, s.i, abs(w.w - s.v) AS r FROM s JOIN w ON w.a = s.label AND w.i = s.i) SELECT label, i, round(r / sum(r) OVER (PARTITION BY label), 6) AS weight FROM r""")
def q33(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), F.array(*(F.expr(b).cast("int") for b in _BITS)).alias("pattern"))
    return A.label_weights(l).select("label", F.posexplode("weight").alias("i", "w")).select("label", "i", F.round("w", 6).alias("weight"))


@query("q31_library_scores", f"""WITH {_FEATURES}, x AS (SELECT k AS id, k % 8 AS label, [{', '.join(f'CAST({_RULES[n]} AS INT)' for n in C.FEATURES)}] AS bits FROM f),
 i AS (SELECT label, unnest(bits) AS x, unnest(range(0, {len(C.FEATURES)})) AS i FROM x), s AS (SELECT label, i, CAST(sum(x) AS DOUBLE) AS v FROM i GROUP BY ALL),
 d AS (SELECT a.label AS a, b.label AS b, sum((a.v - b.v) ** 2) AS d FROM s a JOIN s b ON a.i = b.i AND a.label <> b.label GROUP BY ALL),
 n AS (SELECT a, sum(d) AS n FROM d GROUP BY a), w AS (SELECT d.a, s.i, sum(s.v / d.d) / any_value(n.n) AS w FROM d JOIN s ON s.label = d.b JOIN n ON n.a = d.a GROUP BY d.a, s.i),
 r AS (SELECT s.label, s.i, abs(w.w - s.v) AS r FROM s JOIN w ON w.a = s.label AND w.i = s.i), u AS (SELECT label, list(w ORDER BY i) AS ws FROM (SELECT label, i, r / sum(r) OVER (PARTITION BY label) AS w FROM r) GROUP BY label),
 lib AS (SELECT DISTINCT label, bits FROM x), kinds AS (SELECT DISTINCT bits FROM x), places AS (SELECT bits, unnest(bits) AS on_, unnest(range(0, {len(C.FEATURES)})) AS i FROM kinds), told AS (SELECT label, bits AS pattern, unnest(bits) AS on_, unnest(range(0, {len(C.FEATURES)})) AS i FROM lib),
 weighed AS (SELECT told.label, told.pattern, told.i, ws[told.i + 1] AS w FROM told JOIN u ON u.label = told.label WHERE told.on_ = 1),
 z AS (SELECT p.bits, t.label, t.pattern, sum(t.w) AS s FROM places p JOIN weighed t ON t.i = p.i WHERE p.on_ = 1 GROUP BY 1, 2, 3), m AS (SELECT bits, label, max(s) AS s FROM z WHERE s > 0 GROUP BY 1, 2)
 SELECT x.id, CAST(m.label AS INT) AS label, round(m.s / sum(m.s) OVER (PARTITION BY x.id), 6) AS probability FROM x JOIN m ON m.bits = x.bits""")
def q31(spark, d):
    """Causes of every statement by all features, from a library of known patterns whose labels are the statements' shapes, weighed by how labels differ."""
    bits = F.array(*(F.col(n).cast("int") for n in C.FEATURES))
    x = cut(C.features(context(spark, d)).select("id", (F.col("id") % 8).cast("int").alias("label"), bits.alias("features")))
    weights = A.label_weights(x.select("label", F.col("features").alias("pattern")))
    library = x.select("label", F.col("features").alias("pattern")).distinct().join(weights, "label")
    # Statements with the same features get the same answer.
    kinds = cut(x.select("features").distinct().withColumn("kind", F.monotonically_increasing_id()))
    causes = A.kind_causes(kinds, "kind", library).select("kind", F.col("label").alias("cause"), "probability")
    return x.join(kinds, "features").join(causes, "kind").select("id", F.col("cause").alias("label"), F.round("probability", 6).alias("probability"))
