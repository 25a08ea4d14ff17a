"""Queries over result tables: joins, aggregates, sorts, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import results as R
from tidewatch.operators import transforms as T
from tidewatch.plans.registry import query
from tidewatch.sources.series import epoch_ms, table

SLOW = """slow AS (SELECT o_orderkey AS id, o_custkey % 8 AS instance, o_orderpriority AS db, o_custkey AS template, epoch_us(o_orderdate) // 1000 AS start_ms, o_totalprice AS duration,
 CASE o_orderstatus WHEN 'F' THEN 'SELECT' WHEN 'O' THEN 'UPDATE' ELSE 'INSERT' END AS kind FROM orders)"""


def slow(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 8).alias("instance"), F.col("o_orderpriority").alias("db"), F.col("o_custkey").alias("template"),
        epoch_ms("o_orderdate").alias("start_ms"), F.col("o_totalprice").alias("duration"),
        F.when(F.col("o_orderstatus") == "F", "SELECT").when(F.col("o_orderstatus") == "O", "UPDATE").otherwise("INSERT").alias("kind"),
    )


def _n(name="n"):
    return F.count(F.lit(1)).alias(name)


# --- filters -----------------------------------------------------------------------------------


@query("f01_optional_predicates", f"WITH {SLOW} SELECT id, db, duration FROM slow WHERE instance = 3 AND db IN ('1-URGENT', '5-LOW') AND duration >= 1000 AND duration <= 300000 AND contains(db, '-')")
def f01(spark, d):
    return R.select(slow(spark, d), ["id", "db", "duration"], {"instance": 3}, {"db": ["1-URGENT", "5-LOW"]}, ("duration", 1000), ("duration", 300000), {"db": "-"})


@query("f02_dynamic_columns", "SELECT o.o_orderkey, o.o_totalprice, l.l_linenumber FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE o.o_totalprice > 300000")
def f02(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    return R.select(o.where("o_totalprice > 300000").join(l, o["o_orderkey"] == l["l_orderkey"]), ["o_orderkey", "o_totalprice", "l_linenumber"])


@query("f03_patterns", "SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_type, '(.*(STEEL|BRASS).*)') OR p_name ILIKE '%GREEN%' OR NOT regexp_matches(p_brand, '#[1-4]')")
def f03(spark, d):
    p = table(spark, d, "part")
    return p.where(F.col("p_type").rlike("^(?:.*(STEEL|BRASS).*)$") | F.col("p_name").ilike("%GREEN%") | ~F.col("p_brand").rlike("#[1-4]")).select("p_partkey", "p_name")


@query("f04_distinct_from", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS DISTINCT FROM 'F'")
def f04(spark, d):
    return table(spark, d, "orders").where(~F.nullif(F.col("o_orderstatus"), F.lit("P")).eqNullSafe("F")).select("o_orderkey")


@query("f05_row_value", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus, l_linenumber) = ('R', 'F', 1)")
def f05(spark, d):
    return table(spark, d, "lineitem").where("struct(l_returnflag, l_linestatus, l_linenumber) = struct('R', 'F', 1)").select("l_orderkey", "l_linenumber")


@query("f06_in_subquery", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def f06(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("f07_latest_snapshot", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def f07(spark, d):
    return R.latest_snapshot(table(spark, d, "orders"), "o_orderdate").select("o_orderkey", "o_totalprice")


@query("f10_page", f"WITH {SLOW} SELECT id, duration FROM slow ORDER BY duration DESC, id LIMIT 20 OFFSET 40")
def f10(spark, d):
    return R.page(slow(spark, d).select("id", "duration"), [F.col("duration").desc(), F.col("id")], 3, 20)


# --- joins ---------------------------------------------------------------------------------------


@query("j01_journal", "SELECT l_orderkey AS id, l_linenumber, o_orderpriority AS db FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def j01(spark, d):
    journal = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"), "l_linenumber")
    return journal.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("db")), "id")


@query("j02_with_counts", f"WITH {SLOW} SELECT id, template, count(*) OVER (PARTITION BY template) AS n FROM slow")
def j02(spark, d):
    return R.with_counts(slow(spark, d).select("id", "template"), "template")


@query("j03_three_tables", "SELECT c_name, n_name, r_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND c_acctbal < 0")
def j03(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.where("c_acctbal < 0").join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("c_name", "n_name", "r_name")


@query("j04_complete_domain", f"WITH {SLOW} SELECT s.kind, coalesce(c.n, 0) AS n FROM (SELECT unnest(['SELECT', 'UPDATE', 'INSERT', 'DELETE']) AS kind) s LEFT JOIN (SELECT kind, count(*) AS n FROM slow GROUP BY kind) c USING (kind)")
def j04(spark, d):
    return R.complete_domain(slow(spark, d).groupBy("kind").agg(_n()), "kind", ["SELECT", "UPDATE", "INSERT", "DELETE"], "n")


@query("j05_single_rows", f"WITH {SLOW} SELECT a.n AS urgent, b.n AS low FROM (SELECT count(*) AS n FROM slow WHERE db = '1-URGENT') a, (SELECT count(*) AS n FROM slow WHERE db = '5-LOW') b")
def j05(spark, d):
    return slow(spark, d).agg(F.count_if(F.col("db") == "1-URGENT").alias("urgent"), F.count_if(F.col("db") == "5-LOW").alias("low"))


@query("j06_holders_waiters", "SELECT h.l_orderkey AS tag, h.l_linenumber AS holder, w.l_linenumber AS waiter FROM lineitem h JOIN lineitem w ON h.l_orderkey = w.l_orderkey WHERE h.l_returnflag = 'A' AND w.l_returnflag = 'R'")
def j06(spark, d):
    locks = table(spark, d, "lineitem")
    side = lambda flag, name: locks.where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("tag"), F.col("l_linenumber").alias(name))
    return side("A", "holder").join(side("R", "waiter"), "tag")


@query("j07_two_metrics", f"WITH {SLOW} SELECT instance, db, round(max(duration), 2) AS longest, count(*) FILTER (kind = 'SELECT') AS reads FROM slow GROUP BY ALL")
def j07(spark, d):
    s = slow(spark, d)
    reads = s.where("kind = 'SELECT'").groupBy("instance", "db").agg(_n("reads"))
    return s.groupBy("instance", "db").agg(F.round(F.max("duration"), 2).alias("longest")).join(reads, ["instance", "db"], "left").withColumn("reads", F.coalesce("reads", F.lit(0)))


@query("j08_intersection", f"WITH {SLOW} SELECT template FROM slow GROUP BY template HAVING bool_or(kind = 'SELECT') AND bool_or(kind = 'UPDATE') AND bool_or(kind = 'INSERT')")
def j08(spark, d):
    s = slow(spark, d)
    kinds = [s.where(F.col("kind") == k).select("template").distinct() for k in ("SELECT", "UPDATE", "INSERT")]
    return kinds[0].join(kinds[1], "template").join(kinds[2], "template")


@query("j09_outer_merge", f"WITH {SLOW} SELECT instance, max(duration) FILTER (db = '1-URGENT') AS urgent, max(duration) FILTER (db = '5-LOW') AS low FROM slow GROUP BY instance")
def j09(spark, d):
    m = lambda db: F.max(F.when(F.col("db") == db, F.col("duration")))
    return slow(spark, d).groupBy("instance").agg(m("1-URGENT").alias("urgent"), m("5-LOW").alias("low"))


@query("j11_longest_prefix", """WITH p AS (SELECT '/data/' || p_size || '/' || p_partkey AS path FROM part), m AS (SELECT DISTINCT '/data/' || p_size AS mount FROM part WHERE p_size % 2 = 0 UNION SELECT '/' UNION SELECT '/data'),
 j AS (SELECT path, mount, row_number() OVER (PARTITION BY path ORDER BY length(mount) DESC) AS r FROM p JOIN m ON mount = '/' OR path = mount OR starts_with(path, mount || '/')) SELECT path, mount FROM j WHERE r = 1""")
def j11(spark, d):
    p = table(spark, d, "part")
    paths = p.select(F.concat(F.lit("/data/"), "p_size", F.lit("/"), "p_partkey").alias("path"))
    fixed = spark.createDataFrame([("/",), ("/data",)], "mount string")
    mounts = p.where("p_size % 2 = 0").select(F.concat(F.lit("/data/"), "p_size").alias("mount")).distinct().unionByName(fixed)
    return R.containing_prefix(paths, "path", mounts, "mount").select("path", "mount")


@query("j12_resample", """WITH e AS (SELECT event_type, epoch_us(ts) // 1000 // 3600000 * 3600000 AS t, round(avg(value), 6) AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL),
 a AS (SELECT t FROM e WHERE event_type = 'click' AND t % 7200000 = 0), b AS (SELECT t, v FROM e WHERE event_type = 'view'),
 u AS (SELECT t, v, CASE WHEN v IS NOT NULL THEN t END AS k FROM a FULL JOIN b USING (t)),
 w AS (SELECT t, last_value(v IGNORE NULLS) OVER p AS v0, first_value(v IGNORE NULLS) OVER f AS v1, last_value(k IGNORE NULLS) OVER p AS t0, first_value(k IGNORE NULLS) OVER f AS t1 FROM u
  WINDOW p AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT w.t AS ts_ms, round(coalesce(CASE WHEN t1 > t0 THEN v0 + (v1 - v0) * (w.t - t0) / (t1 - t0) END, v0, v1), 5) AS value FROM w JOIN a ON a.t = w.t""")
def j12(spark, d):
    from tidewatch.sources.series import hourly

    h = hourly(spark, d)
    wanted = h.where("name = 'click' AND ts_ms % 7200000 = 0").select("ts_ms", F.lit(True).alias("_wanted"))
    view = h.where("name = 'view'").select("ts_ms", "value")
    both = wanted.join(view, "ts_ms", "full").withColumn("name", F.lit("view"))
    return T.interpolate(both, ["name"]).where("_wanted").select("ts_ms", F.round("value", 5).alias("value"))


@query("j13_interval_overlap", """WITH s AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) // 1000 AS a, epoch_us(o_orderdate) // 1000 + 86400000 * 2 AS b FROM orders WHERE o_totalprice > 280000),
 v AS (SELECT l_orderkey AS vid, epoch_us(l_shipdate) // 1000 AS t FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 1) SELECT id, vid FROM s JOIN v ON t BETWEEN a AND b""")
def j13(spark, d):
    s = table(spark, d, "orders").where("o_totalprice > 280000").select(F.col("o_orderkey").alias("id"), epoch_ms("o_orderdate").alias("a"))
    v = table(spark, d, "lineitem").where("l_quantity = 50 AND l_linenumber = 1").select(F.col("l_orderkey").alias("vid"), epoch_ms("l_shipdate").alias("t"))
    return R.band_join(s, v, "a", "t", 2 * 86_400_000).select("id", "vid")


@query("j14_band_self_join", "SELECT a.p_partkey AS a_key, b.p_partkey AS b_key FROM part a JOIN part b ON b.p_retailprice BETWEEN a.p_retailprice AND a.p_retailprice + 1 WHERE a.p_size = 10")
def j14(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_size = 10").select(F.col("p_partkey").alias("a_key"), F.col("p_retailprice").alias("x"))
    b = p.select(F.col("p_partkey").alias("b_key"), F.col("p_retailprice").alias("y"))
    return R.band_join(a, b, "x", "y", 1).select("a_key", "b_key")


@query("j15_wait_chain", """WITH RECURSIVE l AS (SELECT p_partkey AS waiter, CASE WHEN p_partkey % 10 <> 0 THEN p_partkey - 1 END AS holder FROM part),
 c AS (SELECT waiter, waiter AS root, holder AS up, 0 AS depth FROM l UNION ALL SELECT c.waiter, l.waiter, l.holder, c.depth + 1 FROM c JOIN l ON c.up = l.waiter)
 SELECT waiter, max_by(root, depth) AS root, max(depth) AS depth FROM c GROUP BY waiter""")
def j15(spark, d):
    links = table(spark, d, "part").select(F.col("p_partkey").alias("waiter"), F.when(F.col("p_partkey") % 10 != 0, F.col("p_partkey") - 1).alias("holder"))
    # A holder that waits for nothing has no row of its own where keys begin above it.
    return R.ancestors(links, "waiter", "holder").join(links.select(F.col("waiter").alias("root")), "root", "left_semi").select("waiter", "root", "depth")


@query("j16_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j16(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


# --- aggregates ----------------------------------------------------------------------------------


@query("a01_by_database", f"WITH {SLOW} SELECT db, count(*) AS n FROM slow GROUP BY db")
def a01(spark, d):
    return slow(spark, d).groupBy("db").agg(_n())


@query("a02_trend", f"WITH {SLOW} SELECT start_ms, count(*) AS n FROM slow GROUP BY start_ms ORDER BY start_ms DESC LIMIT 100")
def a02(spark, d):
    return slow(spark, d).groupBy("start_ms").agg(_n()).orderBy(F.col("start_ms").desc()).limit(100)


@query("a03_distribution", f"WITH {SLOW} SELECT count(*) FILTER (kind = 'SELECT') AS n_select, count(*) FILTER (kind = 'UPDATE') AS n_update, count(*) FILTER (kind = 'DELETE') AS n_delete, count(*) FILTER (kind = 'INSERT') AS n_insert FROM slow")
def a03(spark, d):
    return slow(spark, d).agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in ("SELECT", "UPDATE", "DELETE", "INSERT")))


@query("a04_mean_default", f"WITH {SLOW} SELECT round(coalesce((SELECT avg(duration) FROM slow WHERE kind = 'UPDATE') / 1e6, -1), 6) AS some, coalesce((SELECT avg(duration) FROM slow WHERE kind = 'DELETE') / 1e6, -1) AS none_found")
def a04(spark, d):
    s = slow(spark, d)
    some = R.mean_or(s.where("kind = 'UPDATE'"), "duration", "some", 1e-6).withColumn("some", F.round("some", 6))
    return some.crossJoin(F.broadcast(R.mean_or(s.where("kind = 'DELETE'"), "duration", "none_found", 1e-6)))


@query("a05_templates", f"WITH {SLOW}, g AS (SELECT template, count(*) AS n, max(start_ms) AS start_ms FROM slow GROUP BY template ORDER BY n DESC, template LIMIT 50) SELECT g.template, g.n, g.start_ms, max(s.id) AS id FROM g JOIN slow s USING (template, start_ms) GROUP BY ALL")
def a05(spark, d):
    return R.newest_of(slow(spark, d), "template", ["start_ms", "id"], 50)


@query("a06_alarm_counts", f"WITH {SLOW} SELECT instance, kind AS content, count(*) AS n FROM slow WHERE duration > 200000 GROUP BY ALL")
def a06(spark, d):
    return slow(spark, d).where("duration > 200000").groupBy("instance", F.col("kind").alias("content")).agg(_n())


@query("a07_hit_ratio", "WITH b AS (SELECT l_suppkey % 8 AS instance, l_returnflag AS db, sum(l_quantity) / (sum(l_quantity) + sum(l_linenumber) + 0.0001) AS r FROM lineitem GROUP BY ALL) SELECT instance, round(avg(r), 6) AS ratio FROM b GROUP BY instance")
def a07(spark, d):
    l = table(spark, d, "lineitem").withColumn("instance", F.col("l_suppkey") % 8)
    return R.hit_ratio(l, "instance", "l_returnflag", "l_quantity", "l_linenumber").withColumn("ratio", F.round("ratio", 6))


@query("a08_nested_distinct", f"WITH {SLOW} SELECT count(DISTINCT db) AS dbs, count(DISTINCT db || '/' || instance) AS schemas, count(DISTINCT db || '/' || instance || '/' || template) AS tables FROM slow")
def a08(spark, d):
    return slow(spark, d).agg(F.count_distinct("db").alias("dbs"), F.count_distinct("db", "instance").alias("schemas"), F.count_distinct("db", "instance", "template").alias("tables"))


@query("a09_snapshot_sums", f"WITH {SLOW} SELECT count(*) AS n, round(sum(duration), 2) AS total FROM slow WHERE start_ms = (SELECT max(start_ms) FROM slow)")
def a09(spark, d):
    return R.latest_snapshot(slow(spark, d), "start_ms").agg(_n(), F.round(F.sum("duration"), 2).alias("total"))


@query("a10_per_time", f"WITH {SLOW} SELECT start_ms, count(*) AS n, count(DISTINCT template) AS templates, round(max(duration), 2) AS longest FROM slow GROUP BY start_ms")
def a10(spark, d):
    return slow(spark, d).groupBy("start_ms").agg(_n(), F.count_distinct("template").alias("templates"), F.round(F.max("duration"), 2).alias("longest"))


@query("a11_listed", "SELECT p_brand, string_agg(p_partkey, ';' ORDER BY p_partkey) AS keys, count(*) AS n, round(sum(p_retailprice / 10), 4) AS share FROM part GROUP BY p_brand")
def a11(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("p_partkey")).cast("array<string>"), ";").alias("keys"), _n(), F.round(F.sum(F.col("p_retailprice") / 10), 4).alias("share"))


@query("a12_risk_levels", "SELECT count(*) FILTER (p_size >= 50) AS fatal, count(*) FILTER (p_size >= 40 AND p_size < 50) AS risky, count(*) FILTER (p_size >= 30 AND p_size < 40) AS warning, count(*) FILTER (p_size >= 20 AND p_size < 30) AS notice FROM part")
def a12(spark, d):
    return table(spark, d, "part").agg(*(F.count_if((F.col("p_size") >= low) & (F.col("p_size") < (low + 10 if low < 50 else float("inf")))).alias(name) for name, low in R.RISKS.items()))


@query("a13_topology", "SELECT n_regionkey AS cluster, count(*) AS nodes, count(*) FILTER (n_nationkey % 2 = 0) AS primaries, CASE WHEN count(*) FILTER (n_nationkey % 7 = 0) > 0 THEN 'degraded' ELSE 'normal' END AS state FROM nation GROUP BY n_regionkey")
def a13(spark, d):
    n = table(spark, d, "nation")
    return n.groupBy(F.col("n_regionkey").alias("cluster")).agg(_n("nodes"), F.count_if(F.col("n_nationkey") % 2 == 0).alias("primaries"), F.when(F.count_if(F.col("n_nationkey") % 7 == 0) > 0, "degraded").otherwise("normal").alias("state"))


@query("a14_profile", "SELECT event_type, round(avg(value), 4) AS avg, round(min(value), 4) AS min, round(max(value), 4) AS max, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY event_type")
def a14(spark, d):
    return R.profile(table(spark, d, "events"), ["event_type"], "value")


@query("a15_percentiles", "SELECT event_type, round(quantile_cont(value, 0.8), 5) AS p80, round(quantile_cont(value, 0.95), 5) AS p95 FROM events GROUP BY event_type")
def a15(spark, d):
    parts = [R.exact_percentile(table(spark, d, "events"), ["event_type"], "value", q).select("event_type", F.round("percentile", 5).alias(n)) for n, q in (("p80", 0.8), ("p95", 0.95))]
    return parts[0].join(parts[1], "event_type")


@query("a16_pivot", f"WITH {SLOW} SELECT instance, count(*) FILTER (kind = 'SELECT') AS \"SELECT\", count(*) FILTER (kind = 'UPDATE') AS \"UPDATE\", count(*) FILTER (kind = 'INSERT') AS \"INSERT\" FROM slow GROUP BY instance")
def a16(spark, d):
    return slow(spark, d).groupBy("instance").pivot("kind", ["SELECT", "UPDATE", "INSERT"]).agg(F.count(F.lit(1))).na.fill(0)


@query("a17_top_sums", "SELECT l_suppkey, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY l_suppkey ORDER BY total DESC, l_suppkey LIMIT 10")
def a17(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("total")).orderBy(F.col("total").desc(), "l_suppkey").limit(10)


@query("a18_full_key", f"WITH {SLOW} SELECT instance, db, kind, count(*) AS n FROM slow GROUP BY ALL")
def a18(spark, d):
    return slow(spark, d).groupBy("instance", "db", "kind").agg(_n())


@query("a19_split_part", "SELECT split_part(p_type, ' ', 1) AS family, count(*) AS n FROM part GROUP BY 1")
def a19(spark, d):
    return table(spark, d, "part").groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("family")).agg(_n())


@query("a20_representative", f"WITH {SLOW}, r AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY duration DESC, id) AS k, count(*) OVER (PARTITION BY template) AS n FROM slow) SELECT template, id, duration, n FROM r WHERE k = 1")
def a20(spark, d):
    s = R.with_counts(slow(spark, d), "template")
    return R.top_in_group(s, ["template"], [F.col("duration").desc(), F.col("id")], 1).select("template", "id", "duration", "n")


@query("a22_cause_titles", """WITH t AS (SELECT o_orderkey % 8 AS instance, '1. ' || CASE WHEN o_orderkey % 3 = 0 THEN 'LOCK_CONTENTION' ELSE 'LARGE_SORT' END || ': (x) 2. DISK_SPILL: (y)' AS root_cause FROM orders),
 e AS (SELECT instance, unnest(regexp_extract_all(root_cause, '\\d{1,2}\\. ([A-Z_]+): \\(', 1)) AS title FROM t) SELECT instance, title, count(*) AS n FROM e GROUP BY ALL""")
def a22(spark, d):
    cause = F.concat(F.lit("1. "), F.when(F.col("o_orderkey") % 3 == 0, "LOCK_CONTENTION").otherwise("LARGE_SORT"), F.lit(": (x) 2. DISK_SPILL: (y)"))
    t = table(spark, d, "orders").select((F.col("o_orderkey") % 8).alias("instance"), F.explode(F.regexp_extract_all(cause, F.lit(r"\d{1,2}\. ([A-Z_]+): \("), F.lit(1))).alias("title"))
    return t.groupBy("instance", "title").agg(_n())


@query("a23_daily_rollup", """WITH p AS (SELECT event_type, epoch_us(ts) // 1000 // 86400000 AS day, round(avg(value), 4) AS v FROM events GROUP BY ALL) SELECT event_type, string_agg(v, ',' ORDER BY day) AS days FROM (SELECT event_type, day, CAST(CAST(floor(v * 10 + 0.25) AS BIGINT) AS VARCHAR) AS v FROM p) GROUP BY event_type""")
def a23(spark, d):
    p = table(spark, d, "events").groupBy("event_type", F.floor(epoch_ms("ts") / 86_400_000).alias("day")).agg(F.round(F.avg("value"), 4).alias("v"))
    listed = F.array_sort(F.collect_list(F.struct("day", F.floor(F.col("v") * 10 + 0.25).cast("long").cast("string").alias("v"))))
    return p.groupBy("event_type").agg(F.array_join(F.transform(listed, lambda s: s["v"]), ",").alias("days"))


@query("a24_growth", "WITH g AS (SELECT l_partkey, max(l_extendedprice) - min(l_extendedprice) AS growth FROM lineitem GROUP BY l_partkey) SELECT l_partkey, round(growth, 2) AS growth FROM g ORDER BY growth DESC, l_partkey LIMIT 10")
def a24(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey").agg((F.max("l_extendedprice") - F.min("l_extendedprice")).alias("growth"))
    return g.orderBy(F.col("growth").desc(), "l_partkey").limit(10).withColumn("growth", F.round("growth", 2))


@query("a26_workload_totals", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS total, CAST(sum(l_linenumber) FILTER (l_returnflag = 'A') AS BIGINT) AS positive, CAST(sum(l_linenumber) FILTER (l_returnflag = 'R') AS BIGINT) AS negative FROM lineitem")
def a26(spark, d):
    n = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_linenumber")))
    return table(spark, d, "lineitem").agg(F.sum("l_linenumber").alias("total"), n("A").alias("positive"), n("R").alias("negative"))


@query("a27_benefit", f"WITH {SLOW}, c AS (SELECT instance AS config, sum(duration) AS cost FROM slow GROUP BY 1) SELECT config, round(cost, 2) AS cost, round((SELECT cost FROM c WHERE config = 0) - cost, 2) AS benefit FROM c")
def a27(spark, d):
    c = slow(spark, d).groupBy(F.col("instance").alias("config")).agg(F.sum("duration").alias("cost"))
    origin = c.where("config = 0").select(F.col("cost").alias("_origin"))
    return c.crossJoin(F.broadcast(origin)).select("config", F.round("cost", 2).alias("cost"), F.round(F.col("_origin") - F.col("cost"), 2).alias("benefit"))


@query("a28_folds", "WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT i, round(sum(value), 4) AS value FROM e WHERE i <= (SELECT min(n) FROM e) GROUP BY i")
def a28(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type")
    e = table(spark, d, "events").select("event_type", "value", F.row_number().over(w.orderBy("ts", "event_id")).cast("long").alias("i"))
    shortest = e.groupBy("event_type").agg(_n()).agg(F.min("n").alias("_least"))
    return e.join(F.broadcast(shortest), F.col("i") <= F.col("_least")).groupBy("i").agg(F.round(F.sum("value"), 4).alias("value"))


@query("a30_upsert", f"WITH {SLOW} SELECT id, min(id) OVER (PARTITION BY template, db) AS statement_id FROM slow")
def a30(spark, d):
    _, journal = R.upsert(slow(spark, d), ["template", "db"], "id")
    return journal.select("id", "statement_id")


# --- sorts and sets ------------------------------------------------------------------------------


@query("o01_top_statements", f"WITH {SLOW}, g AS (SELECT template, count(*) AS calls, avg(duration) AS mean FROM slow GROUP BY template ORDER BY calls DESC, mean DESC, template LIMIT 50) SELECT template, calls, round(mean, 4) AS mean FROM g")
def o01(spark, d):
    g = slow(spark, d).groupBy("template").agg(_n("calls"), F.avg("duration").alias("mean"))
    return g.orderBy(F.col("calls").desc(), F.col("mean").desc(), "template").limit(50).withColumn("mean", F.round("mean", 4))


@query("o03_top_sessions", f"WITH {SLOW} SELECT id, duration FROM slow ORDER BY duration DESC, id LIMIT 20")
def o03(spark, d):
    return slow(spark, d).select("id", "duration").orderBy(F.col("duration").desc(), "id").limit(20)


@query("o06_cheapest", "WITH r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k FROM part) SELECT p_brand, p_partkey, p_retailprice FROM r WHERE k <= 3")
def o06(spark, d):
    return R.top_in_group(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.col("p_retailprice"), F.col("p_partkey")], 3)


@query("o08_samples", f"WITH {SLOW}, r AS (SELECT template, id, row_number() OVER (PARTITION BY template ORDER BY md5(CAST(id AS VARCHAR))) AS k FROM slow) SELECT template, id FROM r WHERE k <= 5")
def o08(spark, d):
    return R.top_in_group(slow(spark, d).select("template", "id"), ["template"], [F.md5(F.col("id").cast("string"))], 5)


@query("u01_union_of_tops", f"WITH {SLOW} (SELECT id FROM slow ORDER BY duration DESC, id LIMIT 10) UNION (SELECT id FROM slow ORDER BY start_ms DESC, duration DESC, id LIMIT 10)")
def u01(spark, d):
    s = slow(spark, d)
    return s.orderBy(F.col("duration").desc(), "id").limit(10).select("id").union(s.orderBy(F.col("start_ms").desc(), F.col("duration").desc(), "id").limit(10).select("id")).distinct()


@query("u06_set_algebra", "SELECT p_partkey, len(list_filter(['a', 'b', 'c'], lambda x: NOT list_contains(CASE WHEN p_size % 2 = 0 THEN ['a', 'd'] ELSE ['b', 'c'] END, x))) AS missing, list_has_any(['a'], CASE WHEN p_size % 2 = 0 THEN ['a', 'd'] ELSE ['b', 'c'] END) AS meets FROM part")
def u06(spark, d):
    lit = lambda *x: F.array(*map(F.lit, x))
    own = F.when(F.col("p_size") % 2 == 0, lit("a", "d")).otherwise(lit("b", "c"))
    return table(spark, d, "part").select("p_partkey", F.size(F.array_except(lit("a", "b", "c"), own)).cast("long").alias("missing"), F.arrays_overlap(lit("a"), own).alias("meets"))


@query("t10_alarm_merge", f"""WITH {SLOW}, a AS (SELECT instance, kind AS content, start_ms, start_ms + 3600000 AS end_ms FROM slow WHERE duration > 250000),
 r AS (SELECT *, max(end_ms) OVER (PARTITION BY instance, content ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a),
 g AS (SELECT *, sum(CASE WHEN start_ms <= reach + 86401000 THEN 0 ELSE 1 END) OVER (PARTITION BY instance, content ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS k FROM r)
 SELECT instance, content, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM g GROUP BY instance, content, k""")
def t10(spark, d):
    alarms = slow(spark, d).where("duration > 250000").select("instance", F.col("kind").alias("content"), "start_ms", (F.col("start_ms") + 3_600_000).alias("end_ms"))
    return R.merge_alarms(alarms, ["instance", "content"], 86_400_000)


@query("c28_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def c28(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
