"""Causes of slow statements: their context gathered from prepared tables, and a feature for each cause."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import sqltext as Q
from tidewatch.sources.store import shuffled

#: Limits of the rules, by name.
LIMITS = {
    "tuple_number": 1000, "table_total_size": 50, "fetch_tuples": 1000, "returned_rows": 1000, "updated_tuples": 1000, "deleted_tuples": 1000, "inserted_tuples": 1000,
    "dead_rate": 0.02, "index_number": 3, "nestloop_rows": 10000, "large_join": 50000, "cost_rate": 0.02, "plan_height": 10, "complex_operator": 2, "large_in_list": 50,
    "tuples_diff": 1000, "plan_time_rate": 0.6, "sort_rate": 0.7, "analyze_interval_s": 6, "connection_usage": 0.9, "cpu_usage": 0.6, "db_memory_rate": 0.8, "disk_ioutils": 0.7,
    "disk_usage": 0.7, "handler_occupation": 0.7, "mem_usage": 0.6, "network_bandwidth_usage": 0.8, "other_used_memory": 5120, "package_drop_rate": 0.01, "thread_pool_usage": 0.95,
    "tps_per_connection": 10,
}

#: The features in the order of a feature vector.
FEATURES = (
    "lock_contention", "many_dead_tuples", "heavy_scan_operator", "abnormal_plan_time", "unused_and_redundant_index", "update_large_data", "insert_large_data", "delete_large_data",
    "too_many_index", "disk_spill", "vacuum_event", "analyze_event", "workload_contention", "cpu_resource_contention", "io_resource_contention", "memory_resource_contention",
    "abnormal_network_status", "os_resource_contention", "database_wait_event", "lack_of_statistics", "missing_index", "poor_join_performance", "complex_boolean_expression",
    "string_matching", "complex_execution_plan", "correlated_subquery", "poor_aggregation_performance", "abnormal_sql_structure", "timed_task_conflict",
)


# --- context -------------------------------------------------------------------------------------


def statement_tables(statements: DataFrame) -> DataFrame:
    """(id, table_name): the tables that a statement's text names."""
    named = F.regexp_extract_all(F.lower("query"), F.lit(r"\b(?:from|join|update|into)\s+([a-z_][a-z0-9_.]*)"), F.lit(1))
    return statements.select("id", F.explode(F.array_distinct(named)).alias("table_name"))


def table_facts(statements: DataFrame, tables: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """(id, known_tables, large, bloated, bloated_scan, most_indexes, vacuums, analyzes, changed): what is known of a statement's tables.

    ``tables`` has (db, table_name, live_tuples, dead_tuples, dead_rate, size_mb, indexes, vacuum_ms,
    analyze_ms, changed_delay, tuples_diff). A table without plan is bloated if it is large and has
    many dead tuples; with a plan any scanned table with many dead tuples counts beside a large one.
    """
    t, at = F.col, limits
    many = t("live_tuples") + t("dead_tuples")
    large = (many >= at["tuple_number"]) | (t("size_mb") >= at["table_total_size"])
    above = (many > at["tuple_number"]) | (t("size_mb") > at["table_total_size"])
    dead = t("dead_rate") >= at["dead_rate"]
    scanned = F.coalesce(F.array_contains(F.regexp_extract_all("plan", F.lit(r"Scan(?: using \S+)? on (\w+)"), F.lit(1)), t("table_name")), F.lit(False))
    named = statement_tables(statements).join(shuffled(statements.select("id", "db", "plan")), "id").join(tables, ["db", "table_name"])
    return named.groupBy("id").agg(
        F.count(F.lit(1)).alias("known_tables"),
        F.bool_or(large).alias("large"),
        F.bool_or(above & dead).alias("bloated"),
        F.bool_or(scanned & dead).alias("bloated_scan"),
        F.max("indexes").alias("most_indexes"),
        F.collect_set("vacuum_ms").alias("vacuums"),
        F.collect_set("analyze_ms").alias("analyzes"),
        F.bool_or((t("changed_delay") != -1) & (t("tuples_diff") > at["tuples_diff"])).alias("changed"),
    )


def plan_facts(statements: DataFrame) -> DataFrame:
    """(id, updated, inserted, deleted, joins, height, groups, costed, rates of the costliest scan, sort, join and aggregate): a row for each plan."""
    planned = statements.where("plan is not null").select("id", "plan")
    tree = Q.own_cost(Q.plan_tree(Q.plan_nodes(planned, "id", "plan"), "id"), "id")
    name, whole = F.col("name"), F.max(F.when(F.col("parent").isNull(), F.col("total_cost")))
    sorted_below = tree.where("parent is not null").groupBy("id", F.col("parent").alias("node")).agg(F.bool_or(name == "Sort").alias("_sorted"))
    cost = lambda c: F.max(F.when(c, F.col("own_cost")))
    is_join = name.rlike("Nested Loop|Merge Join|Hash (Left |Right |Full |Anti |Semi |Right Semi )?Join")
    changed = lambda word: F.max(F.when(name.startswith(f"{word} on"), F.col("rows")))
    facts = tree.join(shuffled(sorted_below), ["id", "node"], "left").groupBy("id").agg(
        whole.alias("whole"),
        cost(name.rlike("(Seq|Index|Heap) Scan|Index Only Scan")).alias("scan"),
        cost(name.isin("Sort", "Hash")).alias("sort"),
        changed("Update").alias("updated"), changed("Insert").alias("inserted"), changed("Delete").alias("deleted"),
        F.count_if(name.rlike("Hash Join|Nested Loop|Merge Join")).alias("joins"), F.count_distinct("indent").alias("height"),
        cost(is_join).alias("join_cost"),
        cost(name.contains("GroupAggregate") & F.col("_sorted")).alias("group_cost"), cost(name.contains("HashAggregate")).alias("hash_cost"),
        F.bool_or(name.contains("GroupAggregate")).alias("groups"),
    )
    rate = lambda c: F.coalesce(F.when(F.col("whole") > 0, F.col(c) / F.col("whole")), F.lit(0.0))
    return facts.select(
        "id", "updated", "inserted", "deleted", "joins", "height", "groups", (F.col("whole") > 0).alias("costed"),
        *(rate(a).alias(b) for a, b in (("scan", "scan_rate"), ("sort", "sort_cost_rate"), ("join_cost", "join_rate"), ("group_cost", "group_rate"), ("hash_cost", "hash_rate"))),
    )


#: Statements of an instance and time bucket that one task asks at once; where there are more, its samples go to several tasks.
ASKED = 100_000


def _largest_between(times: np.ndarray, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest of the values at times from each start to each end, and whether there is one; ``times`` ascend, NaN is largest.

    A table has the largest of each 1, 2, 4, ... values that follow one another; a range is two entries of it that overlap.
    """
    first, last = np.searchsorted(times, start, "left"), np.searchsorted(times, end, "right")
    out, width, best = np.full(len(start), np.nan), last - first, values
    for power in range(max(int(width.max(initial=0)), 0).bit_length()):
        here, reach = (width >= 1 << power) & (width < 2 << power), 1 << power
        out[here] = np.maximum(best[first[here]], best[last[here] - reach])
        best = np.maximum(best[:-reach], best[reach:])
    return out, width > 0


def _largest_hosts(asked: pa.Table, told: pa.Table) -> pa.Table:
    """(id, host) of the asked statements that any of the samples meets."""
    start, end = (asked[c].to_numpy() for c in ("start_ms", "end_ms"))
    told = told.sort_by([("name", "ascending"), ("ts_ms", "ascending")])
    names, at = np.unique(told["name"].to_numpy(), return_index=True)
    times, values, ends = told["ts_ms"].to_numpy(), told["value"].to_numpy(), [*at[1:], told.num_rows]
    found, met = np.empty((len(start), len(names))), np.empty((len(start), len(names)), dtype=bool)
    for k, (a, b) in enumerate(zip(at, ends)):
        found[:, k], met[:, k] = _largest_between(times[a:b], values[a:b], start, end)
    rows = met.any(axis=1)
    offsets = np.concatenate(([0], np.cumsum(met[rows].sum(axis=1)))).astype(np.int32)
    keys = pa.array(names, pa.string()).take(pa.array(np.nonzero(met)[1]))
    hosts = pa.MapArray.from_arrays(offsets, keys, pa.array(found[met], pa.float64()))
    return pa.table({"id": asked["id"].filter(pa.array(rows)), "host": hosts})


def host_facts(statements: DataFrame, samples: DataFrame, bucket_ms: int = 3_600_000, asked_at_once: int = ASKED) -> DataFrame:
    """(id, name to its largest value while the statement ran) from ``samples`` (instance, name, ts_ms, value).

    Statements and samples are grouped on instance and time bucket. A group has the largest value of each name
    and time; what a statement asks of them is looked up, and not compared with each of them. NULL values count as no sample.
    """
    ends = F.col("start_ms") + F.col("duration_ms")
    buckets = F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor(ends / bucket_ms))
    asked = statements.where("id is not null").select("id", "instance", F.col("start_ms").cast("long").alias("start_ms"), ends.cast("long").alias("end_ms"), F.explode(buckets).alias("bucket"))
    told = samples.where("name is not null and value is not null").withColumn("bucket", F.floor(F.col("ts_ms") / bucket_ms))
    told = told.groupBy("instance", "bucket", "name", "ts_ms").agg(F.max(F.col("value").cast("double")).alias("value"))
    # A row for each group: where very many ask, they are dealt to several tasks, and the samples go to each.
    parts = asked.groupBy("instance", "bucket").agg(F.ceil(F.count(F.lit(1)) / asked_at_once).cast("int").alias("parts"))
    wanted = asked.join(shuffled(parts), ["instance", "bucket"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    dealt = told.join(shuffled(parts), ["instance", "bucket"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    by = lambda df, *columns: df.select("instance", "bucket", "part", *columns).groupBy("instance", "bucket", "part")
    hosts = by(wanted, "id", "start_ms", "end_ms").cogroup(by(dealt, "name", "ts_ms", "value")).applyInArrow(_largest_hosts, f"id {dict(asked.dtypes)['id']}, host map<string,double>")
    both = lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.greatest(x, y))
    each = hosts.groupBy("id").agg(F.collect_list("host").alias("_h"))
    return each.select("id", F.aggregate(F.slice("_h", F.lit(2), F.size("_h")), F.col("_h")[0], both).alias("host"))


def gather(statements: DataFrame, tables: DataFrame, samples: DataFrame, settings: DataFrame, advice: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """``statements`` with all that the features ask for; every part is joined by id or by instance.

    ``settings`` has (instance, name, setting double); ``advice`` has (id, recommended, unused, redundant,
    rewritten), booleans of what other operators found for a statement.
    """
    known = settings.groupBy("instance").agg(F.map_from_entries(F.collect_list(F.struct("name", "setting"))).alias("settings"))
    return (
        statements.join(shuffled(table_facts(statements, tables, limits)), "id", "left")
        .join(shuffled(plan_facts(statements)), "id", "left")
        .join(shuffled(host_facts(statements, samples)), "id", "left")
        .join(shuffled(advice), "id", "left")
        .join(known, "instance", "left")
    )


# --- features ------------------------------------------------------------------------------------


def longest_in_list(query: Column) -> Column:
    lists = F.regexp_extract_all(F.lower(query), F.lit(r"\bin\s*\(([^()]*)\)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(F.filter(lists, lambda x: ~F.trim(x).startswith("select")), lambda x: F.size(F.split(x, ",")))), F.lit(0))


def _matches(query: Column, plan: Column) -> Column:
    """LIKE with a wildcard, a function of a column in a comparison, or a random order; with a plan only what a scan's filter shows."""
    text = F.lower(query)
    likes = F.regexp_extract_all(text, F.lit(r"([\w.]+ like '[^']*%[^']*')"), F.lit(1))
    calls = F.regexp_extract_all(text, F.lit(r"(\w+\([\w., ]+\)) *(?:=|<|>|like)"), F.lit(1))
    filters = F.lower(F.array_join(F.regexp_extract_all(plan, F.lit(r"Seq Scan[^\n]*\n\s*Filter: ([^\n]*)"), F.lit(1)), ";"))
    shown = F.exists(F.concat(F.transform(likes, lambda x: F.replace(x, F.lit(" like "), F.lit(" ~~ "))), calls), lambda x: F.contains(filters, x))
    random = text.rlike(r"order\s+by\s+random\(\)") & plan.rlike(r"(?m)^\s*(->\s*)?Sort ")
    return F.when(plan.isNull(), (F.size(likes) > 0) | (F.size(calls) > 0)).otherwise(shown | random)


def features(context: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """Adds a 0/1 column for each of FEATURES and ``features array<int>``; a missing figure speaks against a cause.

    ``context`` is what gather() returns. Statement columns: id, instance, db, query, plan, start_ms,
    duration_ms, blocker, lock_wait, lwlock_wait, wait_event, hit_rate, fetched, returned,
    returned_rows, n_updated, n_inserted, n_deleted, plan_time, hard_parse, soft_parse, sort_spills, hash_spills.
    """
    c, at = F.col, limits
    text, no_plan = F.lower(F.ltrim(c("query"))), c("plan").isNull()
    host, setting = lambda n: c("host")[n], lambda n: c("settings")[n]
    usage = lambda n, limit: F.coalesce(host(n) >= at[limit], F.lit(False))

    def modified(counter: str, planned: str, limit: str) -> Column:
        return F.coalesce(c(counter) >= at[limit], F.lit(False)) | F.coalesce(~no_plan & (c(planned) > at[limit]), F.lit(False))

    updated, deleted = modified("n_updated", "updated", "updated_tuples"), modified("n_deleted", "deleted", "deleted_tuples")
    scanned = F.when(no_plan, (c("fetched") + c("returned") >= at["fetch_tuples"]) | (c("returned_rows") >= at["returned_rows"])).otherwise(c("scan_rate") >= at["cost_rate"])

    def near(times: str) -> Column:
        start, end, slack = c("start_ms"), c("start_ms") + c("duration_ms"), at["analyze_interval_s"] * 1000
        return F.exists(times, lambda t: t.between(start, end) | start.between(t, t + slack))

    pressed = [
        setting("process_used_memory") / F.nullif(setting("max_process_memory"), F.lit(0.0)) >= at["db_memory_rate"],
        setting("dynamic_used_memory") / F.nullif(setting("max_dynamic_memory"), F.lit(0.0)) >= at["db_memory_rate"],
        setting("other_used_memory") >= at["other_used_memory"],
        host("tps") >= setting("max_connections") * at["tps_per_connection"],
        usage("db_cpu", "cpu_usage"),
        usage("db_mem", "mem_usage"),
        usage("disk_usage", "disk_usage"),
        host("connections") / F.nullif(setting("max_connections"), F.lit(0.0)) >= at["connection_usage"],
        (setting("enable_thread_pool") > 0) & usage("thread_pool", "thread_pool_usage"),
    ]
    workload = pressed[0]
    for p in pressed[1:]:
        workload = F.coalesce(workload, F.lit(False)) | F.coalesce(p, F.lit(False))
    in_list = longest_in_list(c("query")) >= at["large_in_list"]
    rules = {
        "lock_contention": c("blocker").isNotNull() | (c("lock_wait") > 0) | (c("lwlock_wait") > 0),
        "many_dead_tuples": ~text.startswith("insert") & F.when(no_plan, c("bloated")).otherwise(c("bloated_scan") & c("large")),
        "heavy_scan_operator": ~updated & ~deleted & scanned,
        "abnormal_plan_time": (c("plan_time") / F.nullif(c("duration_ms"), F.lit(0)) >= at["plan_time_rate"]) & (c("hard_parse") > c("soft_parse")),
        "unused_and_redundant_index": c("large") & (c("unused") | c("redundant")) & ~text.startswith("select"),
        "update_large_data": updated,
        "insert_large_data": modified("n_inserted", "inserted", "inserted_tuples"),
        "delete_large_data": deleted,
        "too_many_index": ~text.startswith("select") & (c("most_indexes") >= at["index_number"]),
        "disk_spill": F.when(no_plan, (c("sort_spills") >= at["sort_rate"]) | (c("hash_spills") >= at["sort_rate"])).otherwise(
            (F.round("sort_cost_rate", 2) >= at["cost_rate"]) & ((c("sort_spills") > 0) | (c("hash_spills") > 0))
        ),
        "vacuum_event": near("vacuums"),
        "analyze_event": near("analyzes"),
        "workload_contention": workload,
        "cpu_resource_contention": usage("user_cpu", "cpu_usage"),
        "io_resource_contention": usage("io_utils", "disk_ioutils"),
        "memory_resource_contention": usage("system_mem", "mem_usage"),
        "abnormal_network_status": usage("receive_drop", "package_drop_rate") | usage("transmit_drop", "package_drop_rate") | usage("bandwidth", "network_bandwidth_usage"),
        "os_resource_contention": usage("process_fds", "handler_occupation"),
        "database_wait_event": c("wait_event").isNotNull(),
        "lack_of_statistics": c("changed"),
        "missing_index": c("recommended"),
        "poor_join_performance": ~no_plan & c("costed") & (c("join_rate") >= at["cost_rate"]),
        "complex_boolean_expression": in_list,
        "string_matching": _matches(c("query"), c("plan")),
        "complex_execution_plan": ~in_list & ~no_plan & ((c("joins") >= at["complex_operator"]) | (c("height") >= at["plan_height"])),
        "correlated_subquery": ~no_plan & c("plan").contains("SubPlan") & text.rlike(r"\(\s*select\b"),
        "poor_aggregation_performance": ~no_plan & c("costed") & ((c("group_rate") >= at["cost_rate"]) | (c("hash_rate") >= at["cost_rate"]) | (c("groups") & text.rlike(r"count\s*\(\s*distinct \w+"))),
        "abnormal_sql_structure": c("rewritten"),
        "timed_task_conflict": F.lit(False),
    }
    flagged = context.withColumns({n: F.coalesce(rules[n], F.lit(False)).cast("int") for n in FEATURES})
    return flagged.withColumn("features", F.array(*FEATURES))
