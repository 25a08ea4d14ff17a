"""Configuration advice as projections over one row of metrics for each instance.

Columns: os_mem_total and sizes in kB, instances, block_size, database_size, temp_file_size, max_connections,
current_connections, load1, cores, work_mem, is_64bit, is_hdd, io_concurrency, wal_buffers, prepared,
nestloop, mergejoin, hashjoin ('on'/'off'), fetch_return, rollback_commit, search_modify, read_write,
cache_hit, checkpoint_proactive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kB in a megabyte and a gigabyte.
MB, GB = 1024, 1024 * 1024
#: Fixed values: (metric, votes as (bound, points), whether small or large values count).
VOTES = (
    ("fetch_return", ((0.01, 2.0), (0.1, 1.0), (0.5, 0.5)), "small"),
    ("rollback_commit", ((0.01, 2.5), (0.02, 2.0), (0.03, 1.5), (0.04, 1.0), (0.05, 0.5)), "small"),
    ("search_modify", ((1e5, 2.0), (1e4, 1.5), (1e3, 1.0)), "large"),
    ("read_write", ((1e5, 1.5), (1e4, 1.0), (1e2, 0.5)), "large"),
    ("checkpoint_proactive", ((0.1, 0.5), (0.3, 0.2)), "small"),
)


#: What workload_ratios() adds.
RATIOS = ("cache_hit", "read_write", "search_modify", "fetch_return", "rollback_commit", "temp_file_size", "checkpoint_proactive", "insert_share", "update_share", "delete_share")


def workload_ratios(counters: DataFrame) -> DataFrame:
    """Adds RATIOS to summed counters; a ratio without a divisor is NULL, and sizes are in kB."""
    c = F.col
    modified = c("tup_inserted") + c("tup_updated") + c("tup_deleted")
    over = lambda a, b: a / F.nullif(b, F.lit(0))
    return counters.withColumns(
        {
            "cache_hit": over(c("blks_hit"), c("blks_hit") + c("blks_read")),
            "read_write": over(c("tup_fetched"), modified),
            "search_modify": over(c("tup_returned"), modified),
            "fetch_return": over(c("tup_fetched"), c("tup_returned")),
            "rollback_commit": over(c("xact_rollback"), c("xact_commit")),
            "temp_file_size": c("temp_bytes") / 1024,
            "checkpoint_proactive": over(c("checkpoints_timed"), c("checkpoints_timed") + c("checkpoints_req")),
            "insert_share": over(c("tup_inserted"), modified),
            "update_share": over(c("tup_updated"), modified),
            "delete_share": over(c("tup_deleted"), modified),
        }
    )


def _steps(value: Column, bounds, direction: str, otherwise: Column) -> Column:
    out = otherwise
    for bound, points in reversed(bounds):
        out = F.when(value <= bound if direction == "small" else value >= bound, F.lit(float(points))).otherwise(out)
    return out


def ap_index(df: DataFrame) -> DataFrame:
    """Adds ``ap_index`` (0 to 10) by votes, and ``workload``: ap above 6, tp up to 3, else htap."""
    parts = [
        _steps(F.col(name), bounds, direction, F.col("search_modify") / 100 if name == "search_modify" else F.lit(0.0))
        for name, bounds, direction in VOTES
    ]
    parts += [F.when(F.col("temp_file_size") > 0, 1.0).otherwise(0.0), F.when(F.col("cache_hit") < 0.9, 0.5).otherwise(0.0)]
    scored = df.withColumn("ap_index", reduce(lambda a, b: a + b, parts))
    return scored.withColumn("workload", F.when(F.col("ap_index") > 6, "ap").when(F.col("ap_index") <= 3, "tp").otherwise("htap"))


def _clip(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def recommend(df: DataFrame) -> DataFrame:
    """Adds a column for each knob; NULL where nothing is recommended. The limits and factors are fixed values."""
    tp = F.col("workload") == "tp"
    out = ap_index(df)
    out = out.withColumn("max_process_memory", F.round(F.col("os_mem_total") * 0.8 / F.col("instances"), 4))
    mem, block = F.col("max_process_memory"), F.col("block_size")
    share = F.when(mem < GB, 0.15).when(mem > 8 * GB, 0.4).otherwise(0.25)
    wanted = F.round(share * mem / block, 4)
    out = out.withColumn(
        "shared_buffers", F.when(F.col("is_64bit"), F.round(F.least(F.col("database_size") / block, wanted), 4)).otherwise(wanted)
    )
    crowded = F.col("current_connections") / F.col("max_connections") > 0.7
    grown = F.col("max_connections") * F.when(~crowded | (F.col("load1") > 3), 1).when(F.col("load1") > 1, 2).otherwise(3)
    for_tp = _clip(grown, F.greatest(F.lit(200), F.col("cores") * 5), F.greatest(F.lit(400), F.col("cores") * 12))
    rest = mem * F.when(mem > 16 * GB, 0.85).when(mem > 8 * GB, 0.75).when(mem < 4 * GB, 0.6).otherwise(0.7) - F.col("shared_buffers")
    for_others = F.greatest(rest / (F.greatest("work_mem", F.col("temp_file_size") * 4) + 0.01), F.greatest(F.lit(200), F.col("cores") * 3))
    out = out.withColumn("connections", F.when(tp, for_tp.cast("double")).otherwise(for_others))
    conn, free = F.col("connections"), mem - F.col("shared_buffers")
    out = out.withColumn("work_memory", F.when(F.col("temp_file_size") < 16 * MB, F.lit(None)).when(tp & (conn > 500), F.lit(None)).when(tp, free / (conn * 2)).otherwise(free / conn))
    buffers = F.col("shared_buffers")
    big = F.col("wal_buffers") >= 16 * MB / block
    ratio = F.col("fetch_return")
    ap_target = (
        F.when(F.col("search_modify") > 20, 1000).when(F.col("search_modify") < 2, 50).when(ratio > 0.0005, 200).when(ratio > 0.0004, 250)
        .when(ratio > 0.0003, 350).when(ratio > 0.0002, 500).when(ratio > 0.0001, 600).otherwise(800)
    )
    tp_target = F.when(F.col("read_write") < 0.5, 10).when(F.col("read_write") < 1, 50).when(F.col("read_write") < 2, 80).otherwise(100)
    return out.withColumns(
        {
            "prepared_transactions": F.when((F.col("prepared") > 0) & (F.col("prepared") < conn), conn),
            "maintenance_work_mem": F.col("work_memory") * 10,
            "effective_cache_size": F.when(tp, buffers).otherwise(F.greatest(mem * 0.75, buffers)),
            "effective_io_concurrency": F.when(~F.col("is_hdd"), 200).when(~F.col("io_concurrency").between(0, 2), 2),
            "wal_buffer": F.when(F.col("wal_buffers") == -1, F.lit(None)).when(big, buffers / 32).when(F.col("wal_buffers") < buffers / 64, F.lit(-1.0)),
            "random_page_cost": F.when(F.col("is_hdd"), 3).otherwise(1),
            "statistics_target": F.when(F.col("workload") == "ap", ap_target).when(tp, tp_target).otherwise(100),
            "enable_nestloop": F.when(~tp & (F.col("nestloop") == "on"), 0),
            "enable_mergejoin": F.when(~tp & (F.col("mergejoin") == "on"), 0),
            "enable_hashjoin": F.when(F.col("hashjoin") == "off", 1),
        }
    )


def warnings(df: DataFrame) -> DataFrame:
    """Adds ``notes``: what is worth saying about an instance's settings."""
    notes = F.array_compact(
        F.array(
            F.when(F.col("current_connections") / F.col("max_connections") > 0.7, "connections: over 70% in use"),
            F.when(F.col("cores") <= 8, "cores: few for high concurrency"),
            F.when(F.col("prepared") == 0, "prepared transactions: two-phase commit is off"),
            F.when(F.col("hashjoin") == "off", "hash join: switched off"),
        )
    )
    return df.withColumn("notes", notes)
