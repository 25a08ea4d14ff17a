"""The metric query language: parsed to a tree, evaluated as DataFrames over a grid of times.

A vector is (labels map, ts_ms, value) with one row for each series and time of the grid.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.sources.series import LOOKBACK_MS, matches, series_key

_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<range>\[\w+\])|(?P<number>\d+\.?\d*(?:[eE][-+]?\d+)?)|(?P<op>=~|!~|!=|>=|<=|==|[-+*/(){},=<>])|(?P<name>[a-zA-Z_:][\w:]*))""")
_UNITS = {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
_FOLDS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}
_OVER = ("irate", "rate", "increase")
_BINDS = {">": 1, "<": 1, ">=": 1, "<=": 1, "==": 1, "!=": 1, "+": 2, "-": 2, "*": 3, "/": 3}


@dataclass(frozen=True)
class Node:
    kind: str
    args: tuple


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *wanted: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1] in wanted

    def take(self, *wanted: str) -> str:
        if self.at >= len(self.tokens) or wanted and self.tokens[self.at][1] not in wanted:
            raise ValueError(f"expected {wanted or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def parse(self) -> Node:
        out = self.binary(0)
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def binary(self, least: int) -> Node:
        left = self.unary()
        while self.at < len(self.tokens) and _BINDS.get(self.tokens[self.at][1], -1) > least:
            op = self.take()
            left = Node("binary", (op, left, self.binary(_BINDS[op])))
        return left

    def labels(self) -> tuple[str, ...]:
        self.take("(")
        out = []
        while not self.peek(")"):
            out.append(self.take())
            if self.peek(","):
                self.take()
        self.take(")")
        return tuple(out)

    def unary(self) -> Node:
        if self.peek("("):
            self.take()
            out = self.binary(0)
            self.take(")")
            return out
        if self.at >= len(self.tokens):
            raise ValueError("the expression breaks off")
        kind, word = self.tokens[self.at]
        if kind == "number":
            self.take()
            return Node("number", (float(word),))
        if kind == "text":
            self.take()
            return Node("text", (word[1:-1],))
        if kind == "name" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] in ("(", "by") and word in (*_FOLDS, *_OVER, "topk", "ceil", "label_replace"):
            self.take()
            by: tuple[str, ...] | None = None
            if self.peek("by"):
                self.take()
                by = self.labels()
            self.take("(")
            args = []
            while not self.peek(")"):
                args.append(self.binary(0))
                if self.peek(","):
                    self.take()
            self.take(")")
            if self.peek("by"):
                self.take()
                by = self.labels()
            return Node("call", (word, tuple(args), by or ()))
        name = self.take() if kind == "name" else None
        matchers = []
        if self.peek("{"):
            self.take()
            while not self.peek("}"):
                label, op, value = self.take(), self.take("=", "!=", "=~", "!~"), self.take()
                matchers.append((label, op, value[1:-1]))
                if self.peek(","):
                    self.take()
            self.take("}")
        span = None
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "range":
            text = self.take()[1:-1]
            span = sum(int(n) * _UNITS[u] for n, u in re.findall(r"(\d+)([smhd])", text))
        return Node("selector", (name, tuple(matchers), span))


class Evaluator:
    def __init__(self, samples: DataFrame, start: int, end: int, step: int):
        self.samples, self.start, self.end, self.step = samples, start, end, step

    def _at(self, first: Column, last: Column) -> Column:
        """The grid's times from ``first`` to ``last``."""
        low = F.ceil(F.greatest(first - self.start, F.lit(0)) / self.step) * self.step + self.start
        high = F.least(last, F.lit(self.end))
        return F.when(low <= high, F.sequence(low, high, F.lit(self.step).cast("long")))

    def _chosen(self, name, matchers, reach: int) -> DataFrame:
        df = self.samples.where(F.col("ts_ms").between(self.start - reach, self.end))
        if name:
            df = df.where(F.col("name") == name)
        for label, op, value in matchers:
            df = df.where(matches("labels", label, op, value) if label != "__name__" else F.col("name").rlike(f"^(?:{value})$"))
        return df.withColumn("_key", F.concat_ws("|", "name", series_key()))

    def selector(self, name, matchers, span) -> DataFrame:
        df = self._chosen(name, matchers, LOOKBACK_MS)
        after = F.lead("ts_ms").over(Window.partitionBy("_key").orderBy("ts_ms"))
        last = F.least(F.coalesce(after - 1, F.lit(self.end)), F.col("ts_ms") + LOOKBACK_MS)
        served = df.withColumn("_last", last).withColumn("_t", F.explode(self._at(F.col("ts_ms"), F.col("_last"))))
        return served.select("name", "labels", F.col("_t").alias("ts_ms"), "value")

    def over(self, how: str, selector: Node) -> DataFrame:
        """Functions of a range (t - span, t].

        A time is served by the last sample of its range, and by the first one. Growth is summed up along
        the series once, so what a range grew by is the difference of two sums, and each time costs two
        rows, however many samples its range holds. irate needs the last sample and the one before it.
        """
        name, matchers, span = selector.args
        if span is None:
            raise ValueError(f"{how} needs a range")
        w = Window.partitionBy("_key").orderBy("ts_ms")
        before = F.lag("value").over(w)
        growth = F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
        t = F.col("ts_ms")
        df = self._chosen(name, matchers, span).withColumns({"_grown": growth, "_prev": F.lag("ts_ms").over(w), "_until": F.coalesce(F.lead("ts_ms").over(w) - 1, F.lit(self.end))})
        if how == "irate":
            served = df.withColumn("_t", F.explode(self._at(t, F.least("_until", F.col("_prev") + span - 1))))
            return served.where("_prev is not null").select("labels", F.col("_t").alias("ts_ms"), (F.col("_grown") / ((t - F.col("_prev")) / 1000)).alias("value"))
        summed = df.withColumns({"_sum": F.sum("_grown").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_i": F.row_number().over(w)})
        last = summed.select("_key", "labels", F.explode(self._at(t, F.least("_until", t + span - 1))).alias("_t"), "_sum", "_i")
        first = summed.select("_key", "labels", F.explode(self._at(F.greatest(F.coalesce(F.col("_prev") + span, t), t), t + span - 1)).alias("_t"), (-F.col("_sum")).alias("_sum"), (-F.col("_i")).alias("_i"))
        grown = last.unionByName(first).groupBy("_key", "_t").agg(F.first("labels").alias("labels"), F.sum("_sum").alias("_sum"), F.sum("_i").alias("_more")).where("_more > 0")
        value = F.col("_sum") / (span / 1000) if how == "rate" else F.col("_sum")
        return grown.select("labels", F.col("_t").alias("ts_ms"), value.alias("value"))

    def vector(self, node: Node) -> DataFrame:
        if node.kind == "selector":
            return self.selector(*node.args).select("labels", "ts_ms", "value")
        if node.kind == "binary":
            return self.binary(*node.args)
        if node.kind != "call":
            raise ValueError("a vector is expected")
        name, args, by = node.args
        if name in _OVER:
            return self.over(name, args[0])
        if name in _FOLDS:
            if "__name__" in by and args[0].kind == "selector":
                inner = self.selector(*args[0].args).withColumn("labels", F.map_concat("labels", F.create_map(F.lit("__name__"), F.col("name"))))
            else:
                inner = self.vector(args[0])
            kept = F.map_filter("labels", lambda k, v: k.isin(*by)) if by else F.create_map().cast("map<string,string>")
            keyed = inner.withColumn("labels", kept).withColumn("_key", series_key())
            return keyed.groupBy("_key", "ts_ms").agg(F.first("labels").alias("labels"), _FOLDS[name]("value").cast("double").alias("value")).select("labels", "ts_ms", "value")
        if name == "topk":
            rank = F.row_number().over(Window.partitionBy("ts_ms").orderBy(F.col("value").desc(), series_key()))
            return self.vector(args[1]).withColumn("_r", rank).where(F.col("_r") <= int(args[0].args[0])).drop("_r")
        if name == "ceil":
            return self.vector(args[0]).withColumn("value", F.ceil("value").cast("double"))
        inner, target, template, source, pattern = self.vector(args[0]), *(a.args[0] for a in args[1:])
        text = F.coalesce(F.col("labels")[source], F.lit(""))
        whole = f"^(?:{pattern})$"
        new = F.map_concat(F.map_filter("labels", lambda k, v: k != target), F.create_map(F.lit(target), F.regexp_replace(text, whole, template)))
        return inner.withColumn("labels", F.when(text.rlike(whole), new).otherwise(F.col("labels")))

    def binary(self, op: str, left: Node, right: Node) -> DataFrame:
        def apply(a: Column, b: Column) -> Column:
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / F.nullif(b, F.lit(0.0)), ">": lambda: a > b, "<": lambda: a < b, ">=": lambda: a >= b, "<=": lambda: a <= b, "==": lambda: a == b, "!=": lambda: a != b}[op]()

        numbers = left.kind == "number", right.kind == "number"
        if all(numbers):
            raise ValueError("two numbers make no vector")
        if any(numbers):
            df = self.vector(right if numbers[0] else left)
            a, b = (F.lit(left.args[0]), F.col("value")) if numbers[0] else (F.col("value"), F.lit(right.args[0]))
            return df.where(apply(a, b)) if _BINDS[op] == 1 else df.withColumn("value", apply(a, b)).where("value is not null")
        l, r = self.vector(left).withColumn("_key", series_key()), self.vector(right).select(series_key().alias("_key"), "ts_ms", F.col("value").alias("_right"))
        both = l.join(r, ["_key", "ts_ms"])
        if _BINDS[op] == 1:
            return both.where(apply(F.col("value"), F.col("_right"))).select("labels", "ts_ms", "value")
        return both.select("labels", "ts_ms", apply(F.col("value"), F.col("_right")).alias("value")).where("value is not null")


def evaluate(samples: DataFrame, text: str, start: int, end: int | None = None, step: int = 60_000) -> DataFrame:
    """(labels, ts_ms, value) of an expression at start, start + step, ... end; at ``start`` alone without an end."""
    return Evaluator(samples, start, start if end is None else end, step).vector(Parser(text).parse())


# --- derived metrics -----------------------------------------------------------------------------

#: Expressions on hosts; their instance label loses its port. {db} stands for the prefix that the product gives its own metrics.
# fmt: off
HOST = {
    "os_cpu_iowait_usage": "sum(irate(node_cpu_seconds_total{mode='iowait'}[3m])) by (job, instance) / sum(irate(node_cpu_seconds_total[3m])) by (job, instance)",
    "os_cpu_system_usage": "sum(irate(node_cpu_seconds_total{mode='system'}[3m])) by (job, instance) / sum(irate(node_cpu_seconds_total[3m])) by (job, instance)",
    "os_cpu_user_usage": "sum(irate(node_cpu_seconds_total{mode='user'}[3m])) by (job, instance) / sum(irate(node_cpu_seconds_total[3m])) by (job, instance)",
    "os_cpu_idle_usage": "sum(irate(node_cpu_seconds_total{mode='idle'}[3m])) by (job, instance) / sum(irate(node_cpu_seconds_total[3m])) by (job, instance)",
    "os_disk_iops": "irate(node_disk_reads_completed_total[3m]) + irate(node_disk_writes_completed_total[3m])",
    "os_disk_ioutils": "irate(node_disk_io_time_seconds_total[3m])",
    "os_disk_io_read_bytes": "irate(node_disk_read_bytes_total[3m]) / 1024 / 1024",
    "os_disk_io_write_bytes": "irate(node_disk_written_bytes_total[3m]) / 1024 / 1024",
    "os_disk_iocapacity": "(irate(node_disk_read_bytes_total[3m]) / 1024 / 1024) + (irate(node_disk_written_bytes_total[3m]) / 1024 / 1024)",
    "os_disk_usage": "1 - ((node_filesystem_avail_bytes{fstype=~'ext.|xfs'}) / node_filesystem_size_bytes{fstype=~'ext.|xfs'})",
    "os_disk_io_queue_length": "irate(node_disk_io_time_weighted_seconds_total[3m])",
    "os_disk_io_read_delay": "irate(node_disk_read_time_seconds_total[3m]) / (irate(node_disk_reads_completed_total[3m]) + 0.00001) * 1000",
    "os_disk_io_write_delay": "irate(node_disk_write_time_seconds_total[3m]) / (irate(node_disk_writes_completed_total[3m]) + 0.00001) * 1000",
    "os_cpu_processor_number": "count by (instance, job) (node_cpu_seconds_total{mode='user'})",
    "{db}_cpu_usage": "irate(pg_cpu_load_total_cpu[3m])",
    "os_mem_usage": "1 - avg(node_memory_MemAvailable_bytes / node_memory_MemTotal_bytes) by (job, instance)",
    "load_average1": "node_load1",
    "os_network_receive_error": "irate(node_network_receive_errs_total{device!~'bond.*?|lo'}[3m]) / (irate(node_network_receive_packets_total{device!~'bond.*?|lo'}[3m]) > 0)",
    "os_network_transmit_error": "irate(node_network_transmit_errs_total{device!~'bond.*?|lo'}[3m]) / (irate(node_network_transmit_packets_total{device!~'bond.*?|lo'}[3m]) > 0)",
    "os_network_transmit_drop": "irate(node_network_transmit_drop_total{device!~'bond.*?|lo'}[3m]) / (irate(node_network_transmit_packets_total{device!~'bond.*?|lo'}[3m]) > 0)",
    "os_network_receive_drop": "irate(node_network_receive_drop_total{device!~'bond.*?|lo'}[3m]) / (irate(node_network_receive_packets_total{device!~'bond.*?|lo'}[3m]) > 0)",
    "os_network_receive_bytes": "irate(node_network_receive_bytes_total{device!~'bond.*?|lo'}[3m]) / 1024 / 1024 > 0",
    "os_network_transmit_bytes": "irate(node_network_transmit_bytes_total{device!~'bond.*?|lo'}[3m]) / 1024 / 1024 > 0",
    "os_process_fds_rate": "process_open_fds / process_max_fds",
}
#: Expressions on databases.
DATABASE = {
    "qps": "ceil(sum(irate(pg_sql_count_dcl[3m])) by (job, from_instance) + sum(irate(pg_sql_count_dml[3m])) by (job, from_instance) + sum(irate(pg_sql_count_ddl[3m])) by (job, from_instance))",
    "{db}_qps_by_instance": "ceil(sum(irate(pg_db_xact_commit[3m])) by (job, from_instance) + sum(irate(pg_db_xact_rollback[3m])) by (job, from_instance))",
    "{db}_errors_rate": "sum(increase({db}_errors_total[3m])) by (from_instance, job)",
    "{db}_invalid_logins_rate": "sum(increase({db}_invalid_logins_total[3m])) by (from_instance, job)",
    "{db}_tup_fetched_rate": "sum(irate(pg_db_tup_fetched[3m])) by (datname, job, from_instance)",
    "{db}_tup_deleted_rate": "sum(irate(pg_db_tup_deleted[3m])) by (datname, job, from_instance)",
    "{db}_tup_inserted_rate": "sum(irate(pg_db_tup_inserted[3m])) by (datname, job, from_instance)",
    "{db}_tup_updated_rate": "sum(irate(pg_db_tup_updated[3m])) by (datname, job, from_instance)",
    "{db}_blks_read_rate": "sum(irate(pg_db_blks_read[3m])) by (datname, job, from_instance)",
    "{db}_blks_hit_ratio": "sum(irate(pg_db_blks_access[3m])) by (datname, job, from_instance)",
    "{db}_conflicts_rate": "sum(irate(pg_db_conflicts[3m])) by (datname, job, from_instance)",
    "{db}_confl_lock_rate": "sum(irate(pg_db_confl_lock[3m])) by (datname, job, from_instance)",
    "{db}_confl_snapshot_rate": "sum(irate(pg_db_confl_snapshot[3m])) by (datname, job, from_instance)",
    "{db}_confl_bufferpin_rate": "sum(irate(pg_db_confl_bufferpin[3m])) by (datname, job, from_instance)",
    "{db}_confl_deadlock_rate": "sum(irate(pg_db_confl_deadlock[3m])) by (datname, job, from_instance)",
    "{db}_deadlocks_rate": "sum(irate(pg_db_deadlocks[3m])) by (datname, job, from_instance)",
    "{db}_confl_temp_files_rate": "sum(irate(pg_db_temp_files[3m])) by (datname, job, from_instance)",
    "{db}_confl_temp_bytes_rate": "sum(irate(pg_db_temp_bytes[3m])) by (datname, job, from_instance)",
    "{db}_table_expansion_rate": "topk(10, sum(pg_tables_expansion_rate_dead_rate) by (from_instance, job))",
    "{db}_cpu_time": "sum(irate(pg_cpu_load_total_cpu[3m])) by (from_instance, job)",
    "{db}_state_memory": "sum(pg_state_memory_totalsize{state='active'}) by (from_instance, job)",
    "{db}_connections_used_ratio": "sum(pg_connections_used_conn / pg_connections_max_conn) by (from_instance, job)",
    "pg_database_all_size": "sum(pg_database_size_bytes) by (job, from_instance)",
    "{db}_dead_tup_increase_rate": "topk(10, sum(irate(pg_tables_structure_n_dead_tup[2m])) by (datname, relname, schemaname, from_instance, job))",
    "{db}_table_increase_amplitude": "topk(10, sum(increase(pg_tables_size_totalsize[2m])) by (datname, nspname, relname, from_instance, job))",
    "{db}_table_increase_rate": "topk(10, sum(irate(pg_tables_size_totalsize[2m])) by (datname, nspname, relname, from_instance, job))",
    "{db}_index_increase_rate": "topk(10, sum(irate(pg_index_mbytes[2m])) by (relname, nspname, tablename, from_instance, job))",
    "{db}_database_increase_rate": "topk(10, sum(irate(pg_database_size_bytes[2m])) by (datname, from_instance, job))",
    "{db}_database_increase_amplitude": "topk(10, sum(increase(pg_database_size_bytes[2m])) by (datname, from_instance, job))",
    "{db}_corrosion_index": "topk(10, sum(rate(pg_index_idx_scan{isdisvalid='False'}[3m])) by (schema_name, table_name, index_name, from_instance, job))",
    "{db}_wait_event_spike": "sum(irate(pg_wait_events_total_wait_time[2m])) by (type, event, nodename, from_instance, job)",
    "{db}_statement_db_time": "sum(irate(pg_sql_statement_statistics_avg_db_time[2m])) by (node_name, query, from_instance, job)",
    "{db}_statement_calls": "sum(irate(pg_sql_statement_statistics_n_calls[2m])) by (node_name, query, from_instance, job)",
    "{db}_statement_sort_spill": "sum(irate(pg_sql_statement_statistics_sort_spill_count[2m])) by (node_name, query, from_instance, job)",
    "{db}_statement_hash_spill": "sum(irate(pg_sql_statement_statistics_hash_spill_count[2m])) by (node_name, query, from_instance, job)",
    "{db}_state_time": "irate(pg_time_value[3m])",
    "{db}_active_connection": "sum(pg_stat_activity_count{state='active'}) by (job, from_instance)",
    "{db}_idle_connection": "sum(pg_stat_activity_count{state=~'idle.*'}) by (job, from_instance)",
    "{db}_total_connection": "sum(pg_stat_activity_count) by (job, from_instance)",
}
# fmt: on
#: For each metric of data leaks and each time unit.
LEAK = "sum(increase({0}[{1}])) by (from_instance, job)"
LEAK_UNITS = ("1m", "10m", "60m", "24h")



def derived(db: str = "db") -> dict[str, str]:
    """Names and expressions of all derived metrics, for a product whose own metrics begin with ``db``."""
    texts = {name: f"label_replace({text}, 'instance', '$1', 'instance', '(.*):.*')" for name, text in HOST.items()} | DATABASE
    return {name.replace("{db}", db): text.replace("{db}", db) for name, text in texts.items()}


DERIVED = derived()


def families(samples: DataFrame, prefix: str = "") -> DataFrame:
    """(name, unit, metric): the metrics whose name begins with ``prefix``, and the metric derived from them for each time unit.

    Without a prefix all metrics; one without a name is derived into null.
    """
    chosen = samples.where(F.col("name").startswith(prefix)) if prefix else samples
    units = chosen.select("name").distinct().withColumn("unit", F.explode(F.array(*map(F.lit, LEAK_UNITS))))
    return units.withColumn("metric", F.concat("name", F.lit("_"), "unit"))


def leak_metrics(samples: DataFrame, prefix: str) -> dict[str, str]:
    """Expressions for the metrics whose name begins with ``prefix``, for each time unit."""
    found = families(samples, prefix).where("name is not null").orderBy("name", "unit").collect()
    return {r["metric"]: LEAK.format(r["name"], r["unit"]) for r in found}


def derive(samples: DataFrame, names: list[str], start: int, end: int | None = None, step: int = 60_000) -> DataFrame:
    """(name, labels, ts_ms, value): derived metrics as samples again."""
    out = None
    for name in names:
        one = evaluate(samples, DERIVED[name], start, end, step).select(F.lit(name).alias("name"), "labels", "ts_ms", "value")
        out = one if out is None else out.unionByName(one)
    return out
