"""Operators over result tables: alarms, slow statements and their journal, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RISKS = {"fatal": 50, "risky": 40, "warning": 30, "notice": 20}


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """``df`` to be broadcast, once it is counted to have at most ``most`` rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return F.broadcast(df)


def select(df: DataFrame, columns: list[str] | None = None, equals: dict | None = None, isin: dict | None = None, since: tuple[str, object] | None = None, until: tuple[str, object] | None = None, contains: dict | None = None) -> DataFrame:
    """Optional predicates, each applied if given: equality, membership, time bounds, substring."""
    for c, v in (equals or {}).items():
        if v is not None:
            df = df.where(F.col(c) == v)
    for c, v in (isin or {}).items():
        if v is not None:
            df = df.where(F.col(c).isin(*v))
    if since:
        df = df.where(F.col(since[0]) >= since[1])
    if until:
        df = df.where(F.col(until[0]) <= until[1])
    for c, v in (contains or {}).items():
        if v is not None:
            df = df.where(F.col(c).contains(v))
    return df.select(*columns) if columns else df


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The rows of one page, counted from one."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def mean_or(df: DataFrame, column: str, name: str, factor: float = 1.0, default: float = -1.0) -> DataFrame:
    return df.agg(F.coalesce(F.avg(column) * factor, F.lit(default)).alias(name))


def with_counts(df: DataFrame, key: str) -> DataFrame:
    """Each row with how often its key occurs."""
    return df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key)


def newest_of(df: DataFrame, key: str, order: list[str], k: int | None = None) -> DataFrame:
    """Count and newest row for each key; the ``k`` most frequent if given."""
    latest = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*order)).alias("_newest"))
    out = latest.select(key, "n", "_newest.*")
    return out.orderBy(F.col("n").desc(), key).limit(k) if k else out


def top_in_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def exact_percentile(df: DataFrame, keys: list[str], column: str, q: float, parts: int = 100) -> DataFrame:
    """(keys, percentile): the value at rank q (n - 1) of each group, between two values in proportion; NULLs do not count, nor do groups with a NULL key.

    Approximate percentiles cut a group in ``parts``, and only the parts with the wanted ranks are sorted, as
    values with counts, so that no task gets a whole group. Reads the rows twice.
    """
    v = F.col(column).cast("double")
    known = df.select(*keys, v.alias("_v")).where("_v is not null")
    cuts = known.groupBy(*keys).agg(F.percentile_approx("_v", [k / parts for k in range(1, parts)], 10_000).alias("_cuts"), F.count(F.lit(1)).alias("_n"))
    rank = F.lit(q) * (F.col("_n") - 1)
    ranked = cuts.select(*keys, "_cuts", F.floor(rank).alias("_low"), F.ceil(rank).alias("_high"), (rank - F.floor(rank)).alias("_share"))
    # A part is named by how many cuts lie below; where a group is small Spark broadcasts its cuts.
    placed = known.join(ranked, keys).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))
    sizes = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    spans = sizes.withColumn("_before", F.coalesce(before, F.lit(0)))
    wanted = spans.join(ranked.drop("_cuts"), keys).where((F.col("_low") < F.col("_before") + F.col("_size")) & (F.col("_high") >= F.col("_before")))
    inside = placed.select(*keys, "_part", "_v").join(wanted, [*keys, "_part"]).groupBy(*keys, "_part", "_before", "_low", "_high", "_share", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    counted = inside.withColumn("_upto", upto)
    at = lambda r: F.min(F.when(F.col("_upto") > F.col(r), F.col("_v")))
    found = counted.groupBy(*keys).agg(at("_low").alias("_a"), at("_high").alias("_b"), F.first("_share").alias("_share"))
    return found.select(*keys, (F.col("_a") + F.col("_share") * (F.col("_b") - F.col("_a"))).alias("percentile"))


def profile(df: DataFrame, keys: list[str], column: str, digits: int = 4) -> DataFrame:
    """avg, min, max and 95th percentile."""
    plain = df.groupBy(*keys).agg(F.round(F.avg(column), digits).alias("avg"), F.round(F.min(column), digits).alias("min"), F.round(F.max(column), digits).alias("max"))
    high = exact_percentile(df, keys, column, 0.95).withColumnRenamed("percentile", "_p")
    return plain.join(high, keys, "left").select(*keys, "avg", "min", "max", F.round("_p", digits).alias("p95"))


def latest_snapshot(df: DataFrame, time: str) -> DataFrame:
    last = df.agg(F.max(time).alias("_last"))
    return df.join(F.broadcast(last), F.col(time) == F.col("_last")).drop("_last")


def complete_domain(df: DataFrame, key: str, values: list[str], column: str) -> DataFrame:
    """A row for each value of an enumerated domain; counts that are missing are zero."""
    domain = df.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return F.broadcast(domain).join(df, key, "left").withColumn(column, F.coalesce(column, F.lit(0)))


def hit_ratio(df: DataFrame, instance: str, database: str, hit: str, read: str) -> DataFrame:
    """hit / (hit + read + 0.0001) of each database, then their plain mean for each instance."""
    by_db = df.groupBy(instance, database).agg((F.sum(hit) / (F.sum(hit) + F.sum(read) + 0.0001)).alias("_ratio"))
    return by_db.groupBy(instance).agg(F.avg("_ratio").alias("ratio"))


def upsert(df: DataFrame, identity: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(statements, journal): one row for each identity with the least ``order`` as its id, and all executions with that id."""
    ids = df.groupBy(*identity).agg(F.min(order).alias("statement_id"))
    return ids, df.join(ids, identity)


def merge_alarms(alarms: DataFrame, keys: list[str], interval_ms: int) -> DataFrame:
    """Alarms of the same kind that start within interval + 1 s of the end before become one."""
    from tidewatch.operators.transforms import merge_intervals

    return merge_intervals(alarms, keys, slack=interval_ms + 1000)


def containing_prefix(df: DataFrame, path: str, mounts: DataFrame, mount: str) -> DataFrame:
    """Each path with the longest mount point it starts with.

    Mounts and paths meet on every prefix of the path, so the join has an equality to hash on.
    """
    parts = F.split(F.col(path), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    exploded = df.withColumn("_prefix", F.explode(F.transform(prefixes, lambda p: F.when(p == "", F.lit("/")).otherwise(p))))
    met = exploded.join(mounts.withColumnRenamed(mount, "_prefix"), "_prefix").withColumnRenamed("_prefix", mount)
    return top_in_group(met, [path], [F.length(mount).desc()], 1)


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, width: int) -> DataFrame:
    """Rows with 0 <= b - a <= width, by equality of buckets instead of a nested loop.

    A bucket is ``width`` wide, so a partner lies in the row's own bucket or the next.
    """
    near = left.withColumn("_bucket", F.explode(F.array(F.floor(F.col(a) / width), F.floor(F.col(a) / width) + 1)))
    met = near.join(right.withColumn("_bucket", F.floor(F.col(b) / width)), "_bucket")
    return met.where(F.col(b).between(F.col(a), F.col(a) + width)).drop("_bucket")


def ancestors(df: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, root, depth) by doubling: each round follows as many links as all before it, until no top has a parent.

    Raises ValueError on a cycle, where a depth passes the number of links.
    """
    links = df.select(F.col(child).alias("node"), F.col(parent).alias("up"))
    chain = links.select("node", F.coalesce("up", "node").alias("top"), F.when(F.col("up").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("depth"))
    from tidewatch.sources.store import shared_folder

    n = links.where("up IS NOT NULL").count()
    shared_folder(df.sparkSession)
    while True:
        chain = chain.checkpoint()
        far = chain.where("depth > 0").select(F.col("node").alias("top"), F.col("top").alias("_top"), F.col("depth").alias("_more"))
        if (chain.agg(F.max("depth")).first()[0] or 0) > n:
            raise ValueError(f"{child} and {parent} form a cycle")
        if chain.join(far, "top", "left_semi").isEmpty():
            return chain.select(F.col("node").alias(child), F.col("top").alias("root"), "depth")
        chain = chain.join(far, "top", "left").select("node", F.coalesce("_top", "top").alias("top"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"))


def grouping_sets(df: DataFrame, columns: list[str], sets: list[list[str]], *measures: Column) -> DataFrame:
    """Aggregates over several groupings at once; ``level`` has a bit for each column that a row is not grouped by."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*measures, F.grouping_id(*columns).cast("long").alias("level"))


def distinct_estimates(df: DataFrame, keys: list[str], columns: list[str], error: float = 0.02) -> DataFrame:
    """(keys, a column for each of ``columns``): approximate numbers of distinct values, in memory that does not grow with them."""
    return df.groupBy(*keys).agg(*(F.approx_count_distinct(c, error).alias(c) for c in columns))


def present_keys(df: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Each asked key, and whether ``df`` has it: one semi join, which stops at no count."""
    found = df.select(key).distinct().withColumn("_there", F.lit(True))
    return asked.select(key).distinct().join(found, key, "left").select(key, F.coalesce("_there", F.lit(False)).alias("present"))


#: Sections of a real-time inspection and the metrics they show.
INSPECTION = {
    "host": ("os_cpu_user_usage", "os_mem_usage", "os_disk_usage", "os_disk_ioutils"),
    "database": ("connections", "thread_pool_usage", "active_sessions", "locks"),
    "workload": ("qps", "tps", "p95", "buffer_hit_rate"),
    "growth": ("db_size", "table_size", "xlog_size"),
}


def inspect(samples: DataFrame, now: int, minutes: int = 10, sections: dict = INSPECTION) -> DataFrame:
    """(section, name, instance, latest, avg, min, max, n) of the last minutes, for the metrics that the sections name."""
    pairs = F.array(*(F.struct(F.lit(s).alias("section"), F.lit(m).alias("name")) for s, names in sections.items() for m in names))
    wanted = F.filter(pairs, lambda p: p["name"] == F.col("name"))
    recent = samples.where(F.col("ts_ms").between(now - minutes * 60_000, now)).select("name", "instance", "ts_ms", "value", F.explode(wanted["section"]).alias("section"))
    v = F.col("value")
    return recent.groupBy("section", "name", "instance").agg(F.max_by("value", "ts_ms").alias("latest"), F.avg(v).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))


def subsets(df: DataFrame, key: str, member: str, most: int = 4) -> DataFrame:
    """(key, mask, members array): all subsets of each key's members in order; a key may have ``most`` of them, as they double with each."""
    sets = df.groupBy(key).agg(F.sort_array(F.collect_set(member)).alias("_all"))
    checked = sets.withColumn("_all", F.when(F.size("_all") <= most, F.col("_all")).otherwise(F.raise_error(F.lit(f"a key has more than {most} members"))))
    masked = checked.withColumn("mask", F.explode(F.expr("sequence(0, cast(pow(2, size(_all)) as int) - 1)")))
    return masked.select(key, "mask", F.expr("filter(_all, (x, i) -> shiftright(mask, i) % 2 = 1)").alias("members"))
