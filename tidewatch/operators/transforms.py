"""Sequence transforms as window expressions over (keys..., ts_ms, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODIFIERS = ("diff", "abs_diff", "abs_rel_diff")


def _series(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("ts_ms")


def _left(width: int) -> int:
    return width - 1 - (width - 1) // 2


def _fold(how: str, value: str, window, frame: tuple[int, int]) -> Column:
    over = window.rowsBetween(*frame)
    if how == "median":
        return F.percentile(value, F.lit(0.5)).over(over)
    if how == "mean":
        return F.avg(value).over(over)
    # A frame of one row deviates by nothing; one defined value among several has no deviation.
    return F.when(F.count(F.lit(1)).over(over) == 1, F.when(F.count(value).over(over) == 1, 0.0)).otherwise(F.stddev_samp(value).over(over))


def shift(df: DataFrame, keys: list[str], k: int, fill: float | None = None) -> DataFrame:
    """The value ``k`` rows earlier (later if negative)."""
    w = _series(keys)
    moved = F.lag("value", k, fill).over(w) if k >= 0 else F.lead("value", -k, fill).over(w)
    return df.withColumn("value", moved)


def rolling(df: DataFrame, keys: list[str], width: int, how: str = "mean") -> DataFrame:
    """Centred rolling median, mean or std; even windows reach further back; edges are cut short."""
    left = _left(width)
    return df.withColumn("value", _fold(how, "value", _series(keys), (-left, width - 1 - left)))


def pad_edges(df: DataFrame, keys: list[str], width: int, columns: list[str]) -> DataFrame:
    """The first and last results of a window of ``width`` take the nearest valid one's."""
    w = _series(keys)
    whole = Window.partitionBy(*keys)
    row, n = F.row_number().over(w) - 1, F.count(F.lit(1)).over(whole)
    numbered = df.withColumn("_i", row).withColumn("_n", n)
    low, high = _left(width), (width - 1) // 2
    # Two rows of each series are looked up, so two conditional maxima replace a join.
    for c in columns:
        first = F.max(F.when(F.col("_i") == F.lit(low), F.col(c))).over(whole)
        last = F.max(F.when(F.col("_i") == F.col("_n") - 1 - high, F.col(c))).over(whole)
        numbered = numbered.withColumn(f"_{c}", F.when(F.col("_n") < width, F.col(c)).when(F.col("_i") < low, first).when(F.col("_i") > F.col("_n") - 1 - high, last).otherwise(F.col(c)))
    for c in columns:
        numbered = numbered.withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    return numbered.drop("_i", "_n")


def double_rolling(df: DataFrame, keys: list[str], widths: tuple[int, int], how: str = "median", modifier: str = "diff") -> DataFrame:
    """What changes between the window ending before a row and the window starting at it.

    Adds ``diff`` (right less left) and ``change``: that, its absolute value, or its absolute value
    over the left side. Edges take the nearest complete result.
    """
    if modifier not in MODIFIERS:
        raise ValueError(f"modifier is one of {MODIFIERS}")
    w1, w2 = widths
    w = _series(keys)
    l1, l2 = _left(w1), _left(w2)
    sides = (
        df.withColumn("_prior", F.lag("value").over(w))
        .withColumn("_l", _fold(how, "_prior", w, (-l1, w1 - 1 - l1)))
        .withColumn("_r", _fold(how, "value", w, (-(w2 - 1 - l2), l2)))
        .withColumn("diff", F.col("_r") - F.col("_l"))
    )
    change = {"diff": F.col("diff"), "abs_diff": F.abs("diff"), "abs_rel_diff": F.abs("diff") / F.nullif(F.col("_l"), F.lit(0.0))}[modifier]
    return pad_edges(sides.withColumn("change", change).drop("_prior", "_l", "_r"), keys, max(w1, w2), ["diff", "change"])


def difference(df: DataFrame, keys: list[str], times: int = 1) -> DataFrame:
    for _ in range(times):
        df = df.withColumn("value", F.col("value") - F.lag("value").over(_series(keys)))
    return df


def step_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, step): the most frequent gap between samples; of equally frequent ones the first seen."""
    gaps = df.withColumn("step", F.col("ts_ms") - F.lag("ts_ms").over(_series(keys))).where("step is not null")
    counted = gaps.groupBy(*keys, "step").agg(F.count(F.lit(1)).alias("_n"), F.min("ts_ms").alias("_t"))
    return counted.groupBy(*keys).agg(F.max_by("step", F.struct("_n", -F.col("_t"))).alias("step"))


def align(df: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Timestamps on a grid from the first: each gap is rounded down to whole steps, one at least."""
    w = _series(keys)
    before = F.lag("ts_ms").over(w)
    gap = F.when(before.isNull(), F.lit(0)).otherwise(F.greatest(F.floor((F.col("ts_ms") - before) / step), F.lit(1)) * step)
    first = F.first("ts_ms").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("_gap", gap).withColumn("_first", first).withColumn("aligned_ms", F.col("_first") + F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap", "_first")


def fill_grid(df: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Every point of each series' grid from its first to its last sample; missing values are NULL.

    A sample stands for the points up to the next one, so a window and a generated range replace a
    join; samples that are off the grid of the first one are left out.
    """
    w = _series(keys)
    others = [c for c in df.columns if c not in (*keys, "ts_ms")]
    first = F.first("ts_ms").over(w.rowsBetween(Window.unboundedPreceding, 0))
    on = df.withColumn("_first", first).where((F.col("ts_ms") - F.col("_first")) % step == 0).drop("_first")
    points = on.withColumn("_next", F.lead("ts_ms").over(w)).withColumn("_t", F.explode(F.expr(f"sequence(ts_ms, coalesce(_next - {step}, ts_ms), {step}L)")))
    return points.select(*keys, F.col("_t").alias("ts_ms"), *(F.when(F.col("_t") == F.col("ts_ms"), F.col(c)).alias(c) for c in others))


def interpolate(df: DataFrame, keys: list[str]) -> DataFrame:
    """NULLs become linear in time between their defined neighbours, and constant at both ends."""
    w = _series(keys)
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("value").isNotNull(), F.col("ts_ms"))
    known = (
        df.withColumn("_v0", F.last("value", True).over(past))
        .withColumn("_v1", F.first("value", True).over(future))
        .withColumn("_t0", F.last(at, True).over(past))
        .withColumn("_t1", F.first(at, True).over(future))
    )
    between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("ts_ms") - F.col("_t0")) / F.nullif(F.col("_t1") - F.col("_t0"), F.lit(0))
    return known.withColumn("value", F.coalesce("value", between, "_v0", "_v1")).drop("_v0", "_v1", "_t0", "_t1")


def trim_ends(df: DataFrame, keys: list[str]) -> DataFrame:
    """NULLs before the first and after the last defined value take it; a series without any is zero."""
    w = _series(keys)
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    before, after = F.last("value", True).over(past), F.first("value", True).over(future)
    inside = before.isNotNull() & after.isNotNull()
    return df.withColumn("value", F.when(inside, F.col("value")).otherwise(F.coalesce(before, after, F.lit(0.0))))


def decimate(df: DataFrame, keys: list[str], stride: int) -> DataFrame:
    """Every ``stride``-th sample of each series."""
    return df.withColumn("_i", F.row_number().over(_series(keys)) - 1).where(F.col("_i") % stride == 0).drop("_i")


def seasonal_means(df: DataFrame, keys: list[str], period: int) -> DataFrame:
    """Adds ``seasonal``: the mean of the phase less the mean of all phase means."""
    by_phase = df.withColumn("_phase", (F.row_number().over(_series(keys)) - 1) % period)
    means = by_phase.groupBy(*keys, "_phase").agg(F.avg("value").alias("_mean"))
    centred = means.withColumn("seasonal", F.col("_mean") - F.avg("_mean").over(Window.partitionBy(*keys))).drop("_mean")
    return by_phase.join(centred, [*keys, "_phase"]).drop("_phase")


def trend(df: DataFrame, keys: list[str], period: int) -> DataFrame:
    """Adds ``trend``: a centred moving average over a period, NULL where it is not whole; even periods halve the ends."""
    w = _series(keys)
    half = period // 2
    frame = w.rowsBetween(-half, half)
    total = F.sum("value").over(frame)
    if period % 2 == 0:
        total = total - (F.lag("value", half).over(w) + F.lead("value", half).over(w)) / 2
    return df.withColumn("trend", F.when(F.count(F.lit(1)).over(frame) == 2 * half + 1, total / period))


def islands(df: DataFrame, keys: list[str], flag: str = "is_anomaly", drop_ends: bool = False) -> DataFrame:
    """(keys, start_ms, end_ms, n): runs of flagged rows next to each other by position, not by time."""
    w = _series(keys)
    numbered = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    hot = numbered.where(F.col(flag)).withColumn("_island", F.col("_i") - F.row_number().over(w))
    out = hot.groupBy(*keys, "_island").agg(
        F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count(F.lit(1)).alias("n"),
        F.min("_i").alias("_a"), F.max("_i").alias("_b"), F.max("_n").alias("_n"),
    )
    if drop_ends:
        out = out.where("_a > 1 and _b < _n")
    return out.drop("_island", "_a", "_b", "_n")


# --- sets of intervals and series ---------------------------------------------------------------


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms", slack: int = 0) -> DataFrame:
    """Unions of intervals that overlap or lie within ``slack`` of each other."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col(start) <= reach + slack, 0).otherwise(1)
    grouped = df.withColumn("_new", fresh).withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_group").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_group")


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """The common part as a struct, NULL when the intervals do not meet or only touch."""
    low, high = F.greatest(a_start, b_start), F.least(a_end, b_end)
    return F.when(low < high, F.struct(low.alias("start_ms"), high.alias("end_ms")))


def find_gaps(df: DataFrame, keys: list[str], start: int, end: int, step: int) -> DataFrame:
    """(keys, start_ms, end_ms): what of the grid from start to end the intervals leave out."""
    merged = merge_intervals(df.where((F.col("end_ms") >= start) & (F.col("start_ms") <= end)), keys, slack=step)
    w = Window.partitionBy(*keys).orderBy("start_ms")
    gap = lambda a, b: F.struct(a.cast("long").alias("start_ms"), b.cast("long").alias("end_ms"))
    after = gap(F.col("end_ms") + step, F.coalesce(F.lead("start_ms").over(w) - step, F.lit(end)))
    before = F.when(F.row_number().over(w) == 1, gap(F.lit(start), F.col("start_ms") - step))
    each = merged.withColumn("_gaps", F.array_compact(F.array(before, after)))
    return each.select(*keys, F.explode("_gaps").alias("_g")).select(*keys, "_g.start_ms", "_g.end_ms").where("start_ms <= end_ms")


def concatenate(first: DataFrame, later: DataFrame, keys: list[str]) -> DataFrame:
    """Both series as one; where both have a sample the later series wins."""
    both = first.withColumn("_order", F.lit(0)).unionByName(later.withColumn("_order", F.lit(1)))
    return both.groupBy(*keys, "ts_ms").agg(F.max_by("value", "_order").alias("value"))
