"""The metric model: long tables of labelled samples, and selectors over them.

A sample is (name, labels map, ts_ms, value); a series is one (name, labels). Timestamps are whole
milliseconds, and a missing value is NULL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOOKBACK_MS = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: str) -> Column:
    """Milliseconds since the epoch of a timestamp without zone, whatever the session's zone is."""
    return F.expr(
        f"cast(unix_date(cast({ts} as date)) as bigint) * 86400000 + (hour({ts}) * 3600 + minute({ts}) * 60) * 1000L"
        f" + cast(floor(extract(SECOND FROM {ts}) * 1000) as bigint)"
    )


def series_key(labels: str = "labels") -> Column:
    """A canonical text of a label map, equal for equal maps."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples: name is the event type, one label from_instance; of samples at one time the last event counts."""
    raw = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("name"),
        (F.col("user_id") % 10).cast("string").alias("instance"),
        epoch_ms("ts").alias("ts_ms"),
        "value",
        "event_id",
    )
    last = raw.groupBy("name", "instance", "ts_ms").agg(F.max_by("value", "event_id").alias("value"))
    return last.select("name", F.create_map(F.lit("from_instance"), F.col("instance")).alias("labels"), "ts_ms", "value")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regular series for each event type: (name, ts_ms, value, n), the mean of each hour that has events."""
    hour = F.expr("ts_ms - ts_ms % 3600000").alias("ts_ms")
    return (
        table(spark, sf_dir, "events")
        .select(F.col("event_type").alias("name"), epoch_ms("ts").alias("ts_ms"), "value")
        .groupBy("name", hour)
        .agg(F.round(F.avg("value"), 6).alias("value"), F.count(F.lit(1)).alias("n"))
    )


def counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter for each instance: (name, instance, ts_ms, value) grows by one an event and falls to one at a reset."""
    raw = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).cast("string").alias("instance"), epoch_ms("ts").alias("ts_ms"), "event_id"
    )
    in_order = Window.partitionBy("instance").orderBy("ts_ms", "event_id")
    epoch = F.sum(F.when(F.col("event_id") % 997 == 0, 1).otherwise(0)).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    counted = raw.withColumn("epoch", epoch).withColumn(
        "value", F.row_number().over(Window.partitionBy("instance", "epoch").orderBy("ts_ms", "event_id")).cast("double")
    )
    last = counted.groupBy("instance", "ts_ms").agg(F.max_by("value", "event_id").alias("value"))
    return last.select(F.lit("events_total").alias("name"), "instance", "ts_ms", "value")


# --- matchers and the selector -----------------------------------------------------------------


def matches(labels: str, key: str, op: str, value: str) -> Column:
    """A label matcher; regular expressions are anchored, and a missing label is the empty string."""
    label = F.coalesce(F.col(labels)[key], F.lit(""))
    whole = f"^(?:{value})$"
    return {"=": label == value, "!=": label != value, "=~": label.rlike(whole), "!~": ~label.rlike(whole)}[op]


@dataclass(frozen=True)
class Selector:
    """A lazy selection of series; every call returns a new one.

    A key is either exact or a pattern. ``from_server`` takes host:port or, as a fallback, host alone.
    """

    samples: DataFrame
    exact: dict[str, str] = field(default_factory=dict)
    like: dict[str, str] = field(default_factory=dict)
    name: str | None = None
    source: str = "from_instance"
    start: int | None = None
    end: int | None = None
    bounds: tuple[float | None, float | None] = (None, None)
    promoted: tuple[str, ...] = ()

    @classmethod
    def stored(cls, spark: SparkSession, folder: str) -> Selector:
        """Selections of samples that write_samples() has stored: metric, promoted labels, times and values are compared by the scan."""
        samples = spark.read.parquet(folder)
        return cls(samples, promoted=tuple(c.removeprefix("label_") for c in samples.columns if c.startswith("label_")))

    def metric(self, name: str) -> Selector:
        return replace(self, name=name, source="instance" if name.startswith("node_") else "from_instance")

    def filter(self, **labels: str) -> Selector:
        if self.like.keys() & labels.keys():
            raise ValueError("a label is either exact or a pattern")
        return replace(self, exact=self.exact | labels)

    def filter_like(self, **labels: str) -> Selector:
        if self.exact.keys() & labels.keys():
            raise ValueError("a label is either exact or a pattern")
        return replace(self, like=self.like | labels)

    def from_server(self, host: str) -> Selector:
        return self.filter(**{self.source: host})

    def from_server_like(self, host: str) -> Selector:
        return self.filter_like(**{self.source: f"{re.escape(host)}(:[0-9]{{4,5}}|)"})

    def between(self, start: int, end: int) -> Selector:
        return replace(self, start=start, end=end)

    def values(self, low: float | None = None, high: float | None = None) -> Selector:
        return replace(self, bounds=(low, high))

    def _chosen(self, low_inclusive: bool) -> DataFrame:
        df = self.samples
        if self.name is not None:
            df = df.where(F.col("name") == self.name)
        for key, value in self.exact.items():
            # A label that is missing equals the empty text.
            df = df.where(F.col(f"label_{key}") == value if key in self.promoted and value else matches("labels", key, "=", value))
        for key, value in self.like.items():
            df = df.where(matches("labels", key, "=~", value))
        if self.start is not None:
            df = df.where(F.col("ts_ms").between(self.start, self.end))
        low, high = self.bounds
        if low:  # a bound of zero is no bound
            df = df.where(F.col("value") >= low if low_inclusive else F.col("value") > low)
        if high:
            df = df.where(F.col("value") < high)
        return df

    def fetchall(self) -> DataFrame:
        """All samples of the range; the lower value bound is inclusive."""
        return self._chosen(low_inclusive=True)

    def latest(self) -> DataFrame:
        """The last sample of each series; the lower value bound is exclusive."""
        return instant(self._chosen(low_inclusive=False))

    def fetchone(self) -> DataFrame:
        """The samples of the first series in order of its key."""
        df = self.fetchall().withColumn("_key", series_key())
        first = df.agg(F.min("_key").alias("_first"))
        return df.join(F.broadcast(first), F.col("_key") == F.col("_first")).drop("_key", "_first")


def instant(samples: DataFrame) -> DataFrame:
    """(name, labels, ts_ms, value): the last sample of each series."""
    last = samples.withColumn("_key", series_key()).groupBy("name", "_key").agg(F.max(F.struct("ts_ms", "value")).alias("_last"))
    return last.select("name", F.from_json("_key", "map<string,string>").alias("labels"), "_last.ts_ms", "_last.value")


def on_grid(samples: DataFrame, keys: list[str], start: int, end: int, step: int, lookback: int = LOOKBACK_MS) -> DataFrame:
    """(keys, ts_ms, value) at start, start + step, ... end: the last sample not older than ``lookback``.

    Each sample serves the grid points from itself to the next sample of its series, so the
    as-of join is one window and one generated range.
    """
    following = F.lead("ts_ms").over(Window.partitionBy(*keys).orderBy("ts_ms"))
    near = samples.where(F.col("ts_ms").between(start - lookback, end)).withColumn("_next", following)
    first = F.expr(f"{start} + cast(ceil(greatest(ts_ms - {start}, 0) / {step}) as bigint) * {step}")
    last = F.least(F.coalesce(F.col("_next") - 1, F.lit(end)), F.col("ts_ms") + lookback, F.lit(end))
    served = near.withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    return served.select(*keys, F.explode(F.expr(f"sequence(_first, _last, {step}L)")).alias("ts_ms"), "value")


def typed_labels(samples: DataFrame, types: dict[str, str]) -> DataFrame:
    """A column for each label that ``types`` names, cast; a text that does not fit its type is NULL."""
    return samples.select(*(F.try_element_at("labels", F.lit(n)).try_cast(t).alias(n) for n, t in types.items()))


def fetch_window(samples: DataFrame, now: int, interval_ms: int, expansion: float = 1.5, time: str = "ts_ms") -> DataFrame:
    """What a round fetches: the interval before ``now``, widened for late samples; rounds overlap, so keys are deduplicated after."""
    return samples.where(F.col(time).between(int(now - interval_ms * expansion), now))
