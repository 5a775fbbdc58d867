"""Metric series: counter deltas, rates, histogram quantiles, state gauges, and text exposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.functions.text import escape_label
from loomdex.scratch import written

#: Upper bounds of the duration, batch and result histograms.
DURATION_BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
STATES = ("normal", "overflow", "full_scan")


def counter_delta(samples: DataFrame, series: Sequence[str], ts: str = "ts", value: str = "value", order: Sequence[str] = ()) -> DataFrame:
    """Adds delta: growth since the series' last sample; after a reset the value itself, for the first sample too."""
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(ts, *order))
    return samples.withColumn("delta", F.when(before.isNull() | (F.col(value) < before), F.col(value)).otherwise(F.col(value) - before))


def counter_delta_ranged(samples: DataFrame, series: Sequence[str], ts: str = "ts", value: str = "value", order: Sequence[str] = ()) -> DataFrame:
    """As ``counter_delta``, for series that may hold most of the samples.

    Samples are dealt by ranges of series and time, so a long series is many tasks; each
    looks back within its range, and a row for each range and series carries its last value
    to the next range. Writes the dealt samples once, so that all steps see the same ranges.
    """
    place = "__part"
    dealt = written(samples.repartitionByRange(*series, ts, *order).withColumn(place, F.spark_partition_id()))
    inside = Window.partitionBy(place, *series).orderBy(ts, *order)
    ends = dealt.groupBy(place, *series).agg(F.max_by(value, F.struct(ts, *order)).alias("__end"))
    # As many rows as there are ranges and series; of one series no more than ranges.
    carried = ends.withColumn("__carry", F.lag("__end").over(Window.partitionBy(*series).orderBy(place)))
    keys = [place, *series]
    carried = carried.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__carry")
    marked = dealt.withColumn("__first", F.row_number().over(inside) == 1).withColumn("__before", F.lag(value).over(inside))
    first = marked.where("__first").join(carried, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], "left").withColumn("__before", F.col("__carry"))
    every = marked.where("not __first").unionByName(first.select(*marked.columns))
    before = F.col("__before")
    delta = F.when(before.isNull() | (F.col(value) < before), F.col(value)).otherwise(F.col(value) - before)
    return every.select(*samples.columns, delta.alias("delta"))


def increase(deltas: DataFrame, by: Sequence[str], window: str = "1 hour", ts: str = "ts") -> DataFrame:
    return deltas.groupBy(F.window(ts, window)["start"].alias("start"), *by).agg(F.sum("delta").alias("increase"))


def average(rows: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    return rows.groupBy(*by).agg(F.sum(value).alias("total"), F.count(value).alias("n"), F.try_divide(F.sum(value), F.count(value)).alias("average"))


def buckets(rows: DataFrame, by: Sequence[str], bounds: Sequence[float], value: str = "value") -> DataFrame:
    """(by, le, cumulative): how many values are at most each bound, +Inf last."""
    counts = rows.groupBy(*by).agg(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col(value) <= b).alias("cumulative")) for b in (*bounds, float("inf"))]).alias("b"))
    return counts.select(*by, F.explode("b").alias("b")).select(*by, "b.le", "b.cumulative")


def histogram_quantile(cumulative: DataFrame, by: Sequence[str], q: float) -> DataFrame:
    """(by, quantile) by linear interpolation in the bucket that holds the rank; above the last bound, that bound."""
    w = Window.partitionBy(*by).orderBy("le")
    everything = Window.partitionBy(*by)
    rows = (
        cumulative.withColumn("below", F.coalesce(F.lag("cumulative").over(w), F.lit(0)))
        .withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0)))
        .withColumn("rank", F.max("cumulative").over(everything) * F.lit(q))
        .where((F.col("cumulative") >= F.col("rank")) & (F.col("cumulative") > 0))
    )
    first = rows.groupBy(*by).agg(F.min_by(F.struct("le", "low", "below", "cumulative", "rank"), "le").alias("x"))
    share = F.try_divide(F.col("x.rank") - F.col("x.below"), F.col("x.cumulative") - F.col("x.below"))
    inside = F.col("x.low") + (F.col("x.le") - F.col("x.low")) * F.coalesce(share, F.lit(0.0))
    return first.select(*by, F.when(F.col("x.le") == float("inf"), F.col("x.low")).otherwise(inside).alias("quantile"))


def last_value(rows: DataFrame, by: Sequence[str], value: str = "value", ts: str = "ts", tie: str | None = None) -> DataFrame:
    return rows.groupBy(*by).agg(F.max_by(value, F.struct(ts, tie) if tie else F.col(ts)).alias("value"))


def state_gauges(rows: DataFrame, state: str = "state", states: Sequence[str] = STATES) -> DataFrame:
    return rows.select("*", *[(F.col(state) == s).cast("int").alias(f"state_{s}") for s in states])


def label_sum(rows: DataFrame, label: str, wanted: str, value: str = "value") -> Column:
    return F.sum(F.when(F.try_element_at("labels", F.lit(label)) == wanted, F.col(value)))


def exposition(metrics: DataFrame) -> DataFrame:
    """(name, text): each metric's help, type and sample lines, for metrics (name, help, type, labels, metricName, value)."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escape_label(e["value"]), F.lit('"')))
    labels = F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.lit(""))
    number = F.when(F.col("value") == F.floor("value"), F.col("value").cast("bigint").cast("string")).otherwise(F.col("value").cast("string"))
    line = F.concat(F.coalesce("metricName", "name"), labels, F.lit(" "), number)
    told = F.replace(F.replace(F.first("help"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return metrics.groupBy("name").agg(
        F.concat_ws("\n", F.concat(F.lit("# HELP "), F.col("name"), F.lit(" "), told), F.concat(F.lit("# TYPE "), F.col("name"), F.lit(" "), F.first("type")), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("text")
    )


SNAPSHOT = "node string, ts timestamp, metrics array<struct<name:string,type:string,labels:map<string,string>,value:double>>"


def scrape(snapshots: DataFrame, text: str = "value") -> DataFrame:
    """(node, ts, name, type, labels, value) of metric snapshots in JSON; answers of another shape, and failed ones (null), go."""
    parsed = snapshots.select(F.from_json(text, SNAPSHOT).alias("s")).where("s.node is not null and s.metrics is not null")
    rows = parsed.select("s.node", "s.ts", F.explode("s.metrics").alias("m")).select("node", "ts", "m.name", "m.type", "m.labels", "m.value")
    return rows.where("name is not null and value is not null")


def nodes(registrations: DataFrame) -> DataFrame:
    """The newest registration of each port: (port, node, seenAt)."""
    return registrations.groupBy("port").agg(F.max_by("node", F.struct("seenAt", "node")).alias("node"), F.max("seenAt").alias("seenAt"))


def evict(registered: DataFrame, now: Column, seconds: int = 15) -> DataFrame:
    """Adds alive: whether a node's last sign of life is at most so many seconds old."""
    return registered.withColumn("alive", F.col("seenAt") >= now - F.make_dt_interval(secs=F.lit(seconds)))


class Registry:
    """Counters, gauges and histograms of a driver, as rows for exposition."""

    def __init__(self) -> None:
        self._kinds: dict[str, tuple[str, str, tuple[float, ...]]] = {}
        self._values: dict[tuple[str, tuple], float] = {}
        self._observed: dict[tuple[str, tuple], list[float]] = {}

    def register(self, name: str, kind: str, help: str = "", bounds: Sequence[float] = ()) -> None:
        if kind not in ("counter", "gauge", "histogram"):
            raise ValueError(f"no such kind of metric: {kind}")
        if self._kinds.setdefault(name, (kind, help, tuple(bounds)))[0] != kind:
            raise ValueError(f"{name} is a {self._kinds[name][0]}")

    def add(self, name: str, value: float = 1.0, **labels: str) -> None:
        """Adds to a counter, which never falls, sets a gauge, or observes a histogram's value."""
        kind, _, bounds = self._kinds[name]
        key = (name, tuple(sorted(labels.items())))
        if kind == "counter":
            if value < 0:
                raise ValueError("a counter cannot fall")
            self._values[key] = self._values.get(key, 0.0) + value
        elif kind == "gauge":
            self._values[key] = value
        else:
            held = self._observed.setdefault(key, [0.0] * (len(bounds) + 2))
            for i, b in enumerate(bounds):
                held[i] += value <= b
            held[-2] += 1
            held[-1] += value

    def rows(self) -> list[tuple[str, str, str, dict, str, float]]:
        """(name, help, type, labels, metricName, value), histograms as cumulative buckets, sum and count."""
        out = []
        for (name, labels), value in self._values.items():
            kind, told, _ = self._kinds[name]
            out.append((name, told, kind, dict(labels), name, value))
        for (name, labels), held in self._observed.items():
            _, told, bounds = self._kinds[name]
            for b, n in zip((*map(str, bounds), "+Inf"), held):
                out.append((name, told, "histogram", dict(labels) | {"le": b}, f"{name}_bucket", n))
            out.append((name, told, "histogram", dict(labels), f"{name}_sum", held[-1]))
            out.append((name, told, "histogram", dict(labels), f"{name}_count", held[-2]))
        return out
