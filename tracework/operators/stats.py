"""Run-log summaries, series statistics, counters and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.functions.ids import label_key
from tracework.operators.ranges import percentiles, running


def latency_summary(runs: DataFrame, *by: str) -> DataFrame:
    """Counts, mean and nearest-rank percentiles of the runs that went well, by group."""
    ok = F.when(F.col("status") == "ok", F.col("latency_ms"))
    plain = runs.groupBy(*by).agg(
        F.count(ok).alias("ok_count"),
        F.count_if(F.col("status") != "ok").alias("error_count"),
        F.round(F.avg(ok), 6).alias("mean_ms"),
        F.min(ok).alias("min_ms"),
        F.max(ok).alias("max_ms"),
    )
    ranks = percentiles(runs.where("status = 'ok'"), list(by), "latency_ms", {f"p{p}_ms": p / 100 for p in (50, 95, 99)})
    key = None
    for c in by:
        same = plain[c].eqNullSafe(ranks[c])
        key = same if key is None else key & same
    return plain.join(ranks, key, "left").select(
        *(plain[c] for c in by), "ok_count", "error_count", "mean_ms", "p50_ms", "p95_ms", "p99_ms", "min_ms", "max_ms"
    )


def confidence_interval(rows: DataFrame, by: str, x: str) -> DataFrame:
    """Mean, population deviation, 95 % interval (lower end not below 0) and count."""
    half = 1.96 * F.col("sd") / F.sqrt("n")
    return rows.groupBy(by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.count(x).alias("n")).select(
        by, "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"),
        F.round(F.greatest(F.lit(0.0), F.col("mean") - half), 6).alias("low"), F.round(F.col("mean") + half, 6).alias("high"),
    )


def throughput(runs: DataFrame, by: str) -> DataFrame:
    """Runs a second over the span of the log and share that went well."""
    span = F.max("ts").cast("timestamp").cast("double") - F.min("ts").cast("timestamp").cast("double")
    return runs.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.when(span > 0, F.count(F.lit(1)) / span), 9).alias("per_second"),
        F.round(F.count_if(F.col("status") == "ok") / F.count(F.lit(1)), 9).alias("success_rate"),
    )


def autocorrelation(series: DataFrame, by: str, order: str, x: str, lag: int = 1) -> DataFrame:
    """Lag autocorrelation: covariance over the n - lag pairs by the population variance; 0 without variance, null below two values."""
    m = series.groupBy(by).agg(F.avg(x).alias("m"), F.var_pop(x).alias("v"), F.count(x).alias("c"))
    rows = running(series.select(by, order, x), [by], [order]).join(F.broadcast(m.select(by, "m")) if m.count() <= 10_000 else m.select(by, "m"), by)
    rows = rows.select(by, "n", (F.col(x) - F.col("m")).alias("d"))
    earlier = rows.select(by, (F.col("n") + lag).alias("n"), F.col("d").alias("b"))
    c = rows.join(earlier, [by, "n"]).groupBy(by).agg(F.avg(F.col("d") * F.col("b")).alias("cov"))
    return m.join(c, by, "left").select(
        by, F.round(F.when(F.col("c") > 1, F.when(F.col("v") == 0, 0.0).otherwise(F.col("cov") / F.col("v"))), 6).alias("autocorrelation")
    )


def optima(series: DataFrame, by: str, order: str, x: str) -> DataFrame:
    """Values above both neighbours, with their positions (from 0)."""
    near = running(series.select(by, order, x), [by], [order], neighbours=(x,))
    top = (F.col(x) > F.col(f"{x}_before")) & (F.col(x) > F.col(f"{x}_after"))
    return near.where(top).select(by, (F.col("n") - 1).alias("position"), order, x)


def local_optima(series: DataFrame, by: str, order: str, x: str) -> DataFrame:
    """How many values of each series lie above both neighbours, and the class none, single or multi."""
    found = optima(series, by, order, x).groupBy(by).agg(F.count(F.lit(1)).alias("found"))
    n = series.select(by).distinct().join(found, by, "left").select(by, F.coalesce("found", F.lit(0)).alias("optima"))
    return n.withColumn("class", F.when(F.col("optima") == 0, "none").when(F.col("optima") == 1, "single").otherwise("multi"))


def histogram(rows: DataFrame, by: str, x: str, bounds: list[float]) -> DataFrame:
    """Cumulative buckets: sum, count and the count at or below each bound."""
    return rows.groupBy(by).agg(
        F.round(F.sum(x), 6).alias("sum"), F.count(x).alias("count"),
        *(F.count_if(F.col(x) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds),
    )


def gauge(rows: DataFrame, by: str, x: str, ts: str) -> DataFrame:
    """Last value of each group by time."""
    return rows.groupBy(by).agg(F.max_by(x, ts).alias("value"))


def page(rows: DataFrame, order: list[str], number: int = 0, size: int = 10) -> DataFrame:
    """One page in a total order, with ``total`` rows and ``has_more``; sizes above 1000 count as 1000."""
    size = min(size, 1000)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    shown = rows.orderBy(*order).offset(number * size).limit(size)
    return shown.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > (number + 1) * size)  # one row


def ingest_summary(manifests: DataFrame, by: str = "system", x: str = "ingest_ms") -> DataFrame:
    """Runs, mean, least, greatest and median time of loading, by system."""
    return manifests.groupBy(by).agg(
        F.count(x).alias("runs"), F.round(F.avg(x), 6).alias("mean_ingest_ms"), F.min(x).alias("min_ingest_ms"),
        F.max(x).alias("max_ingest_ms"), F.round(F.median(x), 6).alias("median_ingest_ms"),
    )


def run_ranges(summaries: DataFrame, by: str = "query") -> DataFrame:
    """Across the runs of a query: ranges of mean and p95 as text, greatest p99 and greatest of all."""
    span = lambda x: F.format_string("%.3f-%.3f", F.min(x), F.max(x))
    return summaries.groupBy(by).agg(
        span("mean_ms").alias("mean_range"), span("p95_ms").alias("p95_range"), F.max("p99_ms").alias("p99_max"), F.max("max_ms").alias("max_observed")
    )


def rerun_summary(runs: DataFrame, *by: str) -> DataFrame:
    """Summaries of single runs (as ``latency_summary`` gives them) put together by group."""
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("ok_count").alias("total_ok_count"), F.sum("error_count").alias("total_error_count"),
        F.round(F.avg("mean_ms"), 6).alias("mean_of_mean_ms"), F.round(F.median("p50_ms"), 6).alias("median_p50_ms"),
        F.round(F.avg("p95_ms"), 6).alias("mean_p95_ms"), F.min("p95_ms").alias("min_p95_ms"), F.max("p95_ms").alias("max_p95_ms"),
        F.round(F.median("p95_ms"), 6).alias("median_p95_ms"), F.round(F.avg("p99_ms"), 6).alias("mean_p99_ms"),
        F.min("min_ms").alias("min_observed_ms"), F.max("max_ms").alias("max_observed_ms"),
    )


def scale_table(summaries: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """One row for each ``row``, p95 and mean of each of the given columns side by side."""
    wide = summaries.groupBy(row).pivot(column, values).agg(F.first("p95_ms").alias("p95"), F.first("mean_ms").alias("mean"))
    return wide.toDF(row, *(f"{m}_{v}" for v in values for m in ("p95", "mean")))


def moments(rows: DataFrame, by: str, x: str) -> DataFrame:
    return rows.groupBy(by).agg(
        F.round(F.avg(x), 6).alias("mean"), F.round(F.var_pop(x), 6).alias("variance"), F.round(F.stddev_pop(x), 6).alias("deviation")
    )


def counters(log: DataFrame, labels: str, up: str) -> DataFrame:
    """Value of each labelled counter: steps up less steps down."""
    return log.groupBy(label_key(F.col(labels)).alias("labels")).agg(F.sum(F.when(F.col(up), 1).otherwise(-1)).alias("value"))
