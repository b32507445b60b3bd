"""Corpus summaries and column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ordered import exact_quantiles
from .cleaning import level_counts, long_form

METRICS = ["execution_time_ms", "throughput_mbps", "cycles"]


def failed() -> Column:
    return F.col("pass_fail") == "fail"


def fail_rate() -> Column:
    return F.avg(failed().cast("double"))


def corpus_summary(runs: DataFrame, errors: DataFrame) -> DataFrame:
    n, bad = F.count("*"), F.count_if(failed())
    return runs.agg(
        n.alias("n_runs"),
        (n - bad).alias("n_pass"),
        bad.alias("n_fail"),
        F.coalesce(F.round(bad / F.nullif(n, F.lit(0)), 4), F.lit(0.0)).alias("fail_rate"),
    ).withColumn("n_error_lines", errors.agg(F.count("*")).scalar())


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares of the values of a column."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / df.agg(F.count("*")).scalar(), 4))


def error_tags(runs: DataFrame) -> DataFrame:
    return runs.where(failed()).groupBy("primary_error_tag").agg(F.count("*").alias("n"))


def severities(errors: DataFrame) -> DataFrame:
    return errors.groupBy("severity").agg(F.count("*").alias("n"))


def metric_stats(runs: DataFrame, metrics: list[str] | None = None, digits: int = 2) -> DataFrame:
    """Mean, median, 95th percentile (interpolated, exact), minimum, maximum, sample deviation."""
    metrics = [m for m in (metrics or METRICS) if m in runs.columns]
    long = long_form(runs, metrics, "double").where("value is not null")
    basic = long.groupBy("field").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    marks = exact_quantiles(long, [0.5, 0.95]).select(
        "field", F.col("q0").alias("median"), F.col("q1").alias("p95")
    )
    joined = basic.join(marks, "field")
    names = ["mean", "median", "p95", "std", "min", "max"]
    return joined.select("field", *[F.round(c, digits).alias(c) for c in names])


def approximate_metric_stats(runs: DataFrame, metrics: list[str], accuracy: int = 10000) -> DataFrame:
    long = long_form(runs, metrics, "double").where("value is not null")
    marks = F.percentile_approx("value", F.array(F.lit(0.5), F.lit(0.95)), F.lit(accuracy))
    return long.groupBy("field").agg(marks.alias("m")).select(
        "field", F.col("m")[0].alias("median"), F.col("m")[1].alias("p95")
    )


def time_by_tag(runs: DataFrame) -> DataFrame:
    return runs.groupBy("primary_error_tag").agg(
        F.count("execution_time_ms").alias("n"),
        F.round(F.avg("execution_time_ms"), 2).alias("mean_execution_time_ms"),
    )


def profile(df: DataFrame, columns: list[str] | None = None, samples: int = 4) -> DataFrame:
    """Type, distinct count, nulls and a few sample values of every column.

    Values are counted per (field, value) first, so a column of unique values is spread over
    the cluster; only ``samples`` values per column are gathered.
    """
    columns = columns or df.columns
    levels = level_counts(df, columns)
    rank = F.row_number().over(Window.partitionBy("field").orderBy("value"))
    first = (
        levels.withColumn("_r", rank)
        .where(F.col("_r") <= samples)
        .groupBy("field")
        .agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("samples"))
    )
    counts = levels.groupBy("field").agg(
        F.count("*").alias("n_distinct"), F.sum("n").alias("n_values")
    )
    types = F.create_map(*[F.lit(x) for c in columns for x in (c, df.schema[c].dataType.simpleString())])
    return counts.join(first, "field").select(
        "field", types[F.col("field")].alias("dtype"), "n_distinct", "n_values", "samples"
    )


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of ``row`` against the given values of ``column``."""
    return df.groupBy(row).agg(
        *[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values]
    )


def spot_checks(runs: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Failure rate inside each named subgroup against the overall rate, in one pass."""
    hits = F.filter(
        F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull()
    )
    inside = (
        runs.select(F.explode(hits).alias("subgroup"), "pass_fail")
        .groupBy("subgroup")
        .agg(F.count("*").alias("n"), fail_rate().alias("rate"))
    )
    overall = runs.agg(fail_rate()).scalar()
    return inside.select(
        "subgroup", "n", F.round("rate", 4).alias("fail_rate"), F.round(F.col("rate") / overall, 3).alias("ratio")
    )
