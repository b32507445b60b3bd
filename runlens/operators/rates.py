"""Failure rates by setting and by combination of settings."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.ordered import counted_quantiles
from ..session import cut
from .cleaning import long_form
from .summary import fail_rate, failed


def numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def number_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``field, value, n`` of numeric columns: the one pass over the rows that binning needs."""
    long = long_form(df, columns, "double").where("value is not null and not isnan(value)")
    return cut(long.groupBy("field", "value").agg(F.count("*").alias("n")))


def bin_edges(counts: DataFrame, bins: int) -> dict[str, list[float]]:
    """Equal-frequency edges per field, duplicates dropped: at most ``bins + 1`` numbers each."""
    found = counted_quantiles(counts, [i / bins for i in range(bins + 1)])
    return {r["field"]: sorted({r[f"q{i}"] for i in range(bins + 1)}) for r in found.collect()}


def bin_index(value: Column, edges: list[float]) -> Column:
    """1-based number of the right-closed bin; the lowest edge belongs to the first bin."""
    inner = edges[1:-1]
    number = F.lit(1)
    for e in inner:
        number = number + (value > F.lit(e)).cast("int")
    return F.when(value.isNotNull(), number)


def binned(
    df: DataFrame, columns: list[str], max_levels: int, bins: int
) -> tuple[DataFrame, dict[str, list[float]]]:
    """Replace wide numeric columns by bin labels ``q1..qk``; the rest become text."""
    numbers = [c for c in columns if numeric(df, c)]
    edges: dict[str, list[float]] = {}
    if numbers:
        counts = number_counts(df, numbers)
        sizes = counts.groupBy("field").agg(F.count("*").alias("k")).collect()
        wide = [r["field"] for r in sizes if r["k"] > max_levels]
        edges = bin_edges(counts.where(F.col("field").isin(wide)), bins) if wide else {}
    labels = {
        c: F.concat(F.lit("q"), bin_index(F.col(c).cast("double"), edges[c])) if c in edges
        else F.col(c).cast("string")
        for c in columns
    }
    return df.withColumns(labels), edges


def rate_by_field(
    runs: DataFrame, features: list[str], max_levels: int = 12, bins: int = 5
) -> DataFrame:
    """Failure rate and lift per level of each setting, with the spread of each setting.

    Numeric settings with more than ``max_levels`` values are cut into equal-frequency bins
    whose bounds come back as ``low`` and ``high``.
    """
    labelled, edges = binned(runs, features, max_levels, bins)
    rows = labelled.select(
        "pass_fail",
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("level")) for f in features])
        ).alias("x"),
    ).select("x.field", "x.level", "pass_fail")
    levels = rows.groupBy("field", "level").agg(
        F.count("*").alias("n"), F.count_if(failed()).alias("fails"), fail_rate().alias("_rate")
    )
    overall = runs.agg(fail_rate()).scalar()
    # Levels are few per field; the spread is an aggregate of aggregates.
    rated = levels.withColumn("fail_rate", F.round("_rate", 4))
    spread = rated.groupBy("field").agg(
        F.round(F.max("fail_rate") - F.min("fail_rate"), 4).alias("spread")
    )
    bounds = F.lit(None).cast("array<double>")
    for name, e in edges.items():
        at = F.regexp_extract("level", r"^q(\d+)$", 1).cast("int")
        pair = F.array(*map(F.lit, e))
        bounds = F.when(F.col("field") == name, F.slice(pair, F.coalesce(at, F.lit(1)), F.lit(2))).otherwise(bounds)
    return rated.join(spread, "field").select(
        "field", "level", bounds[0].alias("low"), F.try_element_at(bounds, F.lit(2)).alias("high"),
        "n", "fails", "fail_rate", F.round(F.col("_rate") / F.nullif(overall, F.lit(0.0)), 3).alias("lift"), "spread",
    )


def ranked_fields(rates: DataFrame) -> DataFrame:
    """Fields by spread, levels by rate: the order in which a report shows them."""
    return rates.orderBy(F.desc("spread"), "field", F.desc("fail_rate"), "level")


def interactions(
    runs: DataFrame,
    features: list[str],
    min_support: int = 10,
    max_order: int = 3,
    min_lift: float = 1.2,
    bins: int = 3,
) -> DataFrame:
    """Failure rate of every 2- to ``max_order``-way combination of setting levels.

    Runs collapse to one row per full combination first; the grouping sets then expand those
    cells instead of the runs.
    """
    labelled, _ = binned(runs, features, bins, bins)
    cells = labelled.groupBy(*features).agg(
        F.count("*").alias("_n"), F.count_if(failed()).alias("_f")
    )
    orders = range(2, min(max_order, len(features)) + 1)
    sets = [list(c) for k in orders for c in combinations(features, k)]
    overall = runs.agg(fail_rate()).scalar()
    grouped = cells.groupingSets(sets, *features).agg(
        F.sum("_n").alias("support"),
        F.sum("_f").alias("_fails"),
        F.grouping_id(*features).alias("_gid"),
    )
    width = len(features)
    used = [
        F.when(F.col("_gid").bitwiseAND(1 << (width - 1 - i)) == 0, i) for i in range(width)
    ]
    member = lambda text: F.array_compact(F.array(*[F.when(u.isNotNull(), t) for u, t in zip(used, text)]))
    names = member([F.lit(f) for f in features])
    pairs = member([F.concat(F.lit(f + "="), F.coalesce(F.col(f), F.lit("null"))) for f in features])
    rate = F.col("_fails") / F.col("support")
    return (
        grouped.where((F.col("support") >= min_support) & (rate > min_lift * overall))
        .select(
            F.array_join(names, ",").alias("features"),
            F.array_join(pairs, " AND ").alias("conditions"),
            F.size(names).alias("order"),
            "support",
            F.round(rate, 4).alias("fail_rate"),
            F.round(overall, 4).alias("baseline_fail_rate"),
            F.round(rate / overall, 2).alias("lift"),
        )
    )


def feature_frequency(found: DataFrame, top: int = 30) -> DataFrame:
    """How often each setting occurs among the strongest combinations."""
    best = found.orderBy(F.desc("lift"), F.desc("support"), "conditions").limit(top)
    return best.select(F.explode(F.split("features", ",")).alias("feature")).groupBy("feature").agg(
        F.count("*").alias("appearances")
    )
