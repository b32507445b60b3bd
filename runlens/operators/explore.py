"""Run explorer: filter, page and compare runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vocab
from ..session import cut

PAGE_LIMIT = 200
# Up to this many leading rows a top-k is cheap; deeper pages are located by counts.
TOP_ROWS = 100_000


def run_filter(
    df: DataFrame, search: str = "", status: str = "all", error_tag: str | None = None
) -> DataFrame:
    """Runs by verdict, error tag and case-insensitive part of id or test name."""
    if status in ("pass", "fail"):
        df = df.where(F.col("pass_fail") == status)
    if error_tag is not None:
        df = df.where(F.col("primary_error_tag") == error_tag)
    if search:
        needle = F.lit(search.lower())
        df = df.where(
            F.contains(F.lower(F.col("run_id").cast("string")), needle)
            | F.contains(F.lower(F.col("test_name").cast("string")), needle)
        )
    return df


def page(
    df: DataFrame, number: int = 0, size: int = 50, sort: str | None = None, descending: bool = False
) -> DataFrame:
    """One page, ordered by ``sort`` and then ``run_id``."""
    size = max(1, min(size, PAGE_LIMIT))
    start = max(0, number) * size
    key = F.col(sort) if sort and sort in df.columns else None
    order = [] if key is None else [key.desc_nulls_last() if descending else key.asc_nulls_last()]
    order.append(F.col("run_id").asc())
    if start + size <= TOP_ROWS:
        return df.orderBy(*order).offset(start).limit(size)
    # Deep page: sort in parallel, number rows per partition, keep the partitions' slices.
    ordered = df.orderBy(*order).withColumn("_p", F.spark_partition_id())
    # Materialised: sampling must not draw other partition bounds for the counts below.
    ordered = cut(ordered.withColumn("_i", F.monotonically_increasing_id()))
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    place = F.col("_b") + F.col("_i") - F.col("_first")
    return (
        ordered.join(F.broadcast(starts), "_p")
        .where((place >= start) & (place < start + size))
        .orderBy(*order)
        .drop("_p", "_i", "_n", "_first", "_b")
    )


def page_info(df: DataFrame, size: int = 50) -> DataFrame:
    size = max(1, min(size, PAGE_LIMIT))
    total = F.count("*")
    return df.agg(
        total.alias("total"),
        F.lit(size).alias("per_page"),
        F.greatest(F.lit(1).cast("long"), F.ceil(total / size)).alias("n_pages"),
    )


def field_rows(df: DataFrame, fields: list[str], keep: list[str]) -> DataFrame:
    """Long form ``keep.., field, value`` with values as text."""
    return df.select(
        *keep,
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields])
        ).alias("_x"),
    ).select(*keep, "_x.field", "_x.value")


def diff_runs(runs: DataFrame, run_a: str, run_b: str, fields: list[str] | None = None) -> DataFrame:
    """Field-by-field difference of two runs, outcomes told apart from settings."""
    fields = fields or [c for c in runs.columns if c != "error_trace"]
    two = runs.where(F.col("run_id").isin(run_a, run_b))
    rows = field_rows(two.withColumn("_id", F.col("run_id")), fields, ["_id"])
    # Two runs times the columns of the table: schema-sized.
    sides = rows.groupBy("field").agg(
        F.max(F.when(F.col("_id") == run_a, F.col("value"))).alias("run_a"),
        F.max(F.when(F.col("_id") == run_b, F.col("value"))).alias("run_b"),
        F.count_if(F.col("_id") == run_a).alias("_na"),
        F.count_if(F.col("_id") == run_b).alias("_nb"),
    ).where("_na > 0 and _nb > 0")
    return sides.select(
        "field",
        F.when(F.col("field").isin(vocab.DIFF_OUTCOMES), "outcome").otherwise("config").alias("kind"),
        "run_a",
        "run_b",
        (~F.col("run_a").eqNullSafe(F.col("run_b"))).alias("changed"),
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    changed = F.col("changed")
    return diff.agg(
        F.count_if(changed).alias("n_changed"),
        F.count_if(changed & (F.col("kind") == "config")).alias("n_config_changed"),
        F.count_if(changed & (F.col("kind") == "outcome")).alias("n_outcome_changed"),
    )
