"""Running totals, exact quantiles and exact splits without one-task windows.

A global ``OVER (ORDER BY ..)`` sends every row to one task. These helpers cut the
order into ranges first: a window runs inside each range, and the totals of the ranges
before it (one row per range and group) are added afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut



def _with_range(df: DataFrame, order: str, by: str | None) -> DataFrame:
    """Range-partition by the order and keep the partition number as ``_range``.

    Materialised: Spark samples the range bounds, and both users of ``_range`` below must see
    the same ones.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [by, order] if by else [order]
    return cut(df.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()))


def running(
    df: DataFrame,
    order: str,
    sums: list[str] = (),
    mins: list[str] = (),
    nexts: list[str] = (),
    by: str | None = None,
) -> DataFrame:
    """Add ``cum_<c>`` (inclusive sum), ``prior_min_<c>`` (minimum of earlier rows) and
    ``next_<c>`` (value of the following row).

    ``order`` must be numeric and distinct within its group, so pre-aggregate on it.
    """
    group = [by] if by else []
    ranged = _with_range(df, order, by)
    inside = Window.partitionBy(*group, "_range").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)

    totals = ranged.groupBy(*group, "_range").agg(
        *[F.sum(c).alias(f"_t_{c}") for c in sums],
        *[F.min(c).alias(f"_m_{c}") for c in mins],
        *[F.min_by(c, order).alias(f"_n_{c}") for c in nexts],
    )
    # One row per shuffle partition and group: a plain window is bounded here.
    ranges = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range")
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group,
        "_range",
        *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_t_{c}") for c in sums],
        *[F.min(f"_m_{c}").over(earlier).alias(f"_m_{c}") for c in mins],
        *[F.lead(f"_n_{c}").over(ranges).alias(f"_n_{c}") for c in nexts],
    )
    out = ranged.join(F.broadcast(offsets), [*group, "_range"])
    for c in sums:
        out = out.withColumn(f"cum_{c}", F.sum(c).over(upto) + F.col(f"_t_{c}"))
    for c in mins:
        out = out.withColumn(f"prior_min_{c}", F.least(F.min(c).over(before), F.col(f"_m_{c}")))
    for c in nexts:
        out = out.withColumn(f"next_{c}", F.coalesce(F.lead(c).over(inside), F.col(f"_n_{c}")))
    spare = [f"_t_{c}" for c in sums] + [f"_m_{c}" for c in mins] + [f"_n_{c}" for c in nexts]
    return out.drop("_range", *spare)


def exact_quantiles(long: DataFrame, probs: list[float], value: str = "value") -> DataFrame:
    """Linear-interpolated quantiles of a ``(field, value)`` frame.

    One row per field with ``n`` and ``q0..qk`` in the order of ``probs``. Values are counted before they are ordered, so no task holds a whole column.
    """
    counts = long.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy("field", value)
    return counted_quantiles(counts.agg(F.count("*").alias("n")), probs, value)


def counted_quantiles(counts: DataFrame, probs: list[float], value: str = "value") -> DataFrame:
    """The same for a frame ``field, value, n`` of already counted values."""
    counts = counts.select("field", F.col(value).alias("_v"), F.col("n").alias("_n"))
    ranged = _with_range(counts, "_v", "field")
    field = Window.partitionBy("field")
    earlier = field.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("field", "_range").agg(F.sum("_n").alias("_size")).select(
        "field", "_range", "_size", F.sum("_size").over(field).alias("_total"),
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
    )

    def ranks(p: float) -> list[Column]:
        position = F.lit(float(p)) * (F.col("_total") - 1)
        return [F.floor(position), F.ceil(position)]

    # Only ranges that hold a wanted rank are ordered.
    wanted = [
        (r >= F.col("_before")) & (r < F.col("_before") + F.col("_size")) for p in probs for r in ranks(p)
    ]
    hit = sizes.where(reduce(lambda a, b: a | b, wanted)).drop("_size")
    inside = Window.partitionBy("field", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.join(F.broadcast(hit), ["field", "_range"]).withColumn(
        "cum__n", F.sum("_n").over(inside) + F.col("_before")
    )

    def at(rank: Column) -> Column:
        hit = (rank >= F.col("cum__n") - F.col("_n")) & (rank < F.col("cum__n"))
        return F.max(F.when(hit, F.col("_v")))

    aggs = []
    for i, p in enumerate(probs):
        low, high = ranks(p)
        aggs += [at(low).alias(f"_lo{i}"), at(high).alias(f"_hi{i}")]
    found = ranked.groupBy("field").agg(F.max("_total").alias("n"), *aggs)
    cols = []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("n") - 1)
        share = position - F.floor(position)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        cols.append((lo + (hi - lo) * share).alias(f"q{i}"))
    return found.select("field", "n", *cols)


def shuffle_key(key: str, seed: int) -> Column:
    """Seeded hash that puts rows in a repeatable random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def exact_share(df: DataFrame, key: str, share: float, seed: int, by: str) -> DataFrame:
    """Add boolean ``picked``: exactly ``round(share * n)`` rows of every ``by`` level.

    Rows are taken in hash order of ``key``. The hash is uniform, so fixed-width hash ranges
    are balanced: only the one range in which a level's cut falls is ordered, and all rows
    are then compared with the cut. ``by`` has few levels (a verdict).
    """
    hashed = df.withColumn("_h", shuffle_key(key, seed))
    slim = hashed.select(by, "_h", F.col(key).alias("_k"), F.substring("_h", 1, 4).alias("_range"))
    level = Window.partitionBy(by)
    upto = level.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    sizes = slim.groupBy(by, "_range").agg(F.count("*").alias("_size"))
    split = (
        sizes.withColumn("_want", F.round(F.sum("_size").over(level) * share).cast("long"))
        .withColumn("_upto", F.sum("_size").over(upto))
        .where((F.col("_want") <= F.col("_upto")) & (F.col("_want") > F.col("_upto") - F.col("_size")))
        .select(by, "_range", (F.col("_want") - F.col("_upto") + F.col("_size")).alias("_left"))
    )
    cut = (
        slim.join(F.broadcast(split), [by, "_range"])
        .withColumn("_rank", F.row_number().over(level.orderBy("_h", "_k")))
        .where(F.col("_rank") == F.col("_left"))
        .select(by, F.col("_h").alias("_cut_h"), F.col("_k").alias("_cut_k"))
    )
    inside = (F.col("_h") < F.col("_cut_h")) | (
        (F.col("_h") == F.col("_cut_h")) & (F.col(key) <= F.col("_cut_k"))
    )
    return (
        hashed.join(F.broadcast(cut), by, "left")
        .withColumn("picked", F.coalesce(inside, F.lit(False)))
        .drop("_h", "_cut_h", "_cut_k")
    )
