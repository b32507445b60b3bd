"""Helpers that several operators of this package share."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path

# Fixed value: what separates words everywhere in this package.
SPACES = "\t\n\x0b\x0c\r "
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: short lineage, safe against lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables that :func:`stored` wrote and nothing reads any more, with the shuffle files behind them."""
    for df in frames:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def small_or_plain(side: DataFrame, most_rows: int) -> DataFrame:
    """``side`` with a broadcast hint if it has at most ``most_rows`` rows; else left to a shuffled join.

    The rows are counted, so ``side`` should be stored. Results are the same either way.
    """
    return F.broadcast(side) if side.limit(most_rows + 1).count() <= most_rows else side


def buckets_for(rows: int, per_bucket: int = 20_000) -> int:
    return max(1, math.ceil(rows / per_bucket))


def running_start(df: DataFrame, group: Sequence[str], order: Sequence[str], weight: str, out: str, rows: int) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over all earlier rows of the same group.

    Rows of a group are ordered by a hash bucket and then by ``order``; each bucket holds some
    2,000 rows of ``rows``, so a group that holds most of the table is spread over many tasks. Only one
    total per (group, bucket) goes to the window over the whole group. ``order`` must tell rows apart
    unless they are interchangeable. ``df`` is read twice and should be stored.
    """
    n = buckets_for(rows, 2_000)
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    keys = [*group, "__bucket"]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(F.sum(weight).alias("__total"))
    totals = totals.select(*keys, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    ranked = df.withColumn("__inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    joined = ranked.alias("r").join(totals.alias("t"), [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    kept = [F.col(f"r.{c}") for c in ranked.columns if c not in ("__bucket", "__inside")]
    return joined.select(*kept, (F.col("t.__base") + F.col("r.__inside")).alias(out))
