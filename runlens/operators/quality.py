"""Data-quality constraints. Every check is a frame ``name, ok, violations``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import vocab
from .summary import fail_rate, failed


def check(name: str, df: DataFrame, violation: Column) -> DataFrame:
    """Counts the rows that violate a condition."""
    bad = F.count_if(violation)
    return df.agg(bad.alias("violations")).select(F.lit(name).alias("name"), (F.col("violations") == 0).alias("ok"), "violations")


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)


def _known(spark: SparkSession, name: str, bad: int) -> DataFrame:
    return spark.createDataFrame([(name, bad == 0, bad)], "name string, ok boolean, violations long")


def difference(name: str, left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    missing = left.select(key).distinct().join(right.select(key), key, "left_anti")
    return check(name, missing, F.lit(True))


def keys_align(tables: dict[str, DataFrame], key: str = "run_id") -> DataFrame:
    """Key sets of all tables against the first one, both ways."""
    (base_name, base), *others = tables.items()
    return report([
        c for name, df in others for c in (
            difference(f"{name} only", df, base, key), difference(f"{base_name} missing in {name}", base, df, key)
        )
    ])


def shared_keys(left: DataFrame, right: DataFrame, key: str = "run_id") -> DataFrame:
    return left.select(key).intersect(right.select(key))


def files_declared(declared: DataFrame, found: DataFrame) -> DataFrame:
    """File names of a manifest against a listing (column ``name`` in both)."""
    return report([
        difference("declared files missing", declared, found, "name"),
        difference("undeclared files", found, declared, "name"),
    ])


def log_parses(stats: DataFrame, expected_runs: int) -> DataFrame:
    return report([
        check("expected number of runs", stats, F.col("runs") != expected_runs),
        stats.select(F.lit("malformed blocks").alias("name"), (F.col("malformed_blocks") == 0).alias("ok"), F.col("malformed_blocks").alias("violations")),
    ])


def columns_present(df: DataFrame, required: list[str]) -> DataFrame:
    return _known(df.sparkSession, "required columns", len(set(required) - set(df.columns)))


def leaked_columns(tables: dict[str, DataFrame], banned: list[str] | None = None) -> DataFrame:
    """Columns of input tables that carry names of derived measures."""
    banned = set(banned or vocab.DERIVED_COLUMNS)
    spark = next(iter(tables.values())).sparkSession
    return report([
        _known(spark, f"derived columns in {n}", len({c.strip().lower() for c in df.columns} & banned)) for n, df in tables.items()
    ])


def log_agrees(outcomes: DataFrame, log_runs: DataFrame) -> DataFrame:
    """Verdict and error counts of the outcome table against the log."""
    log = log_runs.select(
        "run_id", F.col("pass_fail").alias("_v"), F.col("uvm_error_total").alias("_e"), F.col("uvm_fatal_total").alias("_f")
    )
    both = outcomes.join(log, "run_id")
    return report([
        difference("outcomes without a log run", outcomes, log, "run_id"),
        check("verdict disagrees", both, F.col("pass_fail") != F.col("_v")),
        check("error count disagrees", both, F.col("uvm_error_count") != F.col("_e")),
        check("fatal count disagrees", both, F.col("uvm_fatal_count") != F.col("_f")),
    ])


def mismatches_reconcile(outcomes: DataFrame, transactions: DataFrame, bad: Column, expected: str = "scoreboard_mismatches") -> DataFrame:
    """Expected mismatch counts against counted rows; runs without rows count zero."""
    counted = transactions.where(bad).groupBy("run_id").agg(F.count("*").alias("_n"))
    joined = outcomes.join(counted, "run_id", "left")
    return check("mismatch counts disagree", joined, F.coalesce(expected, F.lit(0)) != F.coalesce("_n", F.lit(0)))


def starts_before_end(outcomes: DataFrame, transactions: DataFrame, end: Column, start: str = "start_time_ns") -> DataFrame:
    """Runs whose last child starts after the run has ended; runs lacking either side are skipped."""
    last = transactions.groupBy("run_id").agg(F.max(start).alias("_last"))
    ends = outcomes.select("run_id", end.alias("_end"))
    return check("child starts after its run ended", ends.join(last, "run_id"), F.coalesce(F.col("_last") > F.col("_end"), F.lit(False)))


def outcome_codes(outcomes: DataFrame) -> DataFrame:
    return report([
        check("passing runs with a failure type", outcomes, ~failed() & (F.col("failure_type") != "NONE")),
        check("failing runs without an error code", outcomes, failed() & (F.coalesce(F.length("error_code"), F.lit(0)) == 0)),
    ])


def tag_iff_fail(runs: DataFrame, tag: str = "error_type", none: str = "none") -> DataFrame:
    return report([
        check("passing rows with an error", runs, ~failed() & (F.col(tag) != none)),
        check("failing rows without an error", runs, failed() & (F.col(tag) == none)),
    ])


def rate_matches(runs: DataFrame, expected: float, tolerance: float = 0.0005) -> DataFrame:
    rate = runs.agg(F.round(fail_rate(), 4).alias("r"))
    return check("failure rate differs from the manifest", rate, F.abs(F.col("r") - expected) >= tolerance)


def rules_supported(support: DataFrame, min_rows: int = 25, min_share: float = 0.01, min_lift: float = 1.3) -> DataFrame:
    """Every rule has enough rows and enough lift."""
    return report([
        check("rules with too little support", support, (F.col("rows_matched") < min_rows) | (F.col("match_share") < min_share)),
        check("rules with weak lift", support, F.coalesce("lift", F.lit(0.0)) < min_lift),
    ])


def waveform_heads(
    spark: SparkSession, paths: str | list[str], declared: DataFrame, opening: str = "$date", depth: int = 1
) -> DataFrame:
    """Declared waveform files that are absent or do not open with ``$date``.

    ``declared.name`` holds the last ``depth`` components of the path.
    Rows of a split keep their order, so the smallest row id of a file's first split is its
    first line; nothing but that line is kept.
    """
    lines = spark.read.text(paths).select(
        F.substring_index("_metadata.file_path", "/", -depth).alias("name"),
        F.col("_metadata.file_block_start").alias("_at"), F.startswith("value", F.lit(opening)).alias("_ok"),
        F.monotonically_increasing_id().alias("_i"),
    )
    first = lines.where("_at = 0").groupBy("name").agg(F.min_by("_ok", "_i").alias("_ok"))
    joined = declared.select("name").join(first, "name", "left")
    return check("waveform missing or malformed", joined, ~F.coalesce("_ok", F.lit(False)))


def undo_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Rename aliased columns (``canonical -> alias``) back to their canonical names."""
    return df.withColumnsRenamed({alias: name for name, alias in aliases.items()})
