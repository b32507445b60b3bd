"""Joins of run-level tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .roles import complete_runs

# The first of these that exists is the base of the merge.
PRIORITY = ["outcomes", "config", "randomization", "telemetry", "transactions", "registers"]


def left_enrich(base: DataFrame, extra: DataFrame, key: str = "run_id") -> DataFrame:
    """Left join of the columns ``base`` lacks."""
    new = [c for c in extra.columns if c not in base.columns]
    return base.join(extra.select(key, *new), key, "left") if new else base


def duplicate_keys(tables: dict[str, DataFrame], key: str = "run_id") -> DataFrame:
    """Keys that occur more than once in a table that should hold one row per run."""
    parts = [
        df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n"))
        .where("n > 1").select(F.lit(name).alias("source"), "key", "n")
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_tables(tables: dict[str, DataFrame], check_keys: bool = True) -> DataFrame:
    """One run-level frame from category tables: left joins in priority order."""
    usable = {n: df for n, df in tables.items() if "run_id" in df.columns}
    names = [n for n in PRIORITY if n in usable] + [n for n in usable if n not in PRIORITY]
    if not names:
        raise ValueError("No table has a run_id column.")
    rolled = ("transactions", "registers")
    to_check = {n: usable[n] for n in names[1:] if n not in rolled}
    if check_keys and to_check:
        twice = duplicate_keys(to_check).limit(1).collect()
        if twice:
            raise ValueError(f"{twice[0]['source']}: run_id {twice[0]['key']} is not unique")
    out = usable[names[0]]
    for n in names[1:]:
        out = left_enrich(out, usable[n])
    return out


def restrict_errors(errors: DataFrame, runs: DataFrame) -> DataFrame:
    """Error lines of known runs; all of them when no id is shared at all."""
    known = errors.join(runs.select("run_id"), "run_id", "left_semi")
    return errors if known.isEmpty() else known


def combine(tables: dict[str, DataFrame], log_runs: DataFrame | None, errors: DataFrame | None):
    """``(runs, errors)`` from CSV tables, log runs, or both; tables win on equal columns."""
    merged = merge_tables(tables) if any("run_id" in t.columns for t in tables.values()) else None
    if merged is None:
        runs = log_runs
    elif log_runs is None:
        runs = merged
    else:
        runs = left_enrich(merged, log_runs)
        errors = restrict_errors(errors, runs) if errors is not None else None
    if runs is None:
        raise ValueError("Neither tables nor logs hold runs.")
    return complete_runs(runs), errors
