"""Column roles, leakage-safe features and completion of the run table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions import vocab
from ..functions.text import outcome
from ..sources.tables import hash_numbered
from .cleaning import distinct_counts, is_text, level_counts


def outcome_like(name: str, target: str) -> bool:
    n = name.lower()
    return n == target.lower() or any(k in n for k in vocab.OUTCOME_KEYWORDS)


def column_facts(df: DataFrame) -> DataFrame:
    """``field, n_distinct, n, fail_word``: what role detection looks at, in one aggregate."""
    levels = level_counts(df, df.columns)
    word = F.lower(F.trim(F.col("value")))
    facts = levels.groupBy("field").agg(
        F.count("*").alias("n_distinct"), F.bool_or(word.isin(vocab.TARGET_FAIL)).alias("fail_word")
    )
    return facts.withColumn("n", df.agg(F.count("*")).scalar())


def detect_roles(df: DataFrame) -> dict[str, list[str]]:
    """Column names by role: identifier, target, outcome, categorical, numeric."""
    facts = {r["field"]: r for r in column_facts(df).collect()}
    roles = {k: [] for k in ("identifier", "target", "outcome", "categorical", "numeric")}
    rest = []
    for c in df.columns:
        f = facts.get(c)
        unique = f is not None and f["n_distinct"] / max(f["n"], 1) > 0.95
        (roles["identifier"] if c.lower() in vocab.ID_NAMES or (is_text(df, c) and unique) else rest).append(c)
    target = next(
        (c for c in rest if c in facts and facts[c]["n_distinct"] == 2 and facts[c]["fail_word"]), None
    )
    if target is None:
        raise ValueError("No binary target: one column must hold two values, one of them failing.")
    roles["target"].append(target)
    for c in rest:
        if c == target:
            continue
        levels = facts[c]["n_distinct"] if c in facts else 0
        whole = isinstance(df.schema[c].dataType, (T.IntegerType, T.LongType))
        if outcome_like(c, target):
            roles["outcome"].append(c)
        elif is_text(df, c) or (whole and levels <= 10):
            roles["categorical"].append(c)
        else:
            roles["numeric"].append(c)
    return roles


def role_table(df: DataFrame) -> DataFrame:
    rows = [(c, role) for role, names in detect_roles(df).items() for c in names]
    return df.sparkSession.createDataFrame(rows, "field string, role string")


def select_features(df: DataFrame, leaky: list[str] = ()) -> list[str]:
    """Names of the settings an engineer can choose: no outcomes, ids or named leaks."""
    banned = {*vocab.OUTCOME_COLUMNS, *vocab.NOT_FEATURES, *leaky}
    return [c for c in df.columns if c not in banned]


def encode_target(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string"))).isin(vocab.TARGET_FAIL).cast("int")


def complete_runs(df: DataFrame) -> DataFrame:
    """Fill in the columns every analysis expects. Unknown verdict words count as passing."""
    if "run_id" not in df.columns:
        df = hash_numbered(df)
    if "pass_fail" not in df.columns:
        source = next(
            (c for c in df.columns if c.lower() in ("verdict", "status", "result", "outcome")), None
        )
        df = df.withColumn("pass_fail", outcome(F.col(source)) if source else F.lit("pass"))
    word = F.lower(F.coalesce(F.col("pass_fail").cast("string"), F.lit("pass")))
    df = df.withColumn("pass_fail", F.when(word.isin(vocab.RUN_FAIL), "fail").otherwise("pass"))
    failed = F.col("pass_fail") == "fail"
    if "test_name" not in df.columns:
        df = df.withColumn("test_name", F.lit("unknown_test"))
    if "primary_error_tag" not in df.columns:
        names = ["failure_class", "failure_type", "error_tag", "error_type", "tag", "err_type", "err_class"]
        source = next((c for c in names if c in df.columns), None)
        if source:
            raw = F.coalesce(F.col(source).cast("string"), F.lit("NONE"))
            tag = F.when(F.upper(raw).isin("NONE", "OK", "NAN", "", "NULL"), "NONE").otherwise(raw)
        else:
            tag = F.when(failed, "UNKNOWN_ERROR").otherwise("NONE")
        df = df.withColumn("primary_error_tag", tag)
    defaults = {
        "trace_fingerprint": F.when(failed, F.col("primary_error_tag").cast("string")).otherwise("CLEAN"),
        "error_trace": F.lit(""),
        "distinct_error_tags": (F.col("primary_error_tag") != "NONE").cast("int"),
        "verdict": F.when(failed, "FAILED").otherwise("PASSED"),
    }
    return df.withColumns({n: c for n, c in defaults.items() if n not in df.columns})
