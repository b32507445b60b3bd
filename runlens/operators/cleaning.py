"""Cleaning of messy run tables, driven by one-pass column profiles."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions import vocab
from ..functions.ordered import exact_quantiles
from ..functions.text import is_nullish, norm_token, verdict
from ..session import cut


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def is_id(name: str) -> bool:
    return name.lower() in vocab.ID_NAMES


def text_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_text(df, c)]


def long_form(df: DataFrame, columns: list[str], cast: str = "string") -> DataFrame:
    """``(field, value)`` rows of some columns."""
    return df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast(cast).alias("value")) for c in columns])
        ).alias("x")
    ).select("x.field", "x.value")


def trim_header(df: DataFrame) -> DataFrame:
    """Header without outer blanks; the first of equal names stays."""
    names = [c.strip() for c in df.columns]
    positional = df.toDF(*[f"_{i}" for i in range(len(names))])
    first = {}
    for i, n in enumerate(names):
        first.setdefault(n, i)
    return positional.select(*[F.col(f"_{i}").alias(n) for n, i in first.items()])


def blank_nullish(df: DataFrame) -> DataFrame:
    """Null-like words of text columns become null."""
    return df.withColumns(
        {c: F.when(~is_nullish(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in text_columns(df)}
    )


def numeric_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per text column: non-null values and how many of them parse as numbers."""
    number = F.expr("try_cast(trim(value) as double)")
    return (
        long_form(df, columns)
        .where("value is not null")
        .groupBy("field")
        .agg(F.count("*").alias("n"), F.count(number).alias("numeric"))
    )


def promote_numeric(
    df: DataFrame, threshold: float = 0.95
) -> tuple[DataFrame, list[str]]:
    """Text columns that are numbers in at least ``threshold`` of their values."""
    columns = text_columns(df)
    if not columns:
        return df, []
    found = numeric_share(df, columns).where(F.col("numeric") >= threshold * F.col("n")).collect()
    promoted = sorted(r["field"] for r in found)
    return df.withColumns({c: F.expr(f"try_cast(trim(`{c}`) as double)") for c in promoted}), promoted


def target_scores(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: share of known verdict words, both classes present, verdict-like name."""
    columns = columns or df.columns
    word = verdict(F.col("value"))
    scored = (
        long_form(df, columns)
        .where("value is not null")
        .groupBy("field")
        .agg(
            F.count("*").alias("n"),
            F.count(word).alias("known"),
            F.count_if(word == "pass").alias("n_pass"),
            F.count_if(word == "fail").alias("n_fail"),
        )
    )
    usable = (F.col("n_pass") > 0) & (F.col("n_fail") > 0)
    return scored.select(
        "field",
        "n",
        F.when(usable, F.col("known") / F.col("n")).otherwise(0.0).alias("score"),
        F.lower("field").rlike("|".join(vocab.VERDICT_KEYS)).alias("named"),
    )


def detect_target(df: DataFrame, explicit: str | None = None) -> str | None:
    """Verdict column: a verdict-like name first, then the best vocabulary score."""
    if explicit:
        if explicit not in df.columns:
            raise KeyError(f"target column '{explicit}' not in data")
        return explicit
    rows = [r for r in target_scores(df).collect() if r["score"] >= 0.9]
    place = {c: i for i, c in enumerate(df.columns)}
    rows.sort(key=lambda r: (not r["named"], -r["score"], place[r["field"]]))
    return rows[0]["field"] if rows else None


def normalize_target(df: DataFrame, target: str) -> DataFrame:
    """Rows with a known verdict, spelled ``pass`` or ``fail``."""
    return df.withColumn(target, verdict(F.col(f"`{target}`"))).where(F.col(f"`{target}`").isNotNull())


def rejected_targets(df: DataFrame, target: str) -> DataFrame:
    """Verdict words that are not in the vocabulary, with their counts."""
    raw = F.col(f"`{target}`").cast("string")
    return (
        df.where(~is_nullish(raw) & verdict(raw).isNull())
        .groupBy(raw.alias("value"))
        .agg(F.count("*").alias("n"))
    )


def canonicalize(df: DataFrame, target: str | None = None) -> DataFrame:
    """One spelling per value in text columns other than ids and the target."""
    names = [c for c in text_columns(df) if c != target and not is_id(c)]
    return df.withColumns({c: norm_token(F.col(f"`{c}`")) for c in names})


def merged_spellings(df: DataFrame, target: str | None = None) -> DataFrame:
    """Values that ``canonicalize`` merges: field, token, spellings, how many."""
    names = [c for c in text_columns(df) if c != target and not is_id(c)]
    spellings = long_form(df, names).where("value is not null").distinct()
    return (
        spellings.groupBy("field", norm_token(F.col("value")).alias("token"))
        .agg(F.count("*").alias("n_spellings"), F.array_sort(F.collect_set("value")).alias("spellings"))
        .where("n_spellings > 1")
    )


def apply_overrides(
    df: DataFrame,
    columns: dict[str, str] | None = None,
    values: dict[str, dict[str, str]] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Rename columns and map values (keys in any spelling). Absent columns are reported."""
    absent = sorted(set(columns or {}) - set(df.columns))
    df = df.withColumnsRenamed({k: v for k, v in (columns or {}).items() if k in df.columns})
    for name, mapping in (values or {}).items():
        if name not in df.columns:
            absent.append(name)
            continue
        tidy = {re.sub(r"_+", "_", re.sub(r"[\s\-]+", "_", k.strip().lower())).strip("_"): v for k, v in mapping.items()}
        table = F.create_map(*[F.lit(x) for kv in tidy.items() for x in kv])
        df = df.withColumn(name, F.coalesce(table[norm_token(F.col(f"`{name}`"))], F.col(f"`{name}`").cast("string")))
    return df, absent


def level_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``field, value, n`` for the non-null values of some columns."""
    return (
        long_form(df, columns)
        .where("value is not null")
        .groupBy("field", "value")
        .agg(F.count("*").alias("n"))
    )


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact distinct non-null values per column, from one shuffle of pre-counted values."""
    return level_counts(df, columns).groupBy("field").agg(F.count("*").alias("n_distinct"))


def approximate_distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    wide = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(c) for c in columns])
    return long_form(wide, columns, "long").withColumnRenamed("value", "n_distinct")


def cap_cardinality(
    df: DataFrame, target: str | None, max_levels: int = 40, drop_ratio: float = 0.9
) -> tuple[DataFrame, list[tuple[str, str, int]]]:
    """Drop constant and near-unique text columns; fold the tail of wide ones.

    Returns the frame and ``(column, action, levels)`` of every change.
    """
    names = [c for c in text_columns(df) if c != target and not is_id(c)]
    if not names:
        return df, []
    n = df.count()
    found = {r["field"]: r["n_distinct"] for r in distinct_counts(df, names).collect()}
    changes, wide = [], []
    for c in names:
        levels = found.get(c, 0)
        if levels <= 1:
            changes.append((c, "constant", levels))
        elif levels / n > drop_ratio:
            changes.append((c, "near_unique", levels))
        elif levels > max_levels:
            wide.append(c)
            changes.append((c, "capped", levels))
    df = df.drop(*[c for c, action, _ in changes if action != "capped"])
    if wide:
        rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
        kept = level_counts(df, wide).withColumn("r", rank).where(F.col("r") < max_levels)
        keep: dict[str, list[str]] = {c: [] for c in wide}
        for r in kept.select("field", "value").collect():  # at most max_levels - 1 per column
            keep[r["field"]].append(r["value"])
        df = df.withColumns(
            {
                c: F.when(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").isin(keep[c]), F.col(f"`{c}`")).otherwise(vocab.OTHER)
                for c in wide
            }
        )
    return df, changes


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and null (or not-a-number) values per column: one pass without a shuffle of rows."""

    def absent(c: str) -> Column:
        x = F.col(f"`{c}`")
        nan = df.schema[c].dataType.simpleString() in ("double", "float")
        return x.isNull() | F.isnan(x) if nan else x.isNull()

    wide = df.agg(*[F.count_if(absent(c)).alias(c) for c in columns], F.count("*").alias("_rows"))
    return wide.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("missing"), F.col("_rows").alias("n")) for c in columns])
        ).alias("x")
    ).select("x.*")


def handle_missing(
    df: DataFrame, target: str | None, max_ratio: float = 0.6
) -> tuple[DataFrame, list[tuple[str, str, int]]]:
    """Drop sparse columns; fill numbers with the median and text with a missing mark."""
    names = [c for c in df.columns if c != target]
    holes = {
        r["field"]: (r["missing"], r["n"])
        for r in missing_counts(df, names).where("missing > 0").collect()
    }
    changes, numeric, drops, fills = [], [], [], {}
    for c in names:
        if c not in holes:
            continue
        missing, n = holes[c]
        if missing / n > max_ratio:
            drops.append(c)
            changes.append((c, "dropped_sparse", missing))
        elif isinstance(df.schema[c].dataType, T.NumericType):
            numeric.append(c)
        else:
            fills[c] = vocab.MISSING
            changes.append((c, "filled_text", missing))
    if numeric:
        medians = exact_quantiles(long_form(df, numeric, "double"), [0.5])
        for r in medians.collect():
            fills[r["field"]] = r["q0"]
            changes.append((r["field"], "filled_median", holes[r["field"]][0]))
        for c in set(numeric) - set(fills):
            drops.append(c)
            changes.append((c, "dropped_empty", holes[c][0]))

    def filled(c: str) -> Column:
        x = F.col(f"`{c}`")
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            x = F.nanvl(x, F.lit(None).cast("double"))
        return F.coalesce(x, F.lit(fills[c]))

    return df.withColumns({c: filled(c) for c in fills}).drop(*drops), changes


def class_balance(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(F.col(f"`{target}`").alias("value")).agg(F.count("*").alias("n"))


@dataclass
class Report:
    """What a cleaning run saw and changed; schema-sized."""

    target: str = ""
    rows_in: int = 0
    rows_out: int = 0
    rejected: int = 0
    changes: list[tuple[str, str, int]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def frame(self, spark) -> DataFrame:
        head = [
            (self.target, "target", 0), ("", "rows_in", self.rows_in), ("", "rows_out", self.rows_out),
            ("", "rejected_verdicts", self.rejected),
        ]
        notes = [(w, "warning", 0) for w in self.warnings]
        return spark.createDataFrame(head + self.changes + notes, "field string, action string, n long")


def clean(
    df: DataFrame,
    target: str | None = None,
    column_overrides: dict[str, str] | None = None,
    value_overrides: dict[str, dict[str, str]] | None = None,
    max_levels: int = 40,
    max_missing_ratio: float = 0.6,
) -> tuple[DataFrame, Report]:
    """All cleaning steps in order. Raises when no usable verdict remains."""
    report = Report()
    df = blank_nullish(trim_header(df))
    df, promoted = promote_numeric(df)
    report.changes += [(c, "promoted_numeric", 0) for c in promoted]
    found = detect_target(df, target)
    if found is None:
        raise ValueError("No verdict column: none holds both passing and failing words.")
    raw = F.col(f"`{found}`").cast("string")
    unknown = ~is_nullish(raw) & verdict(raw).isNull()
    report.rows_in, report.rejected = df.agg(F.count("*"), F.count_if(unknown)).first()
    if report.rejected:
        report.warnings.append(f"{report.rejected} rows of '{found}' hold unknown verdict words")
    df = canonicalize(normalize_target(df, found), found)
    df, absent = apply_overrides(df, column_overrides, value_overrides)
    report.warnings += [f"override names absent column '{c}'" for c in absent]
    found = (column_overrides or {}).get(found, found)
    report.target = found
    # The profiling passes below read the normalised text instead of deriving it again.
    df = cut(df)
    classes = {r["value"]: r["n"] for r in class_balance(df, found).collect()}
    report.rows_out = sum(classes.values())
    if not classes:
        raise ValueError(f"No rows left after dropping unlabelled verdicts in '{found}'.")
    if len(classes) < 2:
        raise ValueError(f"Target '{found}' has a single class after cleaning: {classes}.")
    if min(classes.values()) < 20:
        report.warnings.append(f"only {min(classes.values())} rows in the minority class")
    df, capped = cap_cardinality(df, found, max_levels)
    df, filled = handle_missing(df, found, max_missing_ratio)
    report.changes += capped + filled
    if len(df.columns) < 2:
        raise ValueError("No predictor columns survived cleaning.")
    return df, report
