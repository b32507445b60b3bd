"""Writers: tables as CSV or Parquet, reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = ()) -> None:
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    writer.csv(path, header=True, escape='"') if fmt == "csv" else writer.format(fmt).save(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON document per row; not-a-number and infinities become null."""
    safe = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() in ("double", "float"):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        safe.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*safe)).alias("value"))


def write_reports(reports: dict[str, DataFrame], path: str) -> None:
    """Every report DataFrame below ``path/<name>`` as JSON lines."""
    for name, df in reports.items():
        as_json(df).write.mode("overwrite").text(f"{path}/{name}")
