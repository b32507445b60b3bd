"""Run logs: one text block per run, parsed with column expressions.

The reader splits files at the banner line, so every block is one row of a splittable
scan and parsing needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import mask

BANNER = "UVM SIMULATION LOG :: "
ISSUE_LINE = r"^UVM_(ERROR|FATAL)\s+@\s+(\d+)\s+ns:\s+(\S+)\s+\[([A-Z0-9_]+)\]\s+(.*)$"
REPORT_LINE = r"^UVM_(INFO|WARNING|ERROR|FATAL)\s+@\s+\d+\s+ns:\s+\S+\s+\[[A-Z0-9_]+\]\s+.*$"
COUNT_LINE = r"^UVM_(INFO|WARNING|ERROR|FATAL)\s*:\s*(\d+)\s*$"
VERDICT_LINE = r"(?m)^\*\* TEST (PASSED|FAILED) \*\*[^\S\n]*$"
NO_ERRORS = "array<struct<severity:string,time_ns:bigint,component:string,tag:string,message:string,fingerprint:string>>"
ERROR_COLUMNS = ["run_id", "severity", "time_ns", "component", "tag", "message", "fingerprint"]
TRAILING = [
    "verdict", "pass_fail", "uvm_error_total", "uvm_fatal_total", "uvm_warning_total",
    "primary_error_tag", "distinct_error_tags", "trace_fingerprint", "error_trace",
]


def read_blocks(spark: SparkSession, paths: str | list[str], below: bool = False) -> DataFrame:
    """One row per banner-delimited block of the log files.

    With ``below``, ``paths`` are folders and all ``.log`` files at any depth are read, in any case of the suffix.
    """
    reader = spark.read.option("lineSep", "\n" + BANNER)
    if below:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[lL][oO][gG]")
    raw = reader.text(paths)
    return raw.select("value", F.col("_metadata.file_path").alias("file"))


def split_blocks(texts: DataFrame, column: str = "value") -> DataFrame:
    """The same rows from texts already held in a column (one text may hold many blocks)."""
    parts = F.split(F.concat(F.lit("\n"), F.col(column)), "\n" + BANNER)
    first = F.struct(
        F.substring(F.element_at(parts, 1), 2, 2**31 - 1).alias("value"), F.lit(True).alias("head")
    )
    rest = F.transform(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.struct(p.alias("value"), F.lit(False).alias("head")),
    )
    rows = texts.select(F.explode(F.concat(F.array(first), rest)).alias("b"))
    return rows.where(~F.col("b.head") | (F.col("b.value") != "")).select("b.value", "b.head")


def _section(block: Column, name: str) -> Column:
    # The last section of a name counts.
    pattern = rf"(?s).*\n\[{name}\]\n(.*?)\n?\[/{name}\](?=\n|$)"
    return F.regexp_replace(F.regexp_extract(block, pattern, 1), "\n", "")


def _without_sections(block: Column) -> Column:
    return F.regexp_replace(block, r"(?s)\n\[(CONFIG|METRICS)\]\n.*?\[/\1\](?=\n|$)", "")


def parse_blocks(blocks: DataFrame) -> DataFrame:
    """Parse blocks into ``run_id, config, metrics, payload flags, errors, totals, verdict``.

    ``config`` and ``metrics`` hold the JSON objects as text; ``errors`` is ordered.
    """
    text = F.when(F.contains("value", F.lit("\r")), F.regexp_replace("value", "\r\n?", "\n")).otherwise(F.col("value"))
    starts = F.startswith(text, F.lit(BANNER))
    text = F.when(starts, F.substring(text, len(BANNER) + 1, 2**31 - 1)).otherwise(text)
    # Text before the first banner of a file: separators only, or marked by split_blocks.
    lead = text.rlike(r"^(=|---|\n|$)") | (
        text.rlike(r"^\S+[^\S\n]+\S") & ~F.contains(text, F.lit("\n[CONFIG]\n"))
    )
    if "head" in blocks.columns:
        lead = F.col("head") & ~starts
    staged = (
        blocks.select(F.concat(F.lit("\n"), text).alias("block"), lead.alias("lead"))
        .withColumn("run_id", F.when(~F.col("lead"), F.trim(F.regexp_extract("block", r"^\n([^\n]*)", 1))))
        .withColumn("config", _section(F.col("block"), "CONFIG"))
        .withColumn("metrics", _section(F.col("block"), "METRICS"))
        .withColumn("lines", F.split(_without_sections(F.col("block")), "\n"))
    )
    staged = staged.withColumn("uvm", F.filter("lines", lambda l: l.startswith("UVM_")))
    parsed = staged.withColumn(
        "errors",
        F.transform(
            # Cheap prefix tests spare most lines the regular expressions.
            F.filter("uvm", lambda l: (l.startswith("UVM_E") | l.startswith("UVM_F")) & l.rlike(ISSUE_LINE)),
            lambda l: F.struct(
                F.regexp_extract(l, ISSUE_LINE, 1).alias("severity"),
                F.regexp_extract(l, ISSUE_LINE, 2).cast("long").alias("time_ns"),
                F.regexp_extract(l, ISSUE_LINE, 3).alias("component"),
                F.regexp_extract(l, ISSUE_LINE, 4).alias("tag"),
                F.regexp_extract(l, ISSUE_LINE, 5).alias("message"),
                mask(F.regexp_extract(l, ISSUE_LINE, 5)).alias("fingerprint"),
            ),
        ),
    )

    def total(severity: str) -> Column:
        pattern = rf"^UVM_{severity}\s*:\s*(\d+)\s*$"
        hits = F.filter("uvm", lambda l: l.startswith(f"UVM_{severity}") & l.rlike(pattern))
        return F.coalesce(
            F.regexp_extract(F.try_element_at(hits, F.lit(-1)), pattern, 1).cast("int"), F.lit(0)
        )

    verdicts = F.filter("lines", lambda l: l.startswith("**") & l.rlike(VERDICT_LINE))
    other = F.filter(
        "lines",
        lambda l: (l != "")
        & ~l.startswith("=") & ~l.startswith("---") & ~l.startswith("**")
        & ~(l.startswith("UVM_") & (l.rlike(REPORT_LINE) | l.rlike(COUNT_LINE))),
    )
    return parsed.select(
        "run_id",
        "config",
        "metrics",
        "errors",
        total("ERROR").alias("uvm_error_total"),
        total("FATAL").alias("uvm_fatal_total"),
        total("WARNING").alias("uvm_warning_total"),
        F.coalesce(
            F.nullif(
                F.regexp_extract(F.try_element_at(verdicts, F.lit(-1)), VERDICT_LINE, 1), F.lit("")
            ),
            F.lit("UNKNOWN"),
        ).alias("verdict"),
        # The banner line itself is not an unparsed line.
        (F.size(other) - F.when(F.col("lead") | (F.col("run_id") == ""), 0).otherwise(
            F.when(F.get("lines", F.lit(1)).rlike(r"^(=|---|\*\*|$)"), 0).otherwise(1)
        )).alias("unparsed"),
    )


def is_run(blocks: DataFrame) -> Column:
    """A block is a run when it has an id and a non-empty configuration object."""
    # One look at the payload: null for anything but a well-formed object.
    keys = F.coalesce(F.size(F.json_object_keys("config")), F.lit(-1))
    return (F.coalesce(F.col("run_id"), F.lit("")) != "") & (keys > 0)


def errors_of(parsed: DataFrame) -> DataFrame:
    """One row per ERROR/FATAL line of the runs."""
    return (
        parsed.where(is_run(parsed))
        .select("run_id", F.posexplode("errors").alias("pos", "e"))
        .select("run_id", "e.*")
        .select(*ERROR_COLUMNS)
    )


def _promoted(spark_type: str) -> str | None:
    if spark_type in ("BIGINT", "BOOLEAN", "STRING", "DOUBLE"):
        return spark_type.lower()
    if spark_type.startswith("DECIMAL") or spark_type == "FLOAT":
        return "double"
    return None if spark_type == "VOID" else "string"


def discover_fields(parsed: DataFrame) -> dict[str, str]:
    """Names and types of all configuration and metric keys, from one aggregate."""
    both = F.array("config", "metrics")
    payloads = parsed.where(is_run(parsed)).select(F.explode(both).alias("p"))
    kind = (
        payloads.select(F.try_parse_json("p").alias("v"))
        .where("v is not null")
        .agg(F.schema_of_variant_agg("v").alias("s"))
        .first()["s"]
    )
    if not kind or not kind.startswith("OBJECT<"):
        return {}
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(
        kind.removeprefix("OBJECT<").removesuffix(">").replace("OBJECT<", "STRUCT<").replace("VARIANT", "STRING")
    )
    out = {}
    for f in schema.fields:
        name = f.dataType.simpleString().upper()
        promoted = _promoted(name)
        if f.name not in ("run_id", *TRAILING):
            out[f.name] = promoted or "string"
    return out


def runs_of(parsed: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """One row per run: promoted configuration and metric columns plus the trace columns.

    Pass ``fields`` (name to type) to skip the discovery pass.
    """
    fields = discover_fields(parsed) if fields is None else fields
    tags = F.transform("errors", lambda e: e["tag"])
    prints = F.array_distinct(F.transform("errors", lambda e: e["fingerprint"]))
    base = (
        parsed.where(is_run(parsed))
        .withColumn("_c", F.try_parse_json("config"))
        .withColumn("_m", F.try_parse_json("metrics"))
    )

    def promoted(name: str, kind: str) -> Column:
        path = '$["' + name.replace('"', '\\"') + '"]'
        return F.coalesce(
            F.try_variant_get("_m", path, kind), F.try_variant_get("_c", path, kind)
        ).alias(name)

    return base.select(
        "run_id",
        *[promoted(n, k) for n, k in fields.items()],
        "verdict",
        F.when(F.col("verdict") == "FAILED", "fail").otherwise("pass").alias("pass_fail"),
        "uvm_error_total",
        "uvm_fatal_total",
        "uvm_warning_total",
        F.coalesce(F.get(tags, F.lit(0)), F.lit("NONE")).alias("primary_error_tag"),
        F.size(F.array_distinct(tags)).alias("distinct_error_tags"),
        F.when(F.size("errors") == 0, "CLEAN")
        .otherwise(F.array_join(prints, " || "))
        .alias("trace_fingerprint"),
        F.array_join(F.transform("errors", lambda e: e["message"]), " ").alias("error_trace"),
    )


def parse_stats(parsed: DataFrame) -> DataFrame:
    """Counters of one parse. A bad block counts once, whatever is wrong with it."""
    run = is_run(parsed)
    block = (F.coalesce(F.col("run_id"), F.lit("")) != "") | (F.col("config") != "")
    bad_metrics = (F.col("metrics") != "") & F.json_object_keys("metrics").isNull()
    return parsed.agg(
        F.count_if(run).alias("runs"),
        F.coalesce(F.sum(F.when(run, F.size("errors"))), F.lit(0)).alias("error_lines"),
        F.count_if((block & ~run) | (run & bad_metrics)).alias("malformed_blocks"),
        F.coalesce(F.sum("unparsed"), F.lit(0)).cast("long").alias("unparsed_lines"),
    )


def line_count(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files and lines of a corpus (a scan of its own: blocks do not keep file ends)."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("f"))
    per_file = lines.groupBy("f").agg(F.count("*").alias("n"))
    return per_file.agg(F.count("*").alias("files"), F.sum("n").alias("lines"))


def read_logs(
    spark: SparkSession, paths: str | list[str], fields: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(runs, errors, stats)`` of log files."""
    parsed = parse_blocks(read_blocks(spark, paths))
    return runs_of(parsed, fields), errors_of(parsed), parse_stats(parsed)
