"""The driver tables seen as a corpus of verification runs, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import spread

FEATURES = ["test_name", "priority", "nation", "month", "year", "balance"]
KNOBS = ["priority", "nation", "month", "year", "balance"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def run_key(column: str):
    return F.concat(F.lit("RUN-"), F.lpad(F.col(column).cast("string"), 12, "0"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order: settings from order and customer, verdict from the order status."""
    o, c = spread(table(spark, sf, "orders")), table(spark, sf, "customer")
    bad = F.col("o_orderstatus") == "F"
    return o.join(c, o.o_custkey == c.c_custkey).select(
        run_key("o_orderkey").alias("run_id"),
        F.col("c_mktsegment").alias("test_name"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_nationkey").alias("nation"),
        F.month("o_orderdate").alias("month"),
        F.year("o_orderdate").alias("year"),
        F.col("c_acctbal").alias("balance"),
        F.col("o_custkey").alias("seed"),
        F.when(bad, "fail").otherwise("pass").alias("pass_fail"),
        F.col("o_totalprice").alias("throughput_mbps"),
        (F.col("o_totalprice") / (10 + F.col("c_nationkey"))).alias("execution_time_ms"),
        F.floor("o_totalprice").alias("cycles"),
        F.when(bad, F.concat(F.lit("TAG_"), F.col("c_nationkey") % 5)).otherwise("NONE").alias("primary_error_tag"),
        ((F.when(bad, 300).otherwise(0) + (F.col("o_orderkey") * 7919) % 700) / 1000).alias("risk"),
    )


RUNS_SQL = """runs AS (
  SELECT 'RUN-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS run_id,
    c_mktsegment AS test_name, o_orderpriority AS priority, c_nationkey AS nation,
    CAST(month(o_orderdate) AS INTEGER) AS month, CAST(year(o_orderdate) AS INTEGER) AS year,
    c_acctbal AS balance, o_custkey AS seed,
    CASE WHEN o_orderstatus = 'F' THEN 'fail' ELSE 'pass' END AS pass_fail,
    o_totalprice AS throughput_mbps, o_totalprice / (10 + c_nationkey) AS execution_time_ms,
    CAST(floor(o_totalprice) AS BIGINT) AS cycles,
    CASE WHEN o_orderstatus = 'F' THEN 'TAG_' || (c_nationkey % 5) ELSE 'NONE' END AS primary_error_tag,
    CAST((CASE WHEN o_orderstatus = 'F' THEN 300 ELSE 0 END) + (o_orderkey * 7919) % 700 AS DOUBLE) / 1000 AS risk
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def errors(spark: SparkSession, sf: str) -> DataFrame:
    """Error lines: one per error event, with an address and numbers in the message."""
    from ..functions.text import mask

    e = table(spark, sf, "events").where("event_type = 'error'")
    message = F.concat(
        F.lit("wr_ptr=0x"), F.lower(F.hex("event_id")), F.lit(" lane "), F.col("user_id") % 7,
        F.lit(" depth "), F.get_json_object("props", "$.k"), F.lit(" unit u"), F.col("user_id") % 3,
    )
    return e.select(
        run_key("user_id").alias("run_id"),
        F.when(F.col("value") > 60, "FATAL").otherwise("ERROR").alias("severity"),
        F.col("event_id").alias("time_ns"),
        F.concat(F.lit("top.env.a"), F.col("user_id") % 4).alias("component"),
        F.concat(F.lit("TAG_"), F.col("user_id") % 5).alias("tag"),
        message.alias("message"),
        mask(message).alias("fingerprint"),
    )


ERRORS_SQL = """errors AS (
  SELECT 'RUN-' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS run_id,
    CASE WHEN value > 60 THEN 'FATAL' ELSE 'ERROR' END AS severity, event_id AS time_ns,
    'top.env.a' || (user_id % 4) AS component, 'TAG_' || (user_id % 5) AS tag,
    'wr_ptr=0x' || lower(to_hex(event_id)) || ' lane ' || (user_id % 7) || ' depth ' ||
      json_extract_string(props, '$.k') || ' unit u' || (user_id % 3) AS message,
    'wr_ptr=<ADDR> lane <N> depth <N> unit u' || (user_id % 3) AS fingerprint
  FROM events WHERE event_type = 'error')"""


def log_text(spark: SparkSession, sf: str) -> DataFrame:
    """One run-log block per order, as text, with up to three error lines."""
    o = spread(table(spark, sf, "orders"))
    bad = F.col("o_orderstatus") == "F"
    n = F.when(bad, 1 + F.col("o_orderkey") % 3).otherwise(0)
    one = lambda i: F.concat(
        F.when((i == 3), "UVM_FATAL @ ").otherwise("UVM_ERROR @ "),
        (F.col("o_custkey") * 10 + i).cast("string"),
        F.lit(" ns: top.env.a"), (F.col("o_custkey") % 4).cast("string"),
        F.lit(" [TAG_"), ((F.col("o_orderkey") + i) % 3).cast("string"),
        F.lit("] addr=0x"), F.lower(F.hex("o_orderkey")), F.lit("  lane "), i.cast("string"),
        F.lit(" of u"), ((F.col("o_orderkey") + i) % 2).cast("string"),
    )
    lines = F.when(n > 0, F.transform(F.sequence(F.lit(1), n.cast("int")), one)).otherwise(
        F.array().cast("array<string>")
    )
    bar = "=" * 64
    config = F.to_json(
        F.struct(
            F.col("o_orderpriority").alias("test_name"),
            (F.col("o_custkey") % 9).alias("queue_depth"),
            (F.col("o_custkey") % 2 + 0.5).alias("voltage"),
        )
    )
    metrics = F.to_json(F.struct(F.col("o_totalprice").alias("throughput_mbps")))
    text = F.concat_ws(
        "\n",
        F.lit(bar), F.concat(F.lit("UVM SIMULATION LOG :: "), run_key("o_orderkey")), F.lit(bar),
        F.lit("[CONFIG]"), config, F.lit("[/CONFIG]"),
        F.lit("UVM_INFO @ 0 ns: reporter [RNTST] Running test"),
        F.when(F.size(lines) > 0, F.array_join(lines, "\n")),
        F.when(F.col("o_orderkey") % 10 == 0, "stray output"),
        F.lit("[METRICS]"), metrics, F.lit("[/METRICS]"),
        F.lit("--- UVM Report Summary ---"),
        F.concat(F.lit("UVM_ERROR   :    "), F.least(n, F.lit(2)).cast("string")),
        F.concat(F.lit("UVM_FATAL   :    "), F.greatest(n - 2, F.lit(0)).cast("string")),
        F.when(bad, "** TEST FAILED **").when(F.col("o_orderstatus") == "O", "** TEST PASSED **"),
    )
    return o.select(text.alias("value"))
