"""Run-log queries. Blocks are rendered from orders, so the SQL knows what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import logs
from .corpus import log_text
from .registry import query

# What the rendered blocks contain, computed from the orders directly.
LOG_SQL = """lg AS (SELECT *, 'RUN-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS run_id, lower(to_hex(o_orderkey)) AS hx,
  CASE WHEN o_orderstatus = 'F' THEN 1 + o_orderkey % 3 ELSE 0 END AS n FROM orders),
el AS (SELECT run_id, i, CASE WHEN i = 3 THEN 'FATAL' ELSE 'ERROR' END AS severity, o_custkey * 10 + i AS time_ns,
  'top.env.a' || (o_custkey % 4) AS component, 'TAG_' || ((o_orderkey + i) % 3) AS tag,
  'addr=0x' || hx || '  lane ' || i || ' of u' || ((o_orderkey + i) % 2) AS message,
  'addr=<ADDR> lane <N> of u' || ((o_orderkey + i) % 2) AS fingerprint
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM lg))"""

RUN_ROWS = f"""WITH {LOG_SQL},
tr AS (SELECT run_id, string_agg(message, ' ' ORDER BY i) AS error_trace, count(DISTINCT tag) AS k FROM el GROUP BY 1)
SELECT lg.run_id, o_orderpriority AS test_name, o_custkey % 9 AS queue_depth, o_custkey % 2 + CAST(0.5 AS DOUBLE) AS voltage, o_totalprice AS throughput_mbps,
  CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'PASSED' ELSE 'UNKNOWN' END AS verdict,
  CASE o_orderstatus WHEN 'F' THEN 'fail' ELSE 'pass' END AS pass_fail,
  CAST(least(n, 2) AS INTEGER) AS uvm_error_total, CAST(greatest(n - 2, 0) AS INTEGER) AS uvm_fatal_total, CAST(0 AS INTEGER) AS uvm_warning_total,
  CASE WHEN n > 0 THEN 'TAG_' || ((o_orderkey + 1) % 3) ELSE 'NONE' END AS primary_error_tag, CAST(coalesce(k, 0) AS INTEGER) AS distinct_error_tags,
  CASE WHEN n = 0 THEN 'CLEAN' WHEN n = 1 THEN 'addr=<ADDR> lane <N> of u' || ((o_orderkey + 1) % 2)
    ELSE 'addr=<ADDR> lane <N> of u' || ((o_orderkey + 1) % 2) || ' || addr=<ADDR> lane <N> of u' || (o_orderkey % 2) END AS trace_fingerprint,
  coalesce(error_trace, '') AS error_trace
FROM lg LEFT JOIN tr USING (run_id)"""


def parsed(spark, sf):
    return logs.parse_blocks(logs.split_blocks(log_text(spark, sf)))


@query("s01_log_file_scan", RUN_ROWS)
def log_file_scan(spark, sf):
    path = scratch_path(spark, "logs")
    log_text(spark, sf).write.text(path)
    return logs.read_logs(spark, path)[0]


@query("s02_s05_s06_s07_log_runs", RUN_ROWS)
def log_runs(spark, sf):
    return logs.runs_of(parsed(spark, sf))


@query(
    "s03_payload_fields",
    "SELECT 'queue_depth' AS field, 'bigint' AS type UNION ALL SELECT 'test_name', 'string' UNION ALL SELECT 'throughput_mbps', 'double' UNION ALL SELECT 'voltage', 'double'",
)
def payload_fields(spark, sf):
    return spark.createDataFrame(list(logs.discover_fields(parsed(spark, sf)).items()), "field string, type string")


@query("s04_error_lines", f"WITH {LOG_SQL} SELECT run_id, severity, time_ns, component, tag, message, fingerprint FROM el")
def error_lines(spark, sf):
    return logs.errors_of(parsed(spark, sf))


@query(
    "s08_parse_stats",
    f"""WITH {LOG_SQL} SELECT count(*) AS runs, CAST(sum(n) AS BIGINT) AS error_lines, CAST(0 AS BIGINT) AS malformed_blocks,
    count(*) FILTER (WHERE o_orderkey % 10 = 0) AS unparsed_lines FROM lg""",
)
def parse_stats(spark, sf):
    return logs.parse_stats(parsed(spark, sf))


@query(
    "s08_line_count",
    f"WITH {LOG_SQL} SELECT CAST(sum(14 + n + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END - CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS lines FROM lg",
)
def line_count(spark, sf):
    path = scratch_path(spark, "logs")
    log_text(spark, sf).write.text(path)
    return logs.line_count(spark, path).select("lines")
