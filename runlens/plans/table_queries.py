"""Table readers, roll-ups, tolerant readers and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge, roles
from ..session import scratch_path
from ..sources import sinks, tables, tolerant
from .corpus import ERRORS_SQL, RUNS_SQL, errors, run_key, runs, table
from .registry import query

# ------------------------------------------------------------------ listing and header


def listing(spark, sf):
    """A file listing with one name per order."""
    k = F.col("o_orderkey")
    stems = ["config", "Random", "transactions", "telemetry", "result", "registers", "RUN_", "notes"]
    ends = [".csv", ".csv", ".log", ".csv", ".vcd", ".txt", ".FSDB"]
    name = F.concat(
        F.array(*map(F.lit, stems))[(k % 8).cast("int")], k.cast("string"), F.array(*map(F.lit, ends))[(k % 7).cast("int")]
    )
    return table(spark, sf, "orders").select(name.alias("name"), F.col("o_custkey").alias("length"))


LISTING_SQL = """files AS (SELECT ['config','Random','transactions','telemetry','result','registers','RUN_','notes'][o_orderkey % 8 + 1]
  || o_orderkey || ['.csv','.csv','.log','.csv','.vcd','.txt','.FSDB'][o_orderkey % 7 + 1] AS name, o_custkey AS length FROM orders),
routed AS (SELECT *, CASE WHEN name LIKE '%.log' THEN 'log' WHEN name LIKE '%.csv' THEN 'csv' WHEN name LIKE '%.vcd' OR name LIKE '%.FSDB' THEN 'waveform' ELSE 'other' END AS kind FROM files),
cat AS (SELECT *, CASE WHEN kind <> 'csv' THEN NULL WHEN name LIKE 'config%' THEN 'config' WHEN name LIKE 'Random%' THEN 'randomization' WHEN name LIKE 'transact%' THEN 'transactions'
  WHEN name LIKE 'telemetr%' THEN 'telemetry' WHEN name LIKE 'result%' THEN 'outcomes' WHEN name LIKE 'register%' THEN 'registers' ELSE 'custom' END AS category FROM routed)"""


@query("s10_s11_file_routing", f"WITH {LISTING_SQL} SELECT name, length, kind, category FROM cat")
def file_routing(spark, sf):
    return tables.route(listing(spark, sf))


@query(
    "s19_source_coverage",
    f"""WITH {LISTING_SQL} SELECT count(*) AS files, count(*) FILTER (WHERE kind = 'log') AS log_files, count(*) FILTER (WHERE kind = 'csv') AS csv_files,
    count(*) FILTER (WHERE kind = 'waveform') AS waveform_files, 'multi' AS mode, bool_or(category = 'config') AS has_configuration,
    bool_or(category = 'randomization') AS has_randomization, bool_or(category = 'transactions') AS has_transactions, bool_or(category = 'telemetry') AS has_telemetry,
    bool_or(category = 'outcomes') AS has_outcomes, bool_or(category = 'registers') AS has_registers, true AS has_uvm_log, true AS has_waveforms FROM cat""",
)
def source_coverage(spark, sf):
    return tables.coverage(listing(spark, sf))


@query(
    "s20_waveform_inventory",
    f"""WITH {LISTING_SQL} SELECT name, CASE WHEN name LIKE '%.vcd' THEN 'VCD' ELSE 'FSDB' END AS format, length AS size_bytes,
    CASE WHEN name LIKE 'RUN\\_%' ESCAPE '\\' THEN string_split(name, '.')[1] END AS run_id FROM cat WHERE kind = 'waveform'""",
)
def waveform_inventory(spark, sf):
    return tables.waveforms(listing(spark, sf))


@query(
    "s12_alias_header",
    "SELECT o_orderkey AS run_id, o_orderstatus AS pass_fail, o_orderpriority AS primary_error_tag, o_custkey AS test_name FROM orders",
)
def alias_header(spark, sf):
    o = table(spark, sf, "orders")
    raw = o.select(
        F.col("o_orderkey").alias(" Sim-ID "), F.col("o_orderstatus").alias("Result"), F.col("o_totalprice").alias("verdict"),
        F.col("o_orderpriority").alias("Failure Class"), F.col("o_custkey").alias("TestCase"),
    )
    return tables.normalise_header(raw)


@query("s13_id_discovery", "SELECT event_id AS run_id, user_id, event_type FROM events")
def id_discovery(spark, sf):
    return tables.normalise_header(table(spark, sf, "events").select("event_id", "user_id", "event_type"))


@query("s09_s14_s30_csv_scan", "SELECT c_custkey AS run_id, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.write_table(table(spark, sf, "customer").withColumnRenamed("c_custkey", "Run ID"), path, "csv")
    return tables.read_csv(spark, path)


@query(
    "s09_s11_mixed_charsets",
    """SELECT c_custkey AS run_id, c_mktsegment || CASE c_custkey % 3 WHEN 0 THEN ' é€' || chr(10) || 'say "so", or not' WHEN 1 THEN ' éü' ELSE ' € – é' END AS note,
    CASE WHEN c_custkey % 3 = 1 THEN NULL ELSE c_acctbal END AS balance FROM customer""",
)
def mixed_charsets(spark, sf):
    """All customers as CSV files in three charsets, with two headers and quoted line breaks, read again as one table."""
    path, k = scratch_path(spark, "charsets"), F.col("c_custkey")
    # Bytes 80 and 96 are the euro sign and a dash in cp1252.
    marks = [(" é€\nsay \"so\", or not", "UTF-8"), (" éü", "ISO-8859-1"), (" \u0080 \u0096 é", "ISO-8859-1")]
    for i, (mark, encoding) in enumerate(marks):
        rows = table(spark, sf, "customer").where(k % 3 == i).select(
            k.alias("Run ID"), F.concat("c_mktsegment", F.lit(mark)).alias("Note"), *([] if i == 1 else [F.col("c_acctbal").alias("Balance")])
        )
        rows.write.csv(f"{path}/{i}", header=True, encoding=encoding, escape='"')
    return tables.read_csv(spark, path)


# ------------------------------------------------------------------ roll-ups


@query(
    "s15_transaction_rollup",
    """SELECT l_orderkey AS run_id, count(*) AS n_transactions, round(avg(l_partkey), 6) AS txn_l_partkey_mean, round(avg(l_linenumber), 6) AS txn_l_linenumber_mean,
    round(avg(l_quantity), 6) AS txn_l_quantity_mean, max(l_partkey) AS txn_l_partkey_max, max(l_linenumber) AS txn_l_linenumber_max, max(l_quantity) AS txn_l_quantity_max
    FROM lineitem GROUP BY 1""",
)
def transaction_rollup(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), "l_partkey", "l_linenumber", "l_quantity", "l_returnflag"
    )
    out = tables.rollup_transactions(rows)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("_mean")})


@query(
    "s16_telemetry_rollup",
    "SELECT user_id AS run_id, round(avg(event_id), 4) AS event_id, round(avg(value), 4) AS value FROM events GROUP BY 1",
)
def telemetry_rollup(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), "event_id", "value", "event_type")
    return tables.rollup_telemetry(e).withColumns({c: F.round(c, 4) for c in ("event_id", "value")})


@query("s16_u06_first_per_run", "SELECT user_id AS run_id, min(event_type) AS event_type FROM events GROUP BY 1")
def first_per_run(spark, sf):
    return tables.rollup_telemetry(table(spark, sf, "events").select(F.col("user_id").alias("run_id"), "event_type"))


WORDS = ["Passed", " FAIL ", "OK", "no", "Flaky"]


@query(
    "s17_outcome_words",
    "SELECT o_orderkey AS run_id, ['pass','fail','pass','fail','flaky'][o_orderkey % 5 + 1] AS pass_fail FROM orders",
)
def outcome_words(spark, sf):
    word = F.array(*map(F.lit, WORDS))[(F.col("o_orderkey") % 5).cast("int")]
    return tables.load_outcomes(table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), word.alias("pass_fail")))


@query("s18_register_rollup", "SELECT user_id AS run_id, count(*) AS n_register_accesses FROM events GROUP BY 1")
def register_rollup(spark, sf):
    return tables.rollup_registers(table(spark, sf, "events").withColumnRenamed("user_id", "run_id"))


@query(
    "s29_u05_row_union",
    """SELECT l_orderkey, l_partkey, NULL AS l_tax FROM lineitem WHERE l_returnflag = 'A' UNION ALL
    SELECT l_orderkey, NULL, l_tax FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_partkey, l_tax FROM lineitem WHERE l_returnflag = 'N'""",
)
def row_union(spark, sf):
    l = table(spark, sf, "lineitem")
    return tables.union_all([
        l.where("l_returnflag = 'A'").select("l_orderkey", "l_partkey"), l.where("l_returnflag = 'R'").select("l_orderkey", "l_tax"),
        l.where("l_returnflag = 'N'").select("l_tax", "l_partkey", "l_orderkey"),
    ])


# ------------------------------------------------------------------ tolerant readers


@query("s22_json_array", "SELECT c_custkey AS id, c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS nation, 'a | ' || c_custkey AS tags FROM customer")
def json_array(spark, sf):
    """Customers as JSON arrays of nested objects, one file per nation, read back as flat rows."""
    path = scratch_path(spark, "array")
    c = table(spark, sf, "customer")
    one = F.to_json(F.struct(
        F.col("c_custkey").alias("id"), F.struct(F.col("c_mktsegment").alias("segment"), F.struct(F.col("c_nationkey").alias("nation")).alias("in")).alias("of"),
        F.array(F.lit("a"), F.col("c_custkey").cast("string")).alias("tags")))
    files = c.select(one.alias("j"), "c_nationkey").groupBy("c_nationkey").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ",\n"), F.lit("]")).alias("value"))
    files.write.partitionBy("c_nationkey").text(path)
    return tolerant.json_array(spark, f"{path}/*/*.txt").select("id", "segment", "nation", "tags")

JSON_ROWS = """SELECT CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey END AS id, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS level,
 CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS cust, CASE WHEN o_orderkey % 9 <> 0 THEN 'a | ' || o_orderstatus END AS tags FROM orders WHERE o_orderkey % 9 <> 0"""


def _json_text(spark, sf):
    doc = F.to_json(
        F.struct(
            F.col("o_orderkey").alias("id"),
            F.struct(F.col("o_orderpriority").alias("level"), F.struct(F.col("o_custkey").alias("cust")).alias("deep")).alias("config"),
            F.array(F.lit("a"), F.col("o_orderstatus")).alias("tags"),
        )
    )
    return table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 9 == 0, "{broken").otherwise(doc).alias("value"))


@query("s23_s28_json_lines", JSON_ROWS)
def json_lines(spark, sf):
    return tolerant.json_lines(_json_text(spark, sf))


@query("s21_read_any", JSON_ROWS)
def read_any(spark, sf):
    path = scratch_path(spark, "any")
    _json_text(spark, sf).write.text(path)
    return tolerant.read_any(spark, path)[0]


@query(
    "s21_format_scores",
    "SELECT count(*) AS lines, count(*) FILTER (WHERE o_orderkey % 9 <> 0) AS json_lines, CAST(0 AS BIGINT) AS kv_lines FROM orders",
)
def format_scores(spark, sf):
    return tolerant.format_scores(_json_text(spark, sf))


def _banner_text(spark, sf):
    c = table(spark, sf, "customer")
    state = F.when(F.col("c_nationkey") % 3 == 0, "the unit CRASHED early").otherwise("all checks passed, done")
    return c.select(
        F.concat_ws(
            "\n", F.concat(F.lit("RUN :: CUST-"), F.col("c_custkey").cast("string")),
            F.concat(F.lit('{"nation": '), F.col("c_nationkey").cast("string"), F.lit("}")),
            F.concat(F.lit("segment : "), F.col("c_mktsegment")), F.lit("segment : again"), state,
        ).alias("value")
    )


@query(
    "s24_banner_discovery",
    "SELECT 'RUN :: CUST-#' AS shape, count(*) AS count, 'RUN :: CUST-' AS prefix, 'CUST-' AS stem, true AS usable FROM customer",
)
def banner_discovery(spark, sf):
    lines = _banner_text(spark, sf).select(F.explode(F.split("value", "\n")).alias("value"))
    # The blocks hold other frequent lines; keep banner and free-text lines.
    return tolerant.banner_shape(lines.where("not startswith(value, 'segment : again') and not startswith(value, '{')")).drop("indent")


@query(
    "s25_generic_blocks",
    """SELECT 'CUST-' || c_custkey AS row_id, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment,
    CASE WHEN c_nationkey % 3 = 0 THEN 'crashed' ELSE 'passed' END AS verdict FROM customer""",
)
def generic_blocks(spark, sf):
    path = scratch_path(spark, "blocks")
    _banner_text(spark, sf).write.text(path)
    return tolerant.to_columns(tolerant.read_generic_blocks(spark, path, "RUN :: CUST-", "CUST-"))


@query(
    "s26_key_value_records",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment, NULL AS extra FROM customer UNION ALL
    SELECT 'b' || c_custkey, NULL, c_name FROM customer""",
)
def key_value_records(spark, sf):
    text = F.concat_ws(
        "\n", F.concat(F.lit("id: "), F.col("c_custkey").cast("string")), F.concat(F.lit("segment = "), F.col("c_mktsegment")),
        F.concat(F.lit("id: b"), F.col("c_custkey").cast("string")), F.concat(F.lit("extra : "), F.col("c_name")), F.lit(""),
    )
    return tolerant.to_columns(tolerant.kv_records(table(spark, sf, "customer").select(text.alias("value"))))


@query("s27_delimited", "SELECT c_custkey, c_mktsegment, c_nationkey FROM customer")
def delimited(spark, sf):
    path = scratch_path(spark, "delimited")
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    rows.write.csv(path, header=True, sep="|")
    found = tolerant.sniff_delimiter(spark.read.text(path))
    return tolerant.delimited(spark, path, found)


@query(
    "s31_json_sink",
    f"""WITH {RUNS_SQL} SELECT '{{"test_name":"' || test_name || '","n":' || count(*) || '}}' AS value FROM runs GROUP BY test_name""",
)
def json_sink(spark, sf):
    path = scratch_path(spark, "report")
    report = runs(spark, sf).groupBy("test_name").agg(F.count("*").alias("n"))
    sinks.write_reports({"tests": report}, path)
    return spark.read.text(f"{path}/tests")


# ------------------------------------------------------------------ joins


def _family(spark, sf):
    o, c, l, e = (table(spark, sf, t) for t in ("orders", "customer", "lineitem", "events"))
    return {
        "config": o.join(c, o.o_custkey == c.c_custkey).select(
            F.col("o_orderkey").alias("run_id"), F.col("c_mktsegment").alias("test_name"), F.lit("x").alias("status_word")
        ),
        "outcomes": o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status_word")),
        "transactions": tables.rollup_transactions(l.select(F.col("l_orderkey").alias("run_id"), "l_linenumber")),
        "registers": tables.rollup_registers(e.select(F.col("user_id").alias("run_id"))),
    }


FAMILY_SQL = """fam AS (SELECT o_orderkey AS run_id, o_orderstatus AS status_word, c_mktsegment AS test_name, n_transactions, txn_l_linenumber_mean, txn_l_linenumber_max, n_register_accesses
  FROM orders JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n_transactions, avg(l_linenumber) AS txn_l_linenumber_mean, max(l_linenumber) AS txn_l_linenumber_max FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  LEFT JOIN (SELECT user_id, count(*) AS n_register_accesses FROM events GROUP BY 1) ON user_id = o_orderkey)"""


@query("j01_category_merge", f"WITH {FAMILY_SQL} SELECT * REPLACE (round(txn_l_linenumber_mean, 6) AS txn_l_linenumber_mean) FROM fam")
def category_merge(spark, sf):
    merged = merge.merge_tables(_family(spark, sf))
    return merged.withColumn("txn_l_linenumber_mean", F.round("txn_l_linenumber_mean", 6))


@query(
    "j02_log_enrichment",
    f"""WITH {FAMILY_SQL}, {ERRORS_SQL}, lt AS (SELECT user_id AS run_id, min(event_type) AS primary_error_tag FROM events GROUP BY 1)
    SELECT run_id, test_name, status_word, primary_error_tag FROM fam LEFT JOIN lt USING (run_id)""",
)
def log_enrichment(spark, sf):
    log = table(spark, sf, "events").groupBy(F.col("user_id").alias("run_id")).agg(
        F.min("event_type").alias("primary_error_tag"), F.lit("log").alias("test_name")
    )
    return merge.left_enrich(merge.merge_tables(_family(spark, sf)), log).select("run_id", "test_name", "status_word", "primary_error_tag")


@query(
    "j03_error_restriction",
    f"WITH {RUNS_SQL}, {ERRORS_SQL} SELECT * FROM errors WHERE run_id IN (SELECT run_id FROM runs WHERE pass_fail = 'fail')",
)
def error_restriction(spark, sf):
    return merge.restrict_errors(errors(spark, sf), runs(spark, sf).where("pass_fail = 'fail'"))


@query(
    "p16_completed_runs",
    """SELECT o_orderkey AS run_id, CASE WHEN w IN ('fail', 'no') THEN CASE w WHEN 'fail' THEN 'fail' ELSE 'pass' END ELSE 'pass' END AS pass_fail, 'unknown_test' AS test_name,
    CASE WHEN o_orderkey % 4 = 0 THEN 'NONE' ELSE 'E' || (o_orderkey % 4) END AS primary_error_tag,
    CASE WHEN w = 'fail' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'NONE' ELSE 'E' || (o_orderkey % 4) END ELSE 'CLEAN' END AS trace_fingerprint, '' AS error_trace,
    CAST(o_orderkey % 4 <> 0 AS INTEGER) AS distinct_error_tags, CASE WHEN w = 'fail' THEN 'FAILED' ELSE 'PASSED' END AS verdict
    FROM (SELECT *, ['ok', 'fail', 'no'][o_orderkey % 3 + 1] AS w FROM orders)""",
)
def completed_runs(spark, sf):
    k = F.col("o_orderkey")
    word = F.array(F.lit("ok"), F.lit("fail"), F.lit("no"))[(k % 3).cast("int")]
    tag = F.when(k % 4 == 0, "ok").otherwise(F.concat(F.lit("E"), (k % 4).cast("string")))
    raw = table(spark, sf, "orders").select(k.alias("run_id"), word.alias("pass_fail"), tag.alias("err_type"))
    return roles.complete_runs(raw).drop("err_type")


@query(
    "p16_synthetic_ids",
    "SELECT count(*) AS n, count(*) AS n_ids, 'RUN-000001' AS first_id FROM lineitem",
)
def synthetic_ids(spark, sf):
    raw = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_tax")
    return tables.hash_numbered(raw).agg(
        F.count("*").alias("n"), F.count_distinct("run_id").alias("n_ids"), F.min("run_id").alias("first_id")
    )
