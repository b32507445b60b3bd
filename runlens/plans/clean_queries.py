"""Cleaning and role queries over a deliberately messy view of the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as c, roles
from ..session import spread
from .corpus import RUNS_SQL, runs, table
from .registry import query


def messy(spark, sf):
    return spread(table(spark, sf, "orders")).select(
        F.col("o_orderkey").alias("run_id"),
        F.expr("""CASE o_orderkey % 5 WHEN 0 THEN upper(o_orderpriority) WHEN 1 THEN ' ' || o_orderpriority || ' '
          WHEN 2 THEN replace(o_orderpriority, '-', ' ') WHEN 3 THEN 'N/A' ELSE lower(o_orderpriority) END""").alias("level"),
        F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 'none' WHEN o_orderkey % 53 = 0 THEN 'abc' ELSE CAST(floor(o_totalprice) AS STRING) END").alias("price"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN 'Crashed' WHEN o_orderstatus = 'O' THEN 'SUCCESS' WHEN o_orderkey % 11 = 0 THEN 'odd' ELSE 'ok' END").alias("result"),
        F.lit("same").alias("site"),
        F.expr("'x' || o_orderkey").alias("note"),
        F.expr("'c' || o_custkey % 60").alias("client"),
        F.expr("CASE WHEN o_orderkey % 4 = 0 THEN 'rare' || o_custkey % 3 END").alias("sparse"),
        F.expr("CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_custkey AS DOUBLE) END").alias("load"),
    )


MESSY_SQL = """messy AS (SELECT o_orderkey AS run_id,
  CASE o_orderkey % 5 WHEN 0 THEN upper(o_orderpriority) WHEN 1 THEN ' ' || o_orderpriority || ' ' WHEN 2 THEN replace(o_orderpriority, '-', ' ')
    WHEN 3 THEN 'N/A' ELSE lower(o_orderpriority) END AS level,
  CASE WHEN o_orderkey % 7 = 0 THEN 'none' WHEN o_orderkey % 53 = 0 THEN 'abc' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS price,
  CASE WHEN o_orderstatus = 'F' THEN 'Crashed' WHEN o_orderstatus = 'O' THEN 'SUCCESS' WHEN o_orderkey % 11 = 0 THEN 'odd' ELSE 'ok' END AS result,
  'same' AS site, 'x' || o_orderkey AS note, 'c' || (o_custkey % 60) AS client,
  CASE WHEN o_orderkey % 4 = 0 THEN 'rare' || (o_custkey % 3) END AS sparse,
  CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS load FROM orders)"""
TOKEN = "regexp_replace(regexp_replace(lower(trim({c})), '[\\s\\-]+', '_', 'g'), '^_+|_+$', '', 'g')"
LEVEL = TOKEN.format(c="level")


@query("p01_trimmed_header", f"WITH {MESSY_SQL} SELECT run_id, level FROM messy")
def trimmed_header(spark, sf):
    raw = messy(spark, sf).select("run_id", "level", "site").toDF(" run_id", "level ", "level")
    return c.trim_header(raw)


@query("p02_blank_nullish", f"WITH {MESSY_SQL} SELECT run_id, CASE WHEN level <> 'N/A' THEN level END AS level, CASE WHEN price <> 'none' THEN price END AS price, sparse FROM messy")
def blank_nullish(spark, sf):
    return c.blank_nullish(messy(spark, sf)).select("run_id", "level", "price", "sparse")


@query(
    "p03_numeric_share",
    f"""WITH {MESSY_SQL}, v AS (SELECT 'price' AS field, price AS value FROM messy WHERE price <> 'none' UNION ALL SELECT 'level', level FROM messy WHERE level <> 'N/A'
    UNION ALL SELECT 'client', client FROM messy) SELECT field, count(*) AS n, count(TRY_CAST(value AS DOUBLE)) AS "numeric" FROM v GROUP BY 1""",
)
def numeric_share(spark, sf):
    return c.numeric_share(c.blank_nullish(messy(spark, sf)), ["price", "level", "client"])


@query("p03_promoted", f"WITH {MESSY_SQL} SELECT run_id, TRY_CAST(price AS DOUBLE) AS price, client FROM messy")
def promoted(spark, sf):
    return c.promote_numeric(c.blank_nullish(messy(spark, sf)))[0].select("run_id", "price", "client")


@query(
    "p04_target_scores",
    f"""WITH {MESSY_SQL} SELECT 'result' AS field, count(*) AS n, count(*) FILTER (WHERE result <> 'odd') / count(*) AS score, true AS named FROM messy
    UNION ALL SELECT 'level', count(*), 0.0, false FROM messy""",
)
def target_scores(spark, sf):
    return c.target_scores(messy(spark, sf), ["result", "level"])


@query(
    "p05_target_words",
    f"WITH {MESSY_SQL} SELECT run_id, CASE result WHEN 'Crashed' THEN 'fail' ELSE 'pass' END AS result FROM messy WHERE result <> 'odd'",
)
def target_words(spark, sf):
    df = messy(spark, sf)
    return c.normalize_target(df, c.detect_target(df)).select("run_id", "result")


@query("p05_rejected_words", f"WITH {MESSY_SQL} SELECT result AS value, count(*) AS n FROM messy WHERE result = 'odd' GROUP BY 1")
def rejected_words(spark, sf):
    return c.rejected_targets(messy(spark, sf), "result")


@query("p06_canonical_values", f"WITH {MESSY_SQL} SELECT run_id, {LEVEL} AS level, client FROM messy")
def canonical_values(spark, sf):
    return c.canonicalize(messy(spark, sf), "result").select("run_id", "level", "client")


@query(
    "p06_merged_spellings",
    f"""WITH {MESSY_SQL}, s AS (SELECT DISTINCT level AS v, {LEVEL} AS token FROM messy)
    SELECT 'level' AS field, token, count(*) AS n_spellings, string_agg(v, ';' ORDER BY v) AS spellings FROM s GROUP BY 2 HAVING count(*) > 1""",
)
def merged_spellings(spark, sf):
    found = c.merged_spellings(messy(spark, sf), "result")
    return found.withColumn("spellings", F.array_join("spellings", ";"))


@query(
    "p07_overrides",
    f"WITH {MESSY_SQL} SELECT run_id, CASE {LEVEL} WHEN '1_urgent' THEN 'top' WHEN '5_low' THEN 'bottom' ELSE level END AS rank FROM messy",
)
def overrides(spark, sf):
    df, _ = c.apply_overrides(messy(spark, sf), {"level": "rank", "absent": "x"}, {"rank": {"1 Urgent": "top", "5-LOW": "bottom"}})
    return df.select("run_id", "rank")


_TOP = "(SELECT client FROM messy GROUP BY 1 ORDER BY count(*) DESC, client LIMIT 39)"


@query(
    "p08_capped_levels",
    f"WITH {MESSY_SQL} SELECT run_id, level, price, result, CASE WHEN client IN {_TOP} THEN client ELSE '__other__' END AS client, sparse, load FROM messy",
)
def capped_levels(spark, sf):
    df = messy(spark, sf)
    capped, _ = c.cap_cardinality(df, "result", max_levels=40)
    # price is near-unique text at small scale only; it is put back to keep the schema fixed.
    kept = capped.select("run_id", "client").join(df.select("run_id", "level", "price", "result", "sparse", "load"), "run_id")
    return kept.select("run_id", "level", "price", "result", "client", "sparse", "load")


@query(
    "p09_missing_counts",
    f"""WITH {MESSY_SQL} SELECT 'sparse' AS field, count(*) - count(sparse) AS missing, count(*) AS n FROM messy UNION ALL
    SELECT 'load', count(*) - count(load), count(*) FROM messy UNION ALL SELECT 'client', 0, count(*) FROM messy""",
)
def missing_counts(spark, sf):
    return c.missing_counts(messy(spark, sf), ["sparse", "load", "client"])


@query(
    "p09_filled",
    f"WITH {MESSY_SQL} SELECT run_id, coalesce(load, (SELECT quantile_cont(load, 0.5) FROM messy)) AS load, CASE WHEN level = 'N/A' THEN '__missing__' ELSE level END AS level FROM messy",
)
def filled(spark, sf):
    df = c.blank_nullish(messy(spark, sf).select("run_id", "load", "level", "sparse"))
    return c.handle_missing(df, None)[0]


@query("p10_class_balance", f"WITH {MESSY_SQL} SELECT CASE result WHEN 'Crashed' THEN 'fail' ELSE 'pass' END AS value, count(*) AS n FROM messy WHERE result <> 'odd' GROUP BY 1")
def class_balance(spark, sf):
    return c.class_balance(c.normalize_target(messy(spark, sf), "result"), "result")


CLEAN_SQL = f"""{MESSY_SQL}, kept AS (SELECT run_id, CASE WHEN level <> 'N/A' THEN {LEVEL} END AS level, TRY_CAST(price AS DOUBLE) AS price,
  CASE result WHEN 'Crashed' THEN 'fail' ELSE 'pass' END AS result, client, load FROM messy WHERE result <> 'odd'),
top AS (SELECT client FROM kept GROUP BY 1 ORDER BY count(*) DESC, client LIMIT 39)"""


@query(
    "p12_cleaned",
    f"""WITH {CLEAN_SQL} SELECT run_id, coalesce(level, '__missing__') AS level, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM kept)) AS price, result,
    CASE WHEN client IN (SELECT client FROM top) THEN client ELSE '__other__' END AS client, coalesce(load, (SELECT quantile_cont(load, 0.5) FROM kept)) AS load FROM kept""",
)
def cleaned(spark, sf):
    return c.clean(messy(spark, sf))[0]


@query(
    "p11_cleaning_report",
    f"""WITH {CLEAN_SQL} SELECT 'result' AS field, 'target' AS action, CAST(0 AS BIGINT) AS n UNION ALL SELECT '', 'rows_in', count(*) FROM messy UNION ALL
    SELECT '', 'rows_out', count(*) FROM kept UNION ALL SELECT '', 'rejected_verdicts', count(*) FROM messy WHERE result = 'odd' UNION ALL
    SELECT 'price', 'promoted_numeric', 0 UNION ALL SELECT 'site', 'constant', 1 UNION ALL SELECT 'note', 'near_unique', count(*) FROM kept UNION ALL
    SELECT 'client', 'capped', count(DISTINCT client) FROM kept UNION ALL SELECT 'price', 'filled_median', count(*) - count(price) FROM kept UNION ALL
    SELECT 'load', 'filled_median', count(*) - count(load) FROM kept UNION ALL SELECT 'level', 'filled_text', count(*) - count(level) FROM kept UNION ALL
    SELECT 'sparse', 'dropped_sparse', count(*) - count(sparse) FROM messy WHERE result <> 'odd'""",
)
def cleaning_report(spark, sf):
    report = c.clean(messy(spark, sf))[1]
    return report.frame(spark).where("action <> 'warning'")


ROLES = {
    "run_id": "identifier", "test_name": "categorical", "priority": "categorical", "nation": "numeric", "month": "numeric",
    "year": "categorical", "balance": "numeric", "seed": "numeric", "pass_fail": "target", "throughput_mbps": "outcome",
    "execution_time_ms": "outcome", "cycles": "numeric", "primary_error_tag": "categorical", "risk": "numeric",
}


@query("p13_column_roles", " UNION ALL ".join(f"SELECT '{f}' AS field, '{r}' AS role" for f, r in ROLES.items()))
def column_roles(spark, sf):
    return roles.role_table(runs(spark, sf))


@query("p14_safe_features", f"WITH {RUNS_SQL} SELECT test_name, priority, nation, month, year, balance FROM runs")
def safe_features(spark, sf):
    df = runs(spark, sf)
    return df.select(*roles.select_features(df, leaky=["risk"]))


@query("p15_encoded_target", f"WITH {RUNS_SQL} SELECT run_id, CAST(pass_fail = 'fail' AS INTEGER) AS target FROM runs")
def encoded_target(spark, sf):
    return runs(spark, sf).select("run_id", roles.encode_target(F.col("pass_fail")).alias("target"))
