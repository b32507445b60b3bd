"""How well discoveries match known rules.

Rules: ``rule_id, features`` (array); findings: ``finding_id, features, lift, support``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def rule_frame(spark, rules: list[dict]) -> DataFrame:
    rows = [(r["id"], sorted({c["field"] for c in r["conditions"]})) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, features array<string>")


def feature_coverage(rules: DataFrame, ranked: DataFrame, top_k: int = 5) -> DataFrame:
    """Per rule: which of its features are among the ``top_k`` important ones."""
    top = ranked.where(F.col("rank") <= top_k).agg(F.collect_set("feature")).scalar()
    hit = F.array_sort(F.array_intersect("features", "_top"))
    miss = F.array_sort(F.array_except("features", "_top"))
    return rules.withColumn("_top", top).select(
        "rule_id", F.array_join("features", ",").alias("rule_features"), F.array_join(hit, ",").alias("matched"),
        F.array_join(miss, ",").alias("missed"), F.size("features").alias("n_features"), F.size(hit).alias("n_matched"),
        F.round(F.size(hit) / F.size("features"), 4).alias("coverage"), (F.size(miss) == 0).alias("fully_detected"),
    )


def best_matches(rules: DataFrame, findings: DataFrame, minimum: float = 0.5) -> DataFrame:
    """The finding that shares the largest part of each rule's features.

    Rules and findings meet on shared features, so only overlapping pairs exist. Of equal
    scores the stronger finding wins.
    """
    r = rules.select("rule_id", F.size("features").alias("_k"), F.explode("features").alias("feature"))
    f = findings.select("finding_id", "lift", "support", F.explode("features").alias("feature"))
    overlap = r.join(f, "feature").groupBy("rule_id", "finding_id").agg(
        (F.count("*") / F.max("_k")).alias("score"), F.max("lift").alias("lift"), F.max("support").alias("support")
    )
    best = overlap.where(F.col("score") >= minimum).groupBy("rule_id").agg(
        F.min(F.struct((-F.col("score")).alias("s"), (-F.col("lift")).alias("l"), (-F.col("support")).alias("n"), "finding_id")).alias("b")
    )
    return rules.select("rule_id").join(best, "rule_id", "left").select(
        "rule_id", F.col("b").isNotNull().alias("detected"), F.round(F.coalesce(-F.col("b.s"), F.lit(0.0)), 2).alias("match_score"),
        F.col("b.finding_id").alias("finding_id"), (-F.col("b.l")).alias("lift"), (-F.col("b.n")).alias("support"),
    )


def overall_grade(coverage: DataFrame, matches: DataFrame) -> DataFrame:
    """Composite of feature recall (40 %) and rule recall (60 %) with a letter."""
    feature = coverage.agg((F.sum("n_matched") / F.sum("n_features")).alias("f"))
    rule = matches.agg(F.avg(F.col("detected").cast("double"))).scalar()
    out = feature.withColumn("r", F.coalesce(rule, F.lit(0.0))).withColumn(
        "composite_score", F.round((0.4 * F.coalesce("f", F.lit(0.0)) + 0.6 * F.col("r")) * 100, 1)
    )
    s = F.col("composite_score")
    letter = F.when(s >= 80, "A").when(s >= 60, "B").when(s >= 40, "C").when(s >= 20, "D").otherwise("F")
    return out.select(
        F.round("f", 4).alias("feature_recall"), F.round("r", 4).alias("rule_recall"), "composite_score", letter.alias("grade")
    )
