"""Failure rules: predicates, risk, tags, support and lift.

A rule is ``{"id", "conditions": [{"field", "op", "value"}], "effect": "add"|"set", "value",
"error_tag"}``; conditions are joined by AND and a null never satisfies one.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import choice, uniform
from .summary import failed

OPERATORS = {
    "==": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge,
    "<": operator.lt, "<=": operator.le,
}


def predicate(rule: dict) -> Column:
    tests = [OPERATORS[c["op"]](F.col(c["field"]), F.lit(c["value"])) for c in rule["conditions"]]
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def fired(rules: list[dict]) -> Column:
    """Ids of the rules a row satisfies."""
    return F.array_compact(F.array(*[F.when(predicate(r), F.lit(r["id"])) for r in rules]))


def failure_probability(rules: list[dict], base: float, strength: float = 1.0) -> Column:
    """Base plus all additive rules; the last firing ``set`` rule overrides; clipped."""
    prob = F.lit(base)
    for r in rules:
        if r["effect"] == "add":
            prob = prob + F.when(predicate(r), r["value"] * strength).otherwise(0.0)
    fixed = [F.when(predicate(r), float(r["value"])) for r in reversed(rules) if r["effect"] == "set"]
    return F.least(F.greatest(F.coalesce(*fixed, prob), F.lit(0.001)), F.lit(0.99))


def attributed_tag(rules: list[dict]) -> Column:
    """Tag of the firing rule with the highest value (the first of equals); null without one."""
    claims = [
        F.when(
            predicate(r),
            F.struct(F.lit(float(r["value"])).alias("v"), F.lit(-i).alias("place"), F.lit(r["error_tag"]).alias("tag")),
        )
        for i, r in enumerate(rules) if r.get("error_tag")
    ]
    return F.array_max(F.array(*claims))["tag"] if claims else F.lit(None).cast("string")


def resolve(
    df: DataFrame, rules: list[dict], base: float, noise: dict[str, float], key: str = "run_id",
    seed: int = 42, strength: float = 1.0,
) -> DataFrame:
    """Add ``prob``, ``pass_fail`` and ``primary_error_tag`` drawn from the rules."""
    k = F.col(key)
    df = df.withColumn("prob", failure_probability(rules, base, strength))
    is_fail = uniform(k, "verdict", seed) < F.col("prob")
    other = choice(uniform(k, "noise", seed), list(noise), list(noise.values()))
    return df.withColumn("pass_fail", F.when(is_fail, "fail").otherwise("pass")).withColumn(
        "primary_error_tag",
        F.when(failed(), F.coalesce(attributed_tag(rules), other)).otherwise("NONE"),
    )


def bias_column(
    df: DataFrame, rule: dict, target: str, value, probability: float, key: str = "run_id", seed: int = 42
) -> DataFrame:
    """Override a column with the given probability where the rule holds."""
    hit = predicate(rule) & (uniform(F.col(key), f"bias/{rule['id']}", seed) < probability)
    return df.withColumn(target, F.when(hit, F.lit(value)).otherwise(F.col(target)))


def multiplied(rules: list[dict], kind: str) -> Column:
    """Product of the values of all firing rules of one effect kind."""
    factors = [F.when(predicate(r), float(r["value"])).otherwise(1.0) for r in rules if r["effect"] == kind]
    return reduce(lambda a, b: a * b, factors, F.lit(1.0))


def support(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Per rule: rows matched, share, failure rate with and without it, lift. One pass."""
    all_rows = df.agg(F.struct(F.count("*").alias("n"), F.count_if(failed()).alias("f")).alias("s")).scalar()
    # One extra element per row keeps rules that never fire in the result.
    marks = F.array(*[F.struct(F.lit(r["id"]).alias("id"), predicate(r).alias("hit")) for r in rules])
    per = (
        df.select("pass_fail", F.explode(marks).alias("m"))
        .groupBy(F.col("m.id").alias("rule_id"))
        .agg(F.count_if("m.hit").alias("rows_matched"), F.count_if(F.col("m.hit") & failed()).alias("_f"))
        .withColumn("_s", all_rows)
    )
    n, f = F.col("_s.n"), F.col("_s.f")
    fire = F.col("_f") / F.nullif(F.col("rows_matched"), F.lit(0))
    rest = (f - F.col("_f")) / F.nullif(n - F.col("rows_matched"), F.lit(0))
    return per.select(
        "rule_id", "rows_matched", F.round(F.col("rows_matched") / n, 4).alias("match_share"),
        F.round(fire, 4).alias("fail_rate_when_fired"), F.round(rest, 4).alias("fail_rate_otherwise"),
        F.round(fire / F.nullif(rest, F.lit(0.0)), 3).alias("lift"),
    )
