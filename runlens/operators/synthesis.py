"""Run and child tables sampled from a field specification, keyed by existing ids.

Field kinds: ``choice`` (values, weights), ``int`` and ``float`` (low, high), ``normal`` and
``lognormal`` (mean, std, low, high); ``digits`` rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import choice, normal, uniform
from .rules import multiplied, resolve


def field_value(spec: dict, key: Column, seed: int = 42) -> Column:
    kind, name = spec["kind"], spec["name"]
    u = uniform(key, name, seed)
    if kind == "choice":
        return choice(u, spec["values"], spec.get("weights"))
    low, high = spec["low"], spec["high"]
    if kind == "int":
        return (F.floor(u * (high - low + 1)) + low).cast("int")
    if kind == "float":
        value = u * (high - low) + low
    else:
        z = normal(key, name, seed) * spec["std"] + spec["mean"]
        value = F.least(F.greatest(F.exp(z) if kind == "lognormal" else z, F.lit(float(low))), F.lit(float(high)))
    return F.round(value, spec["digits"]) if "digits" in spec else value


def sample_fields(keys: DataFrame, specs: list[dict], key: str = "run_id", seed: int = 42) -> DataFrame:
    """Add one sampled column per specification."""
    return keys.withColumns({s["name"]: field_value(s, F.col(key), seed) for s in specs})


def repeat_configs(configs: DataFrame, times: int, key: str = "config_id", seed: int = 42) -> DataFrame:
    """Every configuration ``times`` times, each with its own ``run_id`` and random seed."""
    copies = configs.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(times))))
    copies = copies.withColumn("run_id", F.concat_ws("-", F.col(key).cast("string"), F.col("repeat").cast("string")))
    return copies.withColumn("seed", F.floor(uniform(F.col("run_id"), "seed", seed) * (2**31 - 1)).cast("long"))


def outcome_multipliers(df: DataFrame, rules: list[dict], base: float, ceiling: float = 0.95) -> DataFrame:
    """Failure probability, time and throughput factors of multiplying rules, and the tag of
    the largest failure multiplier that fires."""
    from .rules import attributed_tag

    tagged = [r for r in rules if r["effect"] == "failure_multiplier"]
    return df.withColumns(
        {
            "fail_prob": F.least(multiplied(rules, "failure_multiplier") * base, F.lit(ceiling)),
            "time_factor": multiplied(rules, "exec_time_multiplier"),
            "throughput_factor": multiplied(rules, "throughput_multiplier"),
            "error_bias": attributed_tag(tagged),
        }
    )
