"""URL filter: rules decide where one fits, a logistic regression on hashed character n-grams decides the rest.

Only DataFrame functions and the DataFrame side of Spark's own machine learning library are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

LABELLED = 20_000  # most rows of a labelled table that a fit reads
SLOTS = 1 << 14
GRAMS = (2, 3, 4)  # lengths of n-grams, from 2 on
PENALTY = 1e-3
THRESHOLD = 0.5


@dataclass(frozen=True)
class Rule:
    """``allow`` or block the urls of a host and its subdomains whose path starts with ``path``."""

    allow: bool
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


def rules_of(lines: Sequence[str]) -> list[Rule]:
    """Rules written as ``allow host/path`` or ``block host/path``."""
    found = []
    for line in lines:
        kind, _, place = line.partition(" ")
        host, slash, path = place.partition("/")
        if kind not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {line!r}")
        found.append(Rule(kind == "allow", host, slash + path))
    return found


def url_parts(url: Column) -> dict[str, Column]:
    """Host and path of a url; both empty for a null or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, "(?s)^.*?://", "")).otherwise("")
    before = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.translate(F.regexp_extract(before, r"(?s)^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {"host": host, "path": F.regexp_extract(before, r"(?s)^[^/]*(.*)$", 1)}


def fitting(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The rule (struct of text and allow) that fits a host and path, null if none does.

    The longest wins; of equally long ones the one that blocks, then the first in text order. Rules are a list that a
    person keeps, and become one expression.
    """
    order = sorted(rules, key=lambda r: (-len(str(r)), r.allow, str(r)))
    found = [
        F.when(
            ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)),
            F.struct(F.lit(str(r)).alias("rule"), F.lit(r.allow).alias("allow")),
        )
        for r in order
    ]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,allow:boolean>")


def _grams(text: Column, part: str) -> Column:
    """All runs of a few characters, with marks for the part and its ends; work is linear in the text."""
    chars = F.concat(F.array(F.lit("^")), F.filter(F.split(text, ""), lambda c: c != ""), F.array(F.lit("$")))
    found, run = [], chars
    for n in range(2, max(GRAMS) + 1):
        # Each character meets the run before it by position; past the end there is nothing to add.
        run = F.zip_with(run, F.slice(chars, n, 1 << 30), lambda a, b: F.concat_ws("", a, b))
        if n in GRAMS:
            mark = F.lit(f"{part}{n}")
            found.append(F.transform(run, lambda g: F.concat(mark, g)))
    return F.concat(*found)


def grams(host: Column, path: Column) -> Column:
    return F.array_distinct(F.concat(_grams(host, "h"), _grams(path, "p")))


def hashed(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``rows`` (host, path) with the vector ``__features`` of the n-grams that occur."""
    counted = rows.withColumn("__grams", grams(F.col("host"), F.col("path")))
    return HashingTF(numFeatures=slots, binary=True, inputCol="__grams", outputCol="__features").transform(counted).drop("__grams")


def fit(labelled: DataFrame, most: int = LABELLED, slots: int = SLOTS) -> LogisticRegressionModel | None:
    """Fit on a labelled table (host, path, allow); at most ``most`` distinct rows, those of smallest hash.

    A host and path with both labels counts as blocked. Classes weigh the same. None without two classes.
    """
    rows = labelled.where(F.col("allow").isNotNull()).groupBy("host", "path").agg(F.min("allow").alias("allow"))
    rows = stored(rows.orderBy(F.xxhash64("host", "path"), "host", "path").limit(most), "url-labels")
    counts = {r["allow"]: r["count"] for r in rows.groupBy("allow").count().collect()}
    if len(counts) < 2:
        return None
    total = sum(counts.values())
    weight = F.when(F.col("allow"), total / (2 * counts[True])).otherwise(total / (2 * counts[False]))
    return LogisticRegression(
        featuresCol="__features", labelCol="label", weightCol="weight", regParam=PENALTY, standardization=False, maxIter=60, tol=1e-8,
        probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__prediction",
    ).fit(hashed(rows.withColumns({"label": F.col("allow").cast("double"), "weight": weight}), slots))


def scored(rows: DataFrame, model: LogisticRegressionModel | None) -> DataFrame:
    """``rows`` (host, path) with ``score``, the probability of ``allow``; null without a model."""
    if model is None:
        return rows.withColumn("score", F.lit(None).cast("double"))
    # The regression's width is that of the hash, so its weights are small however many urls there are.
    out = model.transform(hashed(rows, model.numFeatures))
    return out.withColumn("score", vector_to_array("__probability")[1]).drop("__features", "__raw", "__probability", "__prediction")


def judged(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None, url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """``keep``, ``host, path, rule, verdict, score`` for every row of ``pages``.

    ``labelled`` (url, allow) is the table to learn from; without it the urls that a rule fits are, with the rule's
    decision as label. A null url or one without ``://`` has an empty host and path, which no rule fits and which gets the
    method's verdict as any other; without two classes to learn from the method allows all. Rows are judged one by
    one, whole, so repeated rows agree; an empty table gives no rows; columns outside ``keep`` are not returned.
    """
    parts = pages.select(*keep, F.col(url).alias("__url")).withColumns(url_parts(F.col("__url"))).drop("__url")
    rows = parts.withColumn("__rule", fitting(rules, F.col("host"), F.col("path")))
    if labelled is None:
        known = rows.select("host", "path", F.col("__rule.allow").alias("allow"))
    else:
        known = labelled.select(F.col("url").alias("__url"), "allow").withColumns(url_parts(F.col("__url"))).select("host", "path", "allow")
    out = scored(rows, fit(known))
    by_method = F.coalesce(F.col("score") >= THRESHOLD, F.lit(True))
    verdict = F.when(F.coalesce(F.col("__rule.allow"), by_method), "allow").otherwise("block")
    return out.select(*keep, "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), "score")
