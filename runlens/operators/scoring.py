"""Evaluation of risk scores: curves, areas, cut-offs, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordered import exact_share, running
from .summary import failed

BANDS = ["low (<25%)", "moderate (25-50%)", "high (50-75%)", "critical (>=75%)"]


def score_counts(df: DataFrame, score: str = "risk") -> DataFrame:
    """Failing (``pos``) and passing (``neg``) rows per distinct score, best first by ``_key``."""
    counts = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(failed()).alias("pos"), F.count_if(~failed()).alias("neg")
    )
    return counts.withColumn("_key", -F.col("score"))


def roc_points(df: DataFrame, score: str = "risk") -> DataFrame:
    """ROC curve without collinear points: ``idx, threshold, fpr, tpr``, origin included."""
    counts = score_counts(df, score)
    total = counts.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("t")).scalar()
    curve = running(counts, "_key", sums=["pos", "neg"], nexts=["pos", "neg"])
    # A point lies on the line through its neighbours when the next step equals its own.
    first = F.col("cum_pos") + F.col("cum_neg") == F.col("pos") + F.col("neg")
    corner = first | F.col("next_pos").isNull() | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    kept = running(curve.where(corner).withColumn("one", F.lit(1)), "_key", sums=["one"])
    sized = kept.withColumn("_t", total)
    points = sized.select(
        F.col("cum_one").cast("long").alias("idx"), F.least("score", F.lit(1.0)).alias("threshold"),
        (F.col("cum_neg") / F.col("_t.n")).alias("fpr"), (F.col("cum_pos") / F.col("_t.p")).alias("tpr"),
    )
    origin = df.agg(F.count("*")).select(
        F.lit(0).cast("long").alias("idx"), F.lit(1.0).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(points)


def thin_curve(points: DataFrame, about: int = 100) -> DataFrame:
    """Every k-th point so that roughly ``about`` remain."""
    n = points.agg(F.count("*")).scalar()
    step = F.greatest(F.lit(1), F.floor(n / about))
    return points.where(F.col("idx") % step == 0).select(
        "idx", F.round("threshold", 4).alias("threshold"), F.round("fpr", 4).alias("fpr"), F.round("tpr", 4).alias("tpr")
    )


def areas(df: DataFrame, score: str = "risk") -> DataFrame:
    """Exact ROC area (ties count half) and average precision (step sum)."""
    curve = running(score_counts(df, score), "_key", sums=["pos", "neg"])
    # Products of two counts can exceed a long, so factors are widened first.
    wide = lambda c: c.cast("decimal(19,0)")
    pairs = F.sum((wide(F.col("neg")) * wide(2 * F.col("cum_pos") - F.col("pos"))).cast("decimal(38,0)"))
    share = F.col("cum_pos").cast("double") / (F.col("cum_pos") + F.col("cum_neg"))
    steps = F.sum(F.col("pos") * share)
    sums = curve.agg(pairs.alias("_pairs"), steps.alias("_steps"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    both = F.col("_p").cast("double") * F.col("_n") * 2
    return sums.select(
        F.round(F.col("_pairs").cast("double") / F.nullif(both, F.lit(0.0)), 6).alias("roc_auc"),
        F.round(F.col("_steps") / F.nullif(F.col("_p"), F.lit(0)), 6).alias("pr_auc"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def _cells(flagged: Column) -> list[Column]:
    return [
        F.count_if(flagged & failed()).alias("tp"), F.count_if(flagged & ~failed()).alias("fp"),
        F.count_if(~flagged & failed()).alias("fn"), F.count_if(~flagged & ~failed()).alias("tn"),
    ]


def threshold_metrics(df: DataFrame, score: str = "risk", cut: float = 0.5) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 at a cut-off."""
    cells = df.agg(*_cells(F.col(score) >= cut))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select(
        "tn", "fp", "fn", "tp",
        F.round(_ratio(tp + tn, tp + fp + fn + tn), 4).alias("accuracy"),
        F.round(_ratio(tp, tp + fp), 4).alias("precision"),
        F.round(_ratio(tp, tp + fn), 4).alias("recall"),
        F.round(_ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1"),
    )


def classification_report(df: DataFrame, score: str = "risk", cut: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support of both classes."""
    flagged = F.when(F.col(score) >= cut, "fail").otherwise("pass")
    rows = df.select(F.col("pass_fail").alias("truth"), flagged.alias("guess"))
    votes = rows.select(
        F.explode(F.array(
            F.struct(F.col("truth").alias("c"), (F.col("truth") == F.col("guess")).cast("int").alias("hit"), F.lit(1).alias("t"), F.lit(0).alias("g")),
            F.struct(F.col("guess").alias("c"), F.lit(0).alias("hit"), F.lit(0).alias("t"), F.lit(1).alias("g")),
        )).alias("x")
    )
    per = votes.groupBy(F.col("x.c").alias("class")).agg(
        F.sum("x.hit").alias("hit"), F.sum("x.t").alias("support"), F.sum("x.g").alias("guessed")
    )
    hit, sup, g = F.col("hit"), F.col("support"), F.col("guessed")
    return per.select(
        "class", F.round(_ratio(hit, g), 4).alias("precision"), F.round(_ratio(hit, sup), 4).alias("recall"),
        F.round(_ratio(2 * hit, g + sup), 4).alias("f1"), "support",
    )


def operating_points(df: DataFrame, score: str = "risk") -> DataFrame:
    """Counts at the cut-off with the best balance (first maximum of tpr - fpr) and at 0.5."""
    curve = roc_points(df, score)
    best = (
        curve.orderBy((F.col("tpr") - F.col("fpr")).desc(), "idx").limit(1)
        .select(F.col("threshold").alias("t")).agg(F.max("t")).scalar()
    )
    out = None
    for name, at in (("best_balance", best), ("default", F.lit(0.5))):
        one = df.withColumn("_cut", at).agg(F.max("_cut").alias("threshold"), *_cells(F.col(score) >= F.col("_cut")))
        one = one.select(
            F.lit(name).alias("point"), F.round("threshold", 4).alias("threshold"),
            F.round(_ratio(F.col("fp"), F.col("fp") + F.col("tn")), 4).alias("fpr"),
            F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fn")), 4).alias("tpr"), "tp", "fp", "fn", "tn",
        )
        out = one if out is None else out.unionByName(one)
    return out


def risk_bands(df: DataFrame, score: str = "risk") -> DataFrame:
    """Runs per risk band and the mean risk."""
    s = F.col(score)
    band = F.when(s < 0.25, BANDS[0]).when(s < 0.5, BANDS[1]).when(s < 0.75, BANDS[2]).otherwise(BANDS[3])
    counts = df.groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    return counts.withColumn("mean_predicted_risk", F.round(df.agg(F.avg(score)).scalar(), 4))


def top_risk(df: DataFrame, features: list[str], n: int = 20, score: str = "risk") -> DataFrame:
    """Highest-risk runs with their settings."""
    ranked = df.withColumn("predicted_risk", F.round(score, 4))
    return (
        ranked.orderBy(F.desc("predicted_risk"), "run_id").limit(n)
        .select("run_id", "pass_fail", "predicted_risk", F.to_json(F.struct(*features)).alias("config"))
    )


def observed_risk(runs: DataFrame) -> DataFrame:
    """Fallback score without a model: the observed failure rate for every run."""
    from .summary import fail_rate

    return runs.withColumn("risk", runs.agg(fail_rate()).scalar())


def stratified_split(df: DataFrame, share: float = 0.2, seed: int = 42, key: str = "run_id") -> DataFrame:
    """Add ``is_test``: an exact share of each verdict, by seeded hash order."""
    return exact_share(df, key, share, seed, by="pass_fail").withColumnRenamed("picked", "is_test")


def approximate_split(df: DataFrame, share: float = 0.2, seed: int = 42, key: str = "run_id") -> DataFrame:
    """Add ``is_test`` by hash alone: no pass over the data, shares hold on average."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(10_000))
    return df.withColumn("is_test", bucket < int(share * 10_000))
