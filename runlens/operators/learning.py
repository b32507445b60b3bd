"""Risk and throughput models, from feature frames to scored runs: boosted trees of our own, baselines of MLlib."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from . import boosting, forest
from .rates import numeric
from .scoring import stratified_split
from .summary import failed

ROW_WEIGHT = "_weight"


@dataclass
class Encoder:
    """Feature columns, their encoded vector and how slots map back to columns."""

    features: list[str]
    words: list[str]
    model: PipelineModel
    lineage: dict[str, list[str]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(as_words(df, self.words))


def as_words(df: DataFrame, words: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in words})


def ordinal_encoder(df: DataFrame, features: list[str]) -> Encoder:
    """Words become codes (unknown words one extra code), numbers stay: for trees."""
    words = [f for f in features if not numeric(df, f)]
    stages = []
    if words:
        stages.append(StringIndexer(
            inputCols=words, outputCols=[f"{c}__code" for c in words], handleInvalid="keep", stringOrderType="alphabetAsc"
        ))
    slots = [f"{c}__code" if c in words else c for c in features]
    stages.append(VectorAssembler(inputCols=slots, outputCol="features", handleInvalid="keep"))
    model = Pipeline(stages=stages).fit(as_words(df, words))
    return Encoder(features, words, model, {c: [c] for c in features})


def one_hot_encoder(df: DataFrame, categorical: list[str], numbers: list[str]) -> Encoder:
    """One slot per level of each categorical column; ``lineage`` names the slots of each."""
    index = StringIndexer(
        inputCols=categorical, outputCols=[f"{c}__code" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc"
    )
    hot = OneHotEncoder(
        inputCols=[f"{c}__code" for c in categorical], outputCols=[f"{c}__hot" for c in categorical], dropLast=False, handleInvalid="keep"
    )
    stages = [index, hot] if categorical else []
    stages.append(VectorAssembler(inputCols=[*numbers, *[f"{c}__hot" for c in categorical]], outputCol="features", handleInvalid="keep"))
    model = Pipeline(stages=stages).fit(as_words(df, categorical))
    lineage = {c: [c] for c in numbers}
    for c in categorical:
        labels = model.stages[0].labelsArray[categorical.index(c)]
        lineage[c] = [f"{c}_{label}" for label in labels] + [f"{c}_other"] * 2
    return Encoder([*numbers, *categorical], categorical, model, lineage)


def lineage_table(spark, encoder: Encoder) -> DataFrame:
    rows = [(parent, child) for parent, children in encoder.lineage.items() for child in dict.fromkeys(children)]
    return spark.createDataFrame(rows, "feature string, encoded string")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows multiplied by ``n / (2 * n_class)``."""
    totals = df.agg(F.struct(F.sum(ROW_WEIGHT).alias("n"), F.sum(F.col(ROW_WEIGHT) * F.col(label)).alias("p")).alias("t")).scalar()
    t = df.withColumn("_t", totals)
    size = F.when(F.col(label) == 1, F.col("_t.p")).otherwise(F.col("_t.n") - F.col("_t.p"))
    return t.withColumn(ROW_WEIGHT, F.col(ROW_WEIGHT) * F.col("_t.n") / (2 * size)).drop("_t")


def collapsed(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Equal settings with equal labels become one weighted row.

    Trees only see counts per split, so training on configurations instead of runs gives the
    same splits for a fraction of the rows when settings are discrete.
    """
    return df.groupBy(*features, F.col(label).cast("double").alias("label")).agg(F.count("*").cast("double").alias(ROW_WEIGHT))


@dataclass
class RiskModel:
    encoder: Encoder
    model: object
    features: list[str]

    def score(self, df: DataFrame, column: str = "risk", digits: int | None = None) -> DataFrame:
        """Add the failure probability to every row."""
        out = self.model.transform(self.encoder.transform(df))
        p = vector_to_array("probability")[1]
        out = out.withColumn(column, F.round(p, digits) if digits else p)
        keep = [c for c in df.columns if c != column]
        # Original spellings of the settings are untouched: only words were cast to text.
        return out.select(*keep, column)


@dataclass
class BoostedModel:
    """Boosted trees with the encoder of their settings."""

    encoder: Encoder
    model: boosting.BoostedTrees
    features: list[str]

    def margin(self, df: DataFrame, column: str = "margin") -> DataFrame:
        """Add the sum of all trees: log-odds of failure, or the predicted value."""
        out = self.model.margin(self.encoder.transform(df.withColumns({f"_raw_{c}": F.col(c) for c in self.encoder.words})))
        raw = [F.col(f"_raw_{c}").alias(c) if c in self.encoder.words else F.col(c) for c in df.columns if c != column]
        return out.select(*raw, F.col("_margin").alias(column))

    def score(self, df: DataFrame, column: str = "risk", digits: int | None = None) -> DataFrame:
        """Add the failure probability to every row."""
        p = 1 / (1 + F.exp(-F.col(column)))
        return self.margin(df, column).withColumn(column, F.round(p, digits) if digits else p)


def _level_counts(encoder: Encoder) -> list[int]:
    """Levels of each slot's words, 0 for numbers."""
    labels = dict(zip(encoder.words, encoder.model.stages[0].labelsArray)) if encoder.words else {}
    return [len(labels.get(f, ())) for f in encoder.features]


def train_risk(
    runs: DataFrame, features: list[str], rounds: int = 400, patience: int = 40, min_leaf: int = 25, seed: int = 42, test_share: float = 0.2,
) -> tuple[BoostedModel, DataFrame]:
    """Boosted trees on the settings; returns the model and the marked runs (``is_test``).

    Held-out runs take no part in the fit; a tenth of the other configurations stops it. Words are ordinal-coded.
    """
    marked = stratified_split(runs, test_share, seed)
    encoder = ordinal_encoder(runs, features)
    rows = marked.where(~F.col("is_test")).withColumn("label", failed().cast("double"))
    train = encoder.transform(collapsed(rows, features, "label"))
    model = boosting.fit(train, _level_counts(encoder), "log", rounds=rounds, patience=patience, min_leaf=min_leaf, seed=seed)
    return BoostedModel(encoder, model, features), marked


BASELINES = {
    "random_forest": lambda bins, seed, scale: {"trees": int(200 * scale), "depth": 12, "min_rows": 5, "bins": bins, "seed": seed},
    "gradient_boosting": lambda bins, seed, scale: GBTClassifier(
        maxIter=int(200 * scale), maxDepth=8, minInstancesPerNode=10, maxBins=bins, seed=seed, weightCol=ROW_WEIGHT
    ),
    "logistic_regression": lambda bins, seed, scale: LogisticRegression(maxIter=int(1000 * scale), weightCol=ROW_WEIGHT),
}


def train_baseline(
    df: DataFrame, roles: dict[str, list[str]], name: str = "random_forest", seed: int = 42, test_share: float = 0.2, scale: float = 1.0
) -> tuple[RiskModel, DataFrame]:
    """One-hot baseline with balanced classes; ``scale`` shortens the fit."""
    if name not in BASELINES:
        raise ValueError(f"unknown model {name!r}; choose from {sorted(BASELINES)}")
    features = [*roles["numeric"], *roles["categorical"]]
    marked = stratified_split(df, test_share, seed)
    encoder = one_hot_encoder(df, roles["categorical"], roles["numeric"])
    train = marked.where(~F.col("is_test")).withColumn("label", failed().cast("double")).withColumn(ROW_WEIGHT, F.lit(1.0))
    if name == "random_forest":
        widths = [len(encoder.lineage[f]) - 2 if f in encoder.words else 0 for f in features]
        slots = F.array(*[F.coalesce(F.col(f"{f}__code" if f in encoder.words else f).cast("double"), F.lit(float("nan"))) for f in features])
        return RiskModel(encoder, forest.fit(encoder.transform(train), slots, widths, **BASELINES[name](32, seed, scale)), features), marked
    encoded = class_weights(encoder.transform(train)).select("features", "label", ROW_WEIGHT).persist()
    try:
        model = BASELINES[name](32, seed, scale).fit(encoded)
    finally:
        encoded.unpersist()
    return RiskModel(encoder, model, features), marked


def raw_importances(spark, risk: RiskModel) -> DataFrame:
    """``encoded, importance`` per vector slot, from the model (absolute coefficients for linear ones)."""
    names = [slot for f in risk.encoder.features for slot in risk.encoder.lineage[f]]
    values = risk.model.featureImportances if hasattr(risk.model, "featureImportances") else risk.model.coefficients
    rows = [(n, abs(float(v))) for n, v in zip(names, values.toArray())]
    return spark.createDataFrame(rows, "encoded string, importance double")


def rolled_up_importances(raw: DataFrame, lineage: DataFrame) -> DataFrame:
    """Importances summed per parent column, scaled to 1 and ranked."""
    from pyspark.sql import Window

    parents = raw.join(lineage, "encoded").groupBy("feature").agg(F.sum("importance").alias("_i"))
    total = parents.agg(F.sum("_i")).scalar()
    order = Window.orderBy(F.desc("_i"), "feature")  # one row per column of the table
    return parents.select(
        "feature", F.round(F.col("_i") / F.nullif(total, F.lit(0.0)), 4).alias("importance"), F.row_number().over(order).alias("rank")
    )


def train_throughput(
    runs: DataFrame, features: list[str], rounds: int = 350, patience: int = 40, min_leaf: int = 25, seed: int = 42,
) -> BoostedModel:
    """Boosted regression of throughput on passing runs (on all runs when few pass).

    Equal settings collapse to their mean throughput, weighted by their number; a tenth of them stops the rounds.
    """
    passing = runs.where(~failed())
    base = (passing if passing.limit(50).count() >= 50 else runs).where("throughput_mbps is not null")
    encoder = ordinal_encoder(runs, features)
    grouped = base.groupBy(*features).agg(
        F.avg(F.col("throughput_mbps").cast("double")).alias("label"), F.count("*").cast("double").alias(ROW_WEIGHT)
    )
    train = encoder.transform(grouped)
    model = boosting.fit(train, _level_counts(encoder), "square", rounds=rounds, patience=patience, min_leaf=min_leaf, row_share=1.0, column_share=1.0, seed=seed)
    return BoostedModel(encoder, model, features)
