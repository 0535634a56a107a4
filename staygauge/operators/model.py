"""Price model: impute, scale, assemble, boosted trees, and its quality."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staygauge import fixed_values as fixed
from staygauge.operators.fitted import MedianImputer
from staygauge.operators.stats import exact_medians, non_null_counts, sample_rows
from staygauge.session import release, settle

LABEL = "price_cleaned"


@dataclass(frozen=True)
class FeatureSet:
    continuous: tuple[str, ...]
    binary: tuple[str, ...]

    @property
    def names(self) -> list[str]:
        return [*self.continuous, *self.binary]


def usable_features(train: DataFrame) -> FeatureSet:
    """Model inputs that the table has with at least one value, in their fixed order. One pass counts them all."""
    wanted = [c for c in [*fixed.CONTINUOUS_FEATURES, *fixed.BINARY_FEATURES] if c in train.columns]
    typed = [c for c in train.columns if c.startswith("type_")]
    counts = {r["feature"]: r["non_null"] for r in non_null_counts(train, wanted + typed).collect()}
    return FeatureSet(
        tuple(c for c in fixed.CONTINUOUS_FEATURES if counts.get(c)),
        tuple(c for c in [*fixed.BINARY_FEATURES, *typed] if counts.get(c)),
    )


def _imputed(names) -> list[str]:
    return [f"{n}_imputed" for n in names]


def preparation_stages(features: FeatureSet, median_error: float = 0.001) -> list:
    """Median and mode imputation, centring and scaling of the continuous inputs, one vector in fixed order. ``median_error`` 0:
    exact medians."""
    stages, parts = [], []
    if features.continuous:
        columns = {"inputCols": list(features.continuous), "outputCols": _imputed(features.continuous)}
        stages += [
            Imputer(strategy="median", relativeError=median_error, **columns) if median_error else MedianImputer(**columns),
            VectorAssembler(inputCols=_imputed(features.continuous), outputCol="continuous", handleInvalid="keep"),
            StandardScaler(inputCol="continuous", outputCol="scaled", withMean=True, withStd=True),
        ]
        parts.append("scaled")
    if features.binary:
        stages += [
            Imputer(strategy="mode", inputCols=list(features.binary), outputCols=_imputed(features.binary)),
            VectorAssembler(inputCols=_imputed(features.binary), outputCol="binary", handleInvalid="keep"),
        ]
        parts.append("binary")
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep")]


def fit_price_model(
    train: DataFrame, features: FeatureSet, iterations: int = fixed.TREE_ITERATIONS, depth: int = fixed.TREE_DEPTH,
    step: float = fixed.TREE_STEP, seed: int = 42, median_error: float = 0.001,
) -> PipelineModel:
    """Fit all stages into one object that scores any table with the same columns.

    The trees read the label and the finished vectors from a settled table: every iteration then scans two columns,
    and the planner does not carry the whole preparation through each of its passes.
    """
    prepared = Pipeline(stages=preparation_stages(features, median_error)).fit(train.select(LABEL, *features.names))
    vectors = settle(prepared.transform(train.select(LABEL, *features.names)).select(LABEL, "features"), "vectors")
    release(train.sparkSession)
    trees = GBTRegressor(featuresCol="features", labelCol=LABEL, maxIter=iterations, maxDepth=depth, stepSize=step, seed=seed)
    return PipelineModel(stages=[*prepared.stages, trees.fit(vectors)])


def predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``prediction`` (log price) and ``prediction_real``; the intermediate columns are dropped."""
    scored = model.transform(df)
    return scored.select(*df.columns, "prediction", F.expm1("prediction").alias("prediction_real"))


def regression_metrics(scored: DataFrame, by: list[str], features: int, label: str = LABEL) -> DataFrame:
    """RMSE, MAE, R2, adjusted R2, exact median absolute error and mean absolute percentage error."""
    y, error = F.col(label), F.col(label) - F.col("prediction")
    sums = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(error * error).alias("sse"),
        F.avg(F.abs(error)).alias("MAE"),
        (F.var_pop(y) * F.count(y)).alias("sst"),
        (F.avg(F.abs(F.try_divide(error, y))) * 100).alias("MAPE"),
    )
    middle = exact_medians(scored.select(*by, F.abs(error).alias("error")), by, {"error": "MedAE"})
    sums = sums.join(middle, by, "left") if by else sums.withColumn("MedAE", middle.scalar())
    r2 = 1 - F.try_divide(F.col("sse"), F.col("sst"))
    return sums.select(
        *by, "n", F.sqrt(F.col("sse") / F.col("n")).alias("RMSE"), "MAE", r2.alias("R2"),
        (1 - (1 - r2) * F.try_divide(F.col("n") - 1, F.col("n") - features - 1)).alias("Adj_R2"), "MedAE", "MAPE")


def scored_sample(scored: DataFrame, key: list[str], rows: int = 1000, seed: int = 42) -> DataFrame:
    """Sample of actual and predicted log prices, in a hash order of the rows' key."""
    return sample_rows(scored, rows, key, seed).select(LABEL, "prediction")


def feature_category(name: Column) -> Column:
    """Category of a feature name, with or without the imputation suffix."""
    bare = F.replace(name, F.lit("_imputed"), F.lit(""))
    table = F.create_map(*[F.lit(x) for pair in fixed.FEATURE_CATEGORY.items() for x in pair])
    return F.when(bare.startswith("type_"), "Binary").otherwise(F.coalesce(F.try_element_at(table, bare), F.lit("Other")))
