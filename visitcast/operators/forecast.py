"""Model inputs, random forest, scores and result curves.

Defined results: a null list has null counts, one without values in the bins zeros; unseen
categories share a slot; R² is null where the actual values don't vary; curves sum the rows of a
day, days without rows are missing.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, LinearRegressionModel, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def vectorise_multi(df: DataFrame, col: str, bins: list[float]) -> DataFrame:
    """df with <col>_counts: how many values fall from each bound up to the next; below and beyond are left out."""
    counts = [_between(col, a, b) for a, b in zip(bins, bins[1:], strict=False)]
    return df.withColumn(f"{col}_counts", F.when(F.col(col).isNotNull(), F.array(*counts)))


def _between(col: str, a: float, b: float) -> Column:
    return F.size(F.filter(F.col(col), lambda x: (x >= a) & (x < b)))


def cross_features(df: DataFrame, cols: list[str], size: int = 1 << 12, output: str = "crossed") -> DataFrame:
    """df with `output`: the hashed combination of the columns' values."""
    joined = df.withColumn("_crossed", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in cols]))
    return FeatureHasher(inputCols=["_crossed"], outputCol=output, numFeatures=size).transform(joined).drop("_crossed")


def encode_categories(train: DataFrame, cols: list[str]) -> PipelineModel:
    """Adds <col>_index and <col>_onehot; fitted on the training side, unseen values get a slot of their own."""
    index = StringIndexer(inputCols=cols, outputCols=[f"{c}_index" for c in cols], handleInvalid="keep", stringOrderType="alphabetAsc")
    onehot = OneHotEncoder(inputCols=[f"{c}_index" for c in cols], outputCols=[f"{c}_onehot" for c in cols], handleInvalid="keep")
    return Pipeline(stages=[index, onehot]).fit(train)


def drop_multi(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if "_multi" in c])


def split_by_date(df: DataFrame, split_date: date) -> tuple[DataFrame, DataFrame]:
    """Rows before the date, and from it on."""
    return df.filter(F.col("date") < F.lit(split_date)), df.filter(F.col("date") >= F.lit(split_date))


@dataclass(frozen=True)
class Forest:
    """A fitted forest with its features and what stands for their missing values."""

    model: RandomForestRegressionModel
    features: list[str]
    means: list[float]

    def assembled(self, df: DataFrame) -> DataFrame:
        """df with `features`: one vector made in one projection, missing values replaced by the training means."""
        return df.withColumn("features", array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in zip(self.features, self.means, strict=True)])))


def fit_forest(train: DataFrame, features: list[str], seed: int = 1, trees: int = 20, depth: int = 6, label: str = "target") -> Forest:
    """Missing values get the training mean (0 where all are missing); the assembled vectors are what the trees read repeatedly."""
    means = train.agg(*[F.avg(F.col(c).cast("double")).alias(f"_{i}") for i, c in enumerate(features)]).first()
    empty = Forest(None, features, [0.0 if m is None else float(m) for m in means])
    data = empty.assembled(train).select("features", F.col(label).cast("double").alias(label)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return replace(empty, model=RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(data))
    finally:
        data.unpersist()


def predict(forest: Forest, df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """df with `predicted`."""
    if features not in (None, forest.features):
        raise ValueError("the forest was fitted on other features")
    return forest.model.transform(forest.assembled(df)).select(*df.columns, F.col("prediction").alias("predicted"))


@dataclass(frozen=True)
class SparseInputs:
    """What a linear model reads: numbers, one-hot categories, hashed crosses and binned multi-valued features in one sparse vector."""

    numbers: list[str]
    categories: list[str]
    crosses: list[list[str]]
    multi: dict[str, list[float]]
    codes: PipelineModel | None = None
    size: int = 1 << 12

    def fitted(self, train: DataFrame) -> SparseInputs:
        """With the categories of the training side; others share one slot."""
        return replace(self, codes=encode_categories(train, self.categories))

    def assembled(self, df: DataFrame) -> DataFrame:
        """df with `features`; missing numbers are 0, a missing multi-valued feature has no value in any bin."""
        out = self.codes.transform(df)
        for i, cols in enumerate(self.crosses):
            out = cross_features(out, cols, self.size, f"_cross{i}")
        for c, bins in self.multi.items():
            counts = [F.coalesce(_between(c, a, b), F.lit(0)).cast("double") for a, b in zip(bins, bins[1:], strict=False)]
            out = out.withColumn(f"_multi_{c}", array_to_vector(F.array(*counts)))
        out = out.withColumn("_numbers", array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.numbers])))
        parts = ["_numbers", *[f"{c}_onehot" for c in self.categories], *[f"_cross{i}" for i in range(len(self.crosses))], *[f"_multi_{c}" for c in self.multi]]
        return VectorAssembler(inputCols=parts, outputCol="features").transform(out).select(*df.columns, "features")


def fit_linear(train: DataFrame, inputs: SparseInputs, label: str = "target", penalty: float = 0.1, rounds: int = 30) -> LinearRegressionModel:
    """Ridge regression on the sparse vectors, by gradients summed over the tasks."""
    data = inputs.assembled(train).select("features", F.col(label).cast("double").alias(label)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return LinearRegression(featuresCol="features", labelCol=label, regParam=penalty, maxIter=rounds, solver="l-bfgs").fit(data)
    finally:
        data.unpersist()


def predict_linear(model: LinearRegressionModel, inputs: SparseInputs, df: DataFrame) -> DataFrame:
    """df with `predicted`."""
    return model.transform(inputs.assembled(df)).select(*df.columns, F.col("prediction").alias("predicted"))


def r2(pred: DataFrame, by: list[str] | None = None, actual: str = "target", predicted: str = "predicted") -> DataFrame:
    """1 - residual / total sum of squares, whole or per series; null where the actual values don't vary."""
    keys = by or []
    means = pred.groupBy(*keys).agg(F.avg(actual).alias("_mean"))
    both = pred.join(means, keys) if keys else pred.join(F.broadcast(means))
    y, p = F.col(actual), F.col(predicted)
    scored = both.groupBy(*keys).agg(F.count("*").alias("n"), (1 - F.sum((y - p) * (y - p)) / F.nullif(F.sum((y - F.col("_mean")) * (y - F.col("_mean"))), F.lit(0.0))).alias("r2"))
    return scored


def importances(forest: Forest, features: list[str] | None = None) -> DataFrame:
    """feature, importance in falling order."""
    rows = [(f, float(x)) for f, x in zip(features or forest.features, forest.model.featureImportances.toArray(), strict=True)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def curve(pred: DataFrame, block: str, district: str) -> DataFrame:
    """date, district, block, actual, predicted: daily sums in one disease block and district."""
    chosen = pred.filter((F.col("block") == block) & (F.col("district") == district))
    return chosen.groupBy("date", "district", "block").agg(F.sum("target").alias("actual"), F.sum("predicted").alias("predicted")).orderBy("date")
