"""Features and models on pyspark.ml, and stages of our own."""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF, IndexToString, Normalizer, StandardScaler, StringIndexer, UnivariateFeatureSelector, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quern.operators.text import tokens


def labelled(df: DataFrame, flag: str, array: str) -> DataFrame:
    """label (1.0 or 0.0) and features beside the row's columns."""
    return df.withColumn("label", F.col(flag).cast("double")).withColumn("features", array_to_vector(array))


def select_top(df: DataFrame, n: int = 10) -> DataFrame:
    """The n features with the highest chi-square statistic, as column selected."""
    s = UnivariateFeatureSelector(featuresCol="features", outputCol="selected", labelCol="label", selectionMode="numTopFeatures").setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(n)
    return s.fit(df).transform(df)


def hashed(df: DataFrame, text: str, out: str = "tf", size: int = 1 << 18) -> DataFrame:
    """Hashed term frequencies of the pieces between spaces."""
    held = df.withColumn("hashed_tokens", tokens(text))
    return HashingTF(inputCol="hashed_tokens", outputCol=out, numFeatures=size).transform(held).drop("hashed_tokens")


def hashed_with(df: DataFrame, text: str, vector: str, size: int = 1 << 18) -> DataFrame:
    """Hashed text followed by another vector, as features."""
    return VectorAssembler(inputCols=["hashed_text", vector], outputCol="features").transform(hashed(df, text, "hashed_text", size))


def word_vectors(df: DataFrame, text: str, size: int = 16, seed: int = 1, least: int = 5):
    return Word2Vec(vectorSize=size, seed=seed, minCount=least, inputCol="words", outputCol="vector").fit(df.select(tokens(text).alias("words")))


def scaler(df: DataFrame):
    return StandardScaler(inputCol="features", outputCol="scaled").fit(df)


def logistic(df: DataFrame, intercept: bool = True):
    return LogisticRegression(fitIntercept=intercept, maxIter=50).fit(df)


def export_csv(model) -> str:
    """Coefficients, then the intercept, joined by commas."""
    return ",".join(map(str, [*model.coefficients.toArray().tolist(), model.intercept]))


def assembler(*cols: str) -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol="features")


def indexer(col: str) -> StringIndexer:
    return StringIndexer(inputCol=col, outputCol=f"{col}_index", stringOrderType="alphabetAsc")


def unindexer(col: str, labels: list[str]) -> IndexToString:
    return IndexToString(inputCol=f"{col}_index", outputCol=f"{col}_back", labels=labels)


def normalizer(p: float = 2.0) -> Normalizer:
    return Normalizer(inputCol="features", outputCol="normal", p=p)


def text_to_bayes(text: str, size: int = 1 << 10) -> Pipeline:
    """Word counts by hash, then naive Bayes."""
    return Pipeline(stages=[WordPieces(inputCol=text, outputCol="pieces"), HashingTF(inputCol="pieces", outputCol="features", numFeatures=size), NaiveBayes()])


def search(df: DataFrame, smoothing: list[float], folds: int = 3, seed: int = 1):
    """Naive Bayes with the smoothing that cross-validation finds best."""
    nb = NaiveBayes()
    grid = ParamGridBuilder().addGrid(nb.smoothing, smoothing).build()
    return CrossValidator(estimator=nb, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=folds, seed=seed).fit(df)


class WordPieces(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pieces between spaces."""

    @keyword_only
    def __init__(self, inputCol: str = "text", outputCol: str = "pieces"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), tokens(self.getInputCol()))


class WordCount(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Number of pieces between spaces of a string column, as an int; other types are refused."""

    @keyword_only
    def __init__(self, inputCol: str = "text", outputCol: str = "n_words"):
        super().__init__()
        self._set(**self._input_kwargs)

    def transformSchema(self, schema: StructType) -> StructType:
        found = schema[self.getInputCol()].dataType.simpleString()
        if found != "string":
            raise TypeError(f"{self.getInputCol()} is {found}, not string")
        return StructType([*schema.fields, StructField(self.getOutputCol(), IntegerType())])

    def _transform(self, df: DataFrame) -> DataFrame:
        self.transformSchema(df.schema)
        return df.withColumn(self.getOutputCol(), F.size(tokens(self.getInputCol())).cast("int"))


class LabelIndexer(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Numbers a string column's values from 0, in ascending order."""

    @keyword_only
    def __init__(self, inputCol: str = "text", outputCol: str = "label_index"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> LabelIndexerModel:
        col = self.getInputCol()
        found = df.select(F.col(col).alias("v")).where("v is not null").distinct().orderBy("v").collect()
        return LabelIndexerModel(inputCol=col, outputCol=self.getOutputCol(), labels=[r.v for r in found])


class LabelIndexerModel(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Numbers as ints; unknown values give null."""

    labels = Param(Params._dummy(), "labels", "values in the order of their numbers", TypeConverters.toListString)

    @keyword_only
    def __init__(self, inputCol: str = "text", outputCol: str = "label_index", labels: list[str] | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        labels = self.getOrDefault(self.labels)
        # a table of labels, which the planner broadcasts if it is small, instead of a search through all labels a row
        table = df.sparkSession.createDataFrame(list(zip(labels, range(len(labels)))), "label_value string, label_place int")
        found = df.drop(self.getOutputCol()).join(table, F.col(self.getInputCol()) == F.col("label_value"), "left")
        return found.withColumn(self.getOutputCol(), F.col("label_place")).drop("label_value", "label_place")


def bernoulli_parameters(df: DataFrame, label: str, features: list[str], smoothing: float = 1.0) -> DataFrame:
    """(label, feature, log_prior, log_theta, log_neg): Bernoulli naive Bayes by counting non-zero values, in one grouping."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"), *(F.count_if(F.col(f) != 0).alias(f"f{k}") for k, f in enumerate(features)))
    total = Window.partitionBy()
    prior = F.log((F.col("n") + smoothing) / (F.sum("n").over(total) + smoothing * F.count("*").over(total)))
    rows = counts.withColumn("log_prior", prior).select(F.col(label).alias("label"), "n", "log_prior", F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"f{k}").alias("hits")) for k, f in enumerate(features)))))
    theta = (F.col("hits") + smoothing) / (F.col("n") + 2 * smoothing)
    return rows.select("label", "feature", "log_prior", F.log(theta).alias("log_theta"), F.log(1 - theta).alias("log_neg"))


def bernoulli_score(row: dict[str, float], parameters: list) -> dict:
    """Log scores of each label for one row, from collected parameters."""
    out: dict = {}
    for p in parameters:
        out.setdefault(p.label, p.log_prior)
        out[p.label] += p.log_theta if row[p.feature] != 0 else p.log_neg
    return {k: v for k, v in out.items() if not math.isnan(v)}
