"""Random forests on tables: preparation, training, prediction, evaluation, saving."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.param import Param, Params
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillon.functions.types import numeric_columns, text_columns, value_or_null
from quillon.operators.natural_join import natural_join
from quillon.operators.rows import with_row_number
from quillon.session import scratch
from quillon.sources.registry import read_tables

# Seed, share of training rows in tenths, trees.
SEED, TRAIN_TENTHS, TREES = 42, 8, 100


def label_encode(df: DataFrame, column: str, into: str) -> DataFrame:
    """Codes 0..n-1 of the sorted values; a missing value has no code.

    The distinct values are numbered across tasks and joined back, so their number is not
    limited by the driver.
    """
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    codes = with_row_number(values, column, "__code").select(
        F.col(column).alias("__value"), (F.col("__code") - 1).cast("bigint").alias(into))
    return df.join(codes, df[column] == codes["__value"], "left").drop("__value")


def in_training(*key: str, seed: int = SEED) -> Column:
    """True for about 80 % of the rows, by the MD5 of their key: stable under repartitioning,
    and any engine can repeat it."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(f"`{k}`").cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 10 < TRAIN_TENTHS


def train_test_split(df: DataFrame, key: list[str], seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("__train", in_training(*key, seed=seed))
    return marked.where("__train").drop("__train"), marked.where("NOT __train").drop("__train")


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: mse, rmse, r2. The residual and total sums come from one pass of moments."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    both = y.isNotNull() & p.isNotNull()
    y, p = F.when(both, y), F.when(both, p)
    mse = F.avg((y - p) * (y - p))
    return df.agg(F.count(y).alias("n"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
                  (1 - F.try_divide(mse, F.var_pop(y))).alias("r2"))


def classification_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    hit = (F.col(actual).cast("string") == F.col(predicted).cast("string")).cast("double")
    return df.agg(F.count(hit).alias("n"), F.avg(hit).alias("accuracy"))


class CodeTable(Params):
    """A stage that keeps the values of a column and their codes in a written table, however many there are."""

    def __init__(self, column: str = "", into: str = "", path: str = ""):
        super().__init__()
        self.column, self.into, self.path = (Param(self, n, t) for n, t in (
            ("column", "the column"), ("into", "the column of its codes"), ("path", "the folder of the codes")))
        self._set(column=column, into=into, path=path)

    def codes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("value string, code bigint").parquet(self.getOrDefault("path"))

    def needs(self) -> str:
        """The column that a frame must have for this stage."""
        return self.getOrDefault("column")


class ValueCodes(CodeTable, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Values become the number of their place in sorted order by a join; those not in the table, and missing ones, share the number after
    the last."""

    def _transform(self, df: DataFrame) -> DataFrame:
        column, into = self.getOrDefault("column"), self.getOrDefault("into")
        codes = self.codes(df.sparkSession)
        beyond = codes.agg(F.coalesce(F.max("code") + 1, F.lit(0))).scalar()
        known = codes.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
        return df.join(known, df[column].cast("string") == known["__value"], "left").withColumn(
            into, F.coalesce("__code", beyond).cast("double")).drop("__value", "__code")


class CodeValues(CodeTable, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The inverse: a column of codes (``column``) becomes one of values."""

    def _transform(self, df: DataFrame) -> DataFrame:
        known = self.codes(df.sparkSession).select(F.col("value").alias(self.getOrDefault("into")), F.col("code").cast("double").alias("__code"))
        return df.join(known, df[self.getOrDefault("column")] == known["__code"], "left").drop("__code")


def write_codes(df: DataFrame, column: str) -> str:
    """Write the sorted values of a column with the codes 0..n-1; returns the folder."""
    path = scratch(df.sparkSession, "codes")
    text = df.select(F.col(column).cast("string").alias("value"))
    label_encode(text.where(F.col("value").isNotNull()).distinct(), "value", "code").write.parquet(path)
    return path


def build_pipeline(df: DataFrame, target: str, kind: str, trees: int = TREES, drop: tuple[str, ...] = ()) -> Pipeline:
    """Encoders, assembler and forest in one pipeline, fitted once and reused for prediction.

    A missing number counts as the mean of its column, so every row is used and predicted.
    Text becomes the number of its value in sorted order, by a join with a written table of codes, so that neither
    features nor classes are collected; values unseen in training share a number of their own instead of failing.
    """
    texts = [c for c in text_columns(df) if c != target and c not in drop]
    numbers = [c for c in numeric_columns(df) if c != target and c not in drop]
    # plain numbers: a forest splits them by order and needs no bin per value
    stages: list = [ValueCodes(c, f"{c}__number", write_codes(df, c)) for c in texts]
    if numbers:
        means = df.agg(*[F.avg(value_or_null(df, c).cast("double")).alias(c) for c in numbers]).first()
        filled = ", ".join(f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), NULL), {float(means[c] or 0.0)!r}D) AS `{c}__number`"
                           for c in numbers)
        stages.append(SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"))
    stages.append(VectorAssembler(inputCols=[f"{c}__number" for c in numbers + texts],
                                  outputCol="features", handleInvalid="error"))
    if kind == "regression":
        stages.append(RandomForestRegressor(labelCol=target, numTrees=trees, seed=SEED))
    elif kind == "classification":
        codes = write_codes(df, target)
        stages += [ValueCodes(target, "label", codes), RandomForestClassifier(labelCol="label", numTrees=trees, seed=SEED),
                   CodeValues("prediction", "predicted", codes)]
    else:
        raise ValueError(f"unknown model type {kind!r}")
    return Pipeline(stages=stages)


def train(df: DataFrame, target: str, kind: str = "regression", key: list[str] | None = None,
          trees: int = TREES) -> tuple[PipelineModel, DataFrame]:
    """``(model, metrics)``: fitted on 80 % of the rows, measured on the rest.

    ``key`` columns choose the split and are no features; without them all columns choose it.
    """
    rows = df.where(F.col(target).isNotNull())
    fit_rows, test_rows = train_test_split(rows, key or df.columns)
    model = build_pipeline(rows, target, kind, trees, tuple(key or ())).fit(fit_rows)
    return model, evaluate(model, test_rows, target, kind)


def evaluate(model: PipelineModel, df: DataFrame, target: str, kind: str) -> DataFrame:
    scored = predict(model, df)
    if kind == "regression":
        return regression_metrics(scored, target, "prediction")
    return classification_metrics(scored, target, "predicted")


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The rows with ``prediction``, and ``predicted`` and ``probability`` for classes.

    The target need not be there: the stage that encodes it is passed over.
    """
    for stage in model.stages:
        if not isinstance(stage, CodeTable) or stage.needs() in df.columns:
            df = stage.transform(df)
    helpers = [c for c in df.columns if c.endswith(("__code", "__number"))]
    return df.drop("features", "rawPrediction", "label", *helpers)


def save_model(model: PipelineModel, path: str, metrics: DataFrame, features: list[str]) -> None:
    """The fitted pipeline with the code tables that it reads, and its features and metrics as a JSON side file."""
    copies: dict[str, str] = {}
    for stage in (s for s in model.stages if isinstance(s, CodeTable)):
        old = stage.getOrDefault("path")
        if old not in copies:
            copies[old] = f"{path}/codes-{len(copies)}"
            if old != copies[old]:
                stage.codes(metrics.sparkSession).write.mode("overwrite").parquet(copies[old])
        stage._set(path=copies[old])
    model.write().overwrite().save(f"{path}/model")
    row = metrics.select(F.to_json(F.struct(*metrics.columns)).alias("metrics"))
    (row.withColumn("features", F.lit(json.dumps(features))).coalesce(1)
     .write.mode("overwrite").json(f"{path}/info"))


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.json(f"{path}/info")


def train_on_source(spark: SparkSession, cfg: dict, target: str, kind: str = "regression",
                    key: list[str] | None = None, trees: int = TREES) -> tuple[PipelineModel, DataFrame]:
    """Train on all tables of a source, joined on the columns they share."""
    joined, _ = natural_join(read_tables(spark, cfg))
    return train(joined, target, kind, key, trees)


def predict_on_source(spark: SparkSession, cfg: dict, model: PipelineModel) -> DataFrame:
    joined, _ = natural_join(read_tables(spark, cfg))
    return predict(model, joined)
