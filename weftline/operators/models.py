"""Model fitting with pyspark.ml, folds, ablation and permutation importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.simulate import uniform


def make_model(kind: str, features: Sequence[str], label: str, seed: int = 42) -> Pipeline:
    """A pipeline: assembler and one of 'gbt_class', 'gbt_reg', 'logistic', 'linear', 'ridge'."""
    common = {"featuresCol": "_x", "labelCol": label}
    stage = {
        "gbt_class": lambda: GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.1, seed=seed, **common),
        "gbt_reg": lambda: GBTRegressor(maxIter=20, maxDepth=3, stepSize=0.1, seed=seed, **common),
        "logistic": lambda: LogisticRegression(maxIter=50, regParam=0.0, **common),
        "linear": lambda: LinearRegression(solver="normal", **common),
        "ridge": lambda: LinearRegression(solver="normal", regParam=1.0, elasticNetParam=0.0, **common),
    }[kind]()
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip"), stage])


def scores(model, df: DataFrame, name: str = "score") -> DataFrame:
    """``df`` with the model's probability of the positive class, or its prediction."""
    out = model.transform(df)
    value = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.withColumn(name, value).drop("_x", "rawPrediction", "probability", "prediction")


def folds(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """``fold`` 0..k-1 by hash of the key: repeatable, without a shuffle."""
    return df.withColumn("fold", F.floor(uniform(seed, F.col(key)) * k).cast("int"))


def cross_validated(df: DataFrame, key: str, kind: str, features: Sequence[str], label: str, k: int = 3) -> DataFrame:
    """Out-of-fold scores of every row."""
    f = folds(df, key, k)
    out = None
    for i in range(k):
        part = scores(make_model(kind, features, label).fit(f.filter(F.col("fold") != i)), f.filter(F.col("fold") == i))
        out = part if out is None else out.unionByName(part)
    return out


def ablation(train: DataFrame, test: DataFrame, kind: str, features: Sequence[str], label: str) -> DataFrame:
    """Mean absolute error on the test part with all features and without each of them."""
    rows = []
    for left_out in [None, *features]:
        use = [f for f in features if f != left_out]
        got = scores(make_model(kind, use, label).fit(train), test).agg(F.avg(F.abs(F.col("score") - F.col(label)))).first()[0]
        rows.append((left_out or "none", float(got) if got is not None else None))
    return train.sparkSession.createDataFrame(rows, "left_out string, mae double")


def permutation_importance(model, test: DataFrame, key: str, features: Sequence[str], label: str, seed: int = 42) -> DataFrame:
    """Growth of the mean absolute error when one feature's values change rows (by a repeatable shuffle)."""
    base = scores(model, test).agg(F.avg(F.abs(F.col("score") - F.col(label)))).first()[0]
    rows = []
    for f in features:
        # values and rows are numbered by two hashes and joined: a shuffle of one column, distributed over buckets
        b = F.floor(uniform(seed, F.col(key)) * 64).cast("int")
        left = test.withColumn("_b", b).withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(seed + 1), key), key)))
        right = test.withColumn("_b", b).withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(seed + 2), key), key)))
        mixed = left.drop(f).join(right.select("_b", "_n", f), ["_b", "_n"])
        got = scores(model, mixed).agg(F.avg(F.abs(F.col("score") - F.col(label)))).first()[0]
        rows.append((f, float(got - base)))
    return test.sparkSession.createDataFrame(rows, "feature string, importance double")
