"""Classifiers on feature tables, and the batch-inference extension point."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerlens.runtime import BATCH_ROWS, short_batches, slices, spread


def _assemble(cols: Sequence[str]):
    filled = [f"{c}__f" for c in cols]
    return [
        Imputer(strategy="mean", inputCols=list(cols), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="features"),
    ]


def gbt(cols, label="label", *, depth=7, step=0.02, rounds=20, validation: str | None = None, seed=1) -> Pipeline:
    """Boosted trees; rows with ``validation`` = true stop the boosting early."""
    model = GBTClassifier(labelCol=label, maxDepth=depth, stepSize=step, maxIter=rounds, seed=seed)
    if validation:
        model = model.setParams(validationIndicatorCol=validation)
    return Pipeline(stages=[*_assemble(cols), model])


def random_forest(cols, label="label", *, trees=150, depth=10, seed=1) -> Pipeline:
    model = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[*_assemble(cols), model])


def mlp_pca(cols, label="label", *, components=512, hidden=(256, 64), epochs=50, seed=1) -> Pipeline:
    """Mean impute, principal components, standardise, two hidden layers."""
    k = min(components, len(cols))
    layers = [k, *hidden, 2]
    return Pipeline(
        stages=[
            *_assemble(cols),
            PCA(k=k, inputCol="features", outputCol="_pca"),
            StandardScaler(inputCol="_pca", outputCol="_std", withMean=True, withStd=True),
            MultilayerPerceptronClassifier(labelCol=label, featuresCol="_std", layers=layers, maxIter=epochs, seed=seed),
        ]
    )


def pair_scorer(cols, label="target") -> Pipeline:
    """Relevance of (query, passage) pairs from table features."""
    return Pipeline(
        stages=[
            *_assemble(cols),
            StandardScaler(inputCol="features", outputCol="_std", withMean=True),
            LogisticRegression(labelCol=label, featuresCol="_std", regParam=0.01),
        ]
    )


def predict(model, df: DataFrame, name: str = "pred") -> DataFrame:
    """Input rows plus the probability of class 1."""
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.select(*df.columns, name)


def importance(model, cols: Sequence[str]) -> DataFrame:
    """(feature, importance), one row per feature column, largest first."""
    scores = [(c, float(v)) for c, v in zip(cols, model.stages[-1].featureImportances.toArray())]
    return SparkSession.active().createDataFrame(scores, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def hashing_encoder(size: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Default plug-in: signed hashed word counts, scaled to unit length. Needs no download."""

    def make():
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size))
            for row, text in zip(out, texts):
                for w in (text or "").lower().split():
                    h = zlib.crc32(w.encode())
                    row[h % size] += 1.0 if h & 0x80000000 else -1.0
            length = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(length == 0, 1.0, length)

        return encode

    return make


def batch_infer(
    df: DataFrame, key: str, text: str, make: Callable[[], Callable], *, batch: int = 64, name: str = "vector",
    returns: T.DataType | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """Run a model over a text column in batches. ``make`` loads the model once per task; the function it
    returns takes a list of texts and gives one output per text. The columns in ``keep`` are passed through."""
    out_type = returns or T.ArrayType(T.DoubleType())
    schema = T.StructType([df.schema[key], *[df.schema[c] for c in keep], T.StructField(name, out_type)])

    def run(frames):
        infer = make()
        for pdf in slices(frames, max(batch, BATCH_ROWS // batch * batch)):
            texts, out = pdf[text].tolist(), []
            for lo in range(0, len(texts), batch):
                out.extend(list(infer(texts[lo : lo + batch])))
            yield pd.DataFrame({key: pdf[key], **{c: pdf[c] for c in keep}, name: out})

    return short_batches(spread(df.select(key, text, *[c for c in keep if c != text]))).mapInPandas(run, schema)
