"""From token matrices to scores: pooling, projection heads, and where a model plugs in.

Pooling and normalising are column functions. A head is a few matrix products with fixed weights of a
model, so it runs on Arrow batches with numpy; its weights are checked against a bound and sent once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.vectors import l2_normalise

MAX_WEIGHT_BYTES = 256 << 20


def last_token(tokens: Column, mask: Column) -> Column:
    """The row of the last token that isn't padding; mask: 1 for real tokens."""
    return F.get(tokens, F.array_max(F.transform(mask, lambda m, i: F.when(m == 1, i))))


def pool(tokens: Column, mask: Column) -> Column:
    return l2_normalise(last_token(tokens, mask))


@dataclass(frozen=True)
class Layer:
    """y = activation(layer_norm(x W + b)); weight: inputs x outputs."""

    weight: np.ndarray
    bias: np.ndarray
    activation: str | None = None
    normalise: bool = False

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.weight + self.bias
        if self.normalise:
            y = (y - y.mean(axis=1, keepdims=True)) / np.sqrt(y.var(axis=1, keepdims=True) + 1e-5)
        if self.activation == "relu":
            return np.maximum(y, 0)
        if self.activation == "tanh":
            return np.tanh(y)
        if self.activation is not None:
            raise ValueError(f"no activation {self.activation}")
        return y


def head(spark, layers: list[Layer]) -> Callable[[Column], Column]:
    """A column function that projects vectors and scales them to length one."""
    size = sum(layer.weight.nbytes + layer.bias.nbytes for layer in layers)
    if size > MAX_WEIGHT_BYTES:
        raise ValueError(f"a head of {size} bytes; at most {MAX_WEIGHT_BYTES} are sent to every task")
    sent = spark.sparkContext.broadcast(layers)

    @F.pandas_udf(ArrayType(DoubleType()))
    def project(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        x = np.stack(v.to_numpy()).astype(np.float64)
        for layer in sent.value:
            x = layer(x)
        return pd.Series(list(x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)))

    return project


def encode_once(df: DataFrame, text: str, encoder: Callable[[Column], Column]) -> DataFrame:
    """Adds `vector`, with each distinct text encoded once. Rows meet vectors by the text's digest; null texts have null vectors."""
    key = F.sha2(F.col(text).cast("string"), 256)
    once = df.where(F.col(text).isNotNull()).groupBy(key.alias("key_")).agg(F.max(text).alias(text))
    vectors = once.select("key_", encoder(F.col(text)).alias("vector"))
    return df.withColumn("key_", key).join(vectors, "key_", "left").drop("key_")
