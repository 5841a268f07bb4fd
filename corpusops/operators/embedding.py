"""Text to vectors through a pluggable batch function, with a hashing TF-IDF default that needs no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from corpusops.functions.text import tokenize
from corpusops.operators.vectors import centroids


def embed(df: DataFrame, key: str, text: str, embedder: Callable[[Sequence[str]], Sequence[Sequence[float]]], batch: int = 100) -> DataFrame:
    """(key, embedding): the embedder is called in the tasks with at most `batch` texts at a time; null is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                yield pd.DataFrame({key: part[key], "embedding": [list(map(float, v)) for v in embedder(part[text].fillna("").tolist())]})

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<float>")


def hashed_tfidf(df: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """(key, embedding): hashed term counts weighed by inverse document frequency, at length 1; a text without
    terms has the zero vector."""
    counted = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=dims).transform(df.select(key, tokenize(F.coalesce(F.col(text), F.lit(""))).alias("tokens")))
    raw = IDF(inputCol="tf", outputCol="v").fit(counted).transform(counted).select(key, vector_to_array("v").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return raw.select(key, F.transform("v", lambda x: F.when(norm > 0, x / norm).otherwise(0.0)).cast("array<float>").alias("embedding"))


def letter_shares(texts: Sequence[str]) -> list[list[float]]:
    """How often a to z are in each text, at length 1; an embedder without a model, for trying jobs out."""
    counts = np.array([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in map(str.lower, texts)], float).reshape(-1, 26)
    return (counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12)).tolist()


def intent_by_anchors(turns: DataFrame, key: str, text: str, anchors: DataFrame, embedder: Callable[[Sequence[str]], Sequence[Sequence[float]]], least: float = 0.45) -> DataFrame:
    """(key, intent, score): the intent whose anchor phrases' mean vector is nearest to the text's, if it reaches `least`.
    anchors: (intent, phrase), some phrases an intent."""
    named = anchors.select("intent", "phrase").distinct()
    of = embed(named.withColumn("_key", F.concat_ws("\n", "intent", "phrase")), "_key", "phrase", embedder).select(F.split("_key", "\n", 2)[0].alias("intent"), "embedding")
    middle = F.broadcast(centroids(of, "intent", "embedding"))  # one row an intent
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    e, c = F.col("embedding").cast("array<double>"), F.col("centroid")
    size = F.sqrt(dot(e, e) * dot(c, c))
    met = embed(turns.select(key, text), key, text, embedder).crossJoin(middle).select(key, "intent", F.round(F.when(size > 0, dot(e, c) / F.nullif(size, F.lit(0.0))).otherwise(0.0), 6).alias("score"))
    best = met.groupBy(key).agg(F.max(F.struct("score", "intent")).alias("best")).select(key, "best.intent", "best.score")
    return best.where(F.col("score") >= least)
